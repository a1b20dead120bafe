"""Structure rules of the blog profile: headings, citations per section, first mention of cloud services."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hondana.functions.matching import bound, first_match, folded, folded_text, pattern
from hondana.schema import issue

#: Short and full names.
SERVICES = (
    ("Lambda", "AWS Lambda"),
    ("S3", "Amazon S3"),
    ("EC2", "Amazon EC2"),
    ("RDS", "Amazon RDS"),
    ("DynamoDB", "Amazon DynamoDB"),
    ("CloudWatch", "Amazon CloudWatch"),
    ("CloudFormation", "AWS CloudFormation"),
    ("IAM", "AWS IAM"),
    ("VPC", "Amazon VPC"),
    ("ECS", "Amazon ECS"),
    ("EKS", "Amazon EKS"),
)
CITATION = "（出典\\s*[:：]"
LEAST_CITATIONS = 3


def atx_headings(lines: DataFrame) -> DataFrame:
    """``lines`` with ``title`` (null on other lines) of ATX headings on lines of their own."""
    rx = "^ {0,3}#{1,6}(?:[ \\t]+|$)"
    body = F.regexp_replace(F.regexp_replace("line", rx, ""), "(?:^|[ \\t]+)#+[ \\t]*$", "")
    return lines.withColumn("title", F.when(F.col("line").rlike(rx), F.regexp_replace(body, "^[ \\t]+|[ \\t]+$", "")))


def check_citations(lines: DataFrame) -> DataFrame:
    """Sections (from a heading's end to the next heading) with three citations or more; lines: doc_id, n, masked, title."""
    up_to = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    of = F.last(F.when(F.col("title").isNotNull(), F.struct("n", "title")), ignorenulls=True).over(up_to)
    extra = [c for c in ("file",) if c in lines.columns]
    owned = lines.withColumn("of", of).where("of is not null and title is null")
    counted = owned.groupBy("doc_id", *extra, F.col("of.n").alias("n"), F.col("of.title").alias("matched")).agg(F.sum(F.regexp_count("masked", F.lit(pattern(CITATION)))).alias("times"))
    return _citation_issues(counted.where(F.col("times") >= LEAST_CITATIONS))


def check_citations_of(trees: DataFrame) -> DataFrame:
    """:func:`check_citations` of parsed documents (doc_id, masked, lines), within each row: a count carried from line to line, so no line moves."""
    extra = [c for c in ("file",) if c in trees.columns]
    state = "struct<n:int,title:string,times:int,out:array<struct<n:int,matched:string,times:int>>>"

    def closed(a: Column) -> Column:
        return F.when(a["times"] >= LEAST_CITATIONS, F.array_append(a["out"], F.struct(a["n"].alias("n"), a["title"].alias("matched"), a["times"].alias("times")))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        opens = x["title"].isNotNull()
        times = F.when(a["n"].isNull(), 0).otherwise(a["times"] + F.regexp_count(x["masked"], F.lit(pattern(CITATION))))
        after = F.struct(x["n"].alias("n"), x["title"].alias("title"), F.lit(0).alias("times"), closed(a).alias("out"))
        return F.when(opens, after).otherwise(F.struct(a["n"].alias("n"), a["title"].alias("title"), times.alias("times"), a["out"].alias("out"))).cast(state)

    start = F.struct(F.lit(None).alias("n"), F.lit(None).alias("title"), F.lit(0).alias("times"), F.array().alias("out")).cast(state)
    found = F.aggregate("lines", start, step, closed)
    rows = trees.where(F.contains("masked", F.lit("（出典"))).select("doc_id", *extra, F.explode(found).alias("s"))
    return _citation_issues(rows.select("doc_id", *extra, "s.*"))


def _citation_issues(counted: DataFrame) -> DataFrame:
    hits = counted.withColumn("col", F.lit(1))
    message = F.concat(F.lit("同一小節に出典表記が "), F.col("times").cast("string"), F.lit(" 回あります。本文に統合するか、出典をまとめてください。"))
    return issue(hits, "structure", "citation-density", message, "出典表記を 2 回以下に整理する", seq=F.col("n"))


def _short(short: str, formal: str) -> Callable[[Column], Column]:
    """A match of either name as a mention, null for one of the full name."""
    return lambda m: F.when(F.length(m["matched"]) == len(short), F.struct(F.lit(short).alias("short"), F.lit(formal).alias("formal"), m["col"].alias("place"), m["matched"].alias("matched")))


def first_mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row per service whose short name comes first: short, formal, place (1-based), matched.

    The first match of either name decides: a short name within a full one starts after it.
    """
    found = []
    for short, formal in SERVICES:
        either = first_match(F.col(text), pattern(f"{re.escape(formal)}|(?<![A-Za-z0-9]){re.escape(short)}(?![A-Za-z0-9])", True))
        hit = F.when(F.contains(F.col("_folded"), F.lit(folded_text(short))), either)
        found.append(bound(hit, _short(short, formal)))
    rows = docs.withColumn("_folded", folded(F.col(text))).withColumn("hit", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.select("*", "hit.*").drop("hit", "_folded")


def line_and_column(text: Column, place: Column) -> tuple[Column, Column]:
    """Line and column of a 1-based place: line ends before it, and what follows the last of them."""
    before = F.substr(text, F.lit(1), place - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.length(F.substring_index(before, "\n", -1)) + 1


def check_first_mentions(docs: DataFrame, masked: str = "masked") -> DataFrame:
    """Issues from whole masked texts (doc_id, text, masked)."""
    hits = first_mentions(docs, masked)
    line, column = line_and_column(F.col(masked), F.col("place"))
    hits = hits.withColumn("n", line).withColumn("col", column)
    message = F.concat(F.lit("「"), F.col("matched"), F.lit("」が AWS サービスを指すなら、初出時に正式名「"), F.col("formal"), F.lit("」を示します。別サービス名やコード上の用語ならそのままです。文脈を確認してください。"))
    order = F.array_position(F.array(*[F.lit(s) for s, _ in SERVICES]), F.col("short"))
    return issue(hits, "structure", "aws-first-mention", message, None, True, seq=F.lit(500_000_000) + order)
