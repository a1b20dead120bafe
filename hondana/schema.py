"""Types shared by all checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hondana.functions.matching import Probe, rule_matches

#: The result relation. ``seq`` keeps the order in which a document's checks emit issues with equal places.
ISSUES = (
    "doc_id long, file string, line_number int, column int, matched_text string, category string, rule_name string, "
    "message string, suggestion string, needs_review boolean, seq long"
)
ISSUE_COLUMNS = ["doc_id", "file", "line_number", "column", "matched_text", "category", "rule_name", "message", "suggestion", "needs_review", "seq"]
#: Order of checks, and of categories in reports.
CHECKS = ("secrets", "notation", "ai_writing", "blog_style", "blog_structure", "frontmatter")
CATEGORIES = ("secret", "notation", "ai_writing", "style", "structure", "frontmatter")
RANGES = "array<struct<start:int,end:int>>"


def text_column(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def issue(
    df: DataFrame, category: Column | str, rule: Column | str, message: Column | str, suggestion: Column | str | None = "", review: Column | bool = False,
    line: str = "n", column: str = "col", matched: str = "matched", seq: Column | int = 0,
) -> DataFrame:
    """Rows of ``df`` as issues; an issue for review has no suggestion."""
    needs_review = F.lit(review) if isinstance(review, bool) else review
    given = F.lit(None).cast("string") if suggestion is None else text_column(suggestion)
    file = F.col("file") if "file" in df.columns else F.lit("")
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), file.alias("file"), F.col(line).cast("int").alias("line_number"), F.col(column).cast("int").alias("column"), F.col(matched).alias("matched_text"),
        text_column(category).alias("category"), text_column(rule).alias("rule_name"), text_column(message).alias("message"), F.when(~needs_review, given).alias("suggestion"), needs_review.alias("needs_review"),
        (F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("seq"),
    )


@dataclass(frozen=True)
class Family:
    """Rules that share how their matches become issues.

    ``made`` gives, for the number of the probe, columns by name: rule, message, seq and, if not the usual ones, suggestion (null: none), review, col, matched and
    ``kept`` (false: no issue).
    """

    check: str
    category: str
    probes: tuple[Probe, ...]
    made: Callable[[Column], dict[str, Column]]


def line_issues(lines: DataFrame, families: list[Family], ordered: bool = False) -> DataFrame:
    """Issues of all ``families`` in one pass over ``lines``; ``ordered``: ``seq`` counts from where that of the family's check begins."""
    hits = rule_matches(lines, [p for f in families for p in f.probes])
    usual = {"suggestion": F.lit(""), "review": F.lit(False), "col": F.col("col"), "matched": F.col("matched"), "kept": F.lit(True)}
    merged: dict[str, Column] = {}
    end = sum(len(f.probes) for f in families)
    for f in reversed(families):  # the last family's columns are what is left
        first = end - len(f.probes)
        own = usual | f.made(F.col("variant") - first) | {"category": F.lit(f.category)}
        own["seq"] = F.lit(CHECKS.index(f.check) * 1_000_000_000_000 if ordered else 0).cast("long") + own["seq"]
        merged = {k: F.when(F.col("variant") < end, v).otherwise(merged[k]) if merged else v for k, v in own.items()}
        end = first
    found = hits.where(merged["kept"]).withColumns({"_col": merged["col"], "_matched": merged["matched"]})
    return issue(found, merged["category"], merged["rule"], merged["message"], merged["suggestion"], merged["review"], column="_col", matched="_matched", seq=merged["seq"])
