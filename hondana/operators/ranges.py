"""Ranges of text: half-open, in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAW_URL = "(?i:https?://|www\\.)[^\\s<>\"'。、！？）」』】〉》()\\[\\]{}]*[^\\s<>\"'。、！？）」』】〉》()\\[\\]{}.,;:!?]"


def merge(ranges: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ranges (``keys``, start, end) without overlap: overlapping and adjacent ones become one, empty ones go."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = ranges.where("start < end").withColumn("opens", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    island = opens.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlaps(start: Column, end: Column, ranges: Column) -> Column:
    """Whether [start, end) meets one of an array of ranges."""
    return F.exists(ranges, lambda r: (start < r["end"]) & (r["start"] < end))


def line_offsets(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, n, line) with the 0-based offset of each line's start."""
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def front_matter_lines(text: Column) -> Column:
    """Number of lines of closed front matter at the head of a text; 0 without."""
    lines = F.transform(F.split(F.regexp_replace(text, "^\ufeff", ""), "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    close = F.array_position(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.isin("---", "...")), True)
    return F.when((lines[0] == "---") & (close > 0), close + 1).otherwise(F.lit(0))


def top_level_fences(docs: DataFrame) -> DataFrame:
    """doc_id, n, kind (open, code, close) of lines of top-level fenced code, by a state carried from line to line."""
    lines = F.split("text", "\n", -1)
    rx = "^ {0,3}(`{3,}|~{3,})"
    state = "struct<mark:string,out:array<string>>"

    def step(a: Column, x: Column) -> Column:
        mark = F.regexp_extract(x, rx, 1)
        info = F.regexp_replace(x, rx, "")
        opens = (mark != "") & ~(mark.startswith("`") & F.contains(info, F.lit("`")))
        closes = (mark != "") & F.startswith(mark, a["mark"]) & ~info.rlike("[^ \\t\\r]")
        inside = a["mark"] != ""
        kind = F.when(inside & closes, "close").when(inside, "code").when(opens, "open")
        after = F.when(inside & closes, "").when(inside, a["mark"]).when(opens, mark).otherwise("")
        return F.struct(after.alias("mark"), F.concat(a["out"], F.array(kind)).alias("out")).cast(state)

    start = F.struct(F.lit("").alias("mark"), F.array().cast("array<string>").alias("out")).cast(state)
    kinds = F.aggregate(lines, start, step)["out"]
    return docs.select("doc_id", F.posexplode(kinds).alias("n", "kind")).withColumn("n", F.col("n") + 1).where("kind is not null")
