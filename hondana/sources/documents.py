"""Documents, lines and vocabularies as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First path parts that a vault scan takes, and parts anywhere that it leaves out (fixed values).
VAULT_ROOTS = ("wiki", "worklog", "reports", "projects", "docs")
VAULT_EXCLUDED = ("raw", ".obsidian", ".claude")

#: A line end of Python's ``str.splitlines``.
LOGICAL_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"

def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, text of every file below ``path``, each a whole document."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """doc_id, text of texts in memory."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_vault(path: Column) -> Column:
    """Whether a vault scan takes a path relative to the vault's root."""
    parts = F.split(path, "/")
    return path.endswith(".md") & (F.size(parts) >= 2) & F.element_at(parts, 1).isin(*VAULT_ROOTS) & ~F.arrays_overlap(parts, F.array(*map(F.lit, VAULT_EXCLUDED)))


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to ``root``), text of the notes that a vault scan takes, pruned before texts are used."""
    files = read_files(spark, root, "*.md")
    return files.withColumn("path", relative(F.col("path"), root)).where(in_vault(F.col("path")))


def relative(path: Column, root: str) -> Column:
    """``path`` without ``root`` before it, whatever scheme and host either names; a path outside of it as it is."""
    plain = F.regexp_replace(path, _SCHEME, "")
    below = re.sub(_SCHEME, "", root).rstrip("/") + "/"
    return F.when(plain.startswith(below), F.substring(plain, len(below) + 1, 2_000_000_000)).otherwise(path)


def vocabulary(lines: DataFrame) -> DataFrame:
    """tag: distinct trimmed entries of lines (column value); blank lines and comments are skipped."""
    tag = F.regexp_replace("value", "(?U)^\\s+|\\s+$", "")
    return lines.select(tag.alias("tag")).where((F.col("tag") != "") & ~F.col("tag").startswith("#")).distinct()


def read_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """The tag vocabulary of a vault; reading fails if there is none."""
    return vocabulary(spark.read.text(f"{root}/.claude/tag-vocabulary.txt"))


def lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, n (from 1) and line: the text split at \\n; trailing empty lines stay."""
    return docs.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def logical_lines(text: Column) -> Column:
    """The lines of ``str.splitlines``: a last line end opens no line."""
    parts = F.split(text, LOGICAL_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
