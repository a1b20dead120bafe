"""Labelled rows for classifiers: folds by CRC-32 of doc_id and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(parts: int) -> Column:
    """crc32(doc_id as text) modulo ``parts``; a null doc_id counts as empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts).cast("int")


def sample(labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label of at most ``most`` labelled documents per class outside the held-out fold, and how many there are of each class.

    A document labelled more than once counts with its highest label. The choice goes by digest of doc_id, so reruns agree.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(parts) != held_out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return chosen[0].unionByName(chosen[1]), counts
