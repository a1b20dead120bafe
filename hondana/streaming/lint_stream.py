"""Lint of documents as they arrive: the checks that need one document at a time, on a stream.

Secrets and the parsed blog lines need no state, so a stream of documents gives a stream of issues. Rules that
compare lines of a document (parity, style counts) run per micro-batch, where each document is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hondana.operators.secrets import check_secrets
from hondana.plans.lint import lint
from hondana.sources.documents import lines


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of documents (doc_id, text) as they appear below ``path``."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def secret_stream(docs: DataFrame) -> DataFrame:
    """A stream of secret issues: no state, no watermark."""
    return check_secrets(lines(docs.select("doc_id", "text")))


def lint_stream(docs: DataFrame, out: str, checkpoint: str, profile: str = "qiita", **options):
    """Start a query that lints each micro-batch and appends its issues to Parquet at ``out``, a folder per batch id, so that a retry replaces what it wrote."""

    def batch(df: DataFrame, number: int) -> None:
        lint(df, profile, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
