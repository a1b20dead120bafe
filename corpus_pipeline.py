"""From raw documents to encoded training data: five stages, each one operator of ``hondana.llm``.

1. ``toxicity``: documents that the string-kernel machine predicts toxic go.
2. ``near_duplicates``: of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the one with the smallest
   doc_id stays, the first by its columns where several rows have it. Pairs come from SimHash fingerprints, by segment counts and their grid; an exact
   check on the shingles follows, which measures them and finds what differs in more bits.
3. ``decontamination``: documents that hold an item of ``benchmark``, edits included, go.
4. ``mixing``: documents come as many times as the mix of sources takes them.
5. ``token_ids``: documents become ids in the binary format; the result is what the file holds per document.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next stage's ``docs``.
All but the last return the columns of ``documents``. Scratch tables of a stage are deleted when the next one
starts, as its result is written by then; tables that anything else made in the session stay, as does the file of ids.

Edge cases: those of the operators; null texts and null doc_ids pass the filters as empty texts and as documents of
their own kind; rows with equal doc_id and text are copies of each other; ties go by doc_id, then text; texts of any length are read
whole; empty tables give an empty result with the same columns; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hondana.llm import op3_toxicity, op5_simhash, op6_decontaminate, op10_mix, scratch
from hondana.llm.op1_rans import op1_rans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE = 5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _owned(stage: Stage) -> Stage:
    """Scratch tables of the stage before go, and its own belong to it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release("stage")
        with scratch.owner("stage"):
            return stage(spark, docs, sf_dir)

    return run_stage


def _columns(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in COLUMNS if c in docs.columns)


@_owned
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not predicted toxic."""
    model = op3_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = _columns(docs)
    rows = op3_toxicity.scored(docs, model, keep=names)
    return rows.where("predicted = 0").select(*[F.col(f"kept_{c}").alias(c) for c in names])


@_owned
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group."""
    return op5_simhash.first_of_groups(docs.select(*_columns(docs)), SHINGLE)


@_owned
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no benchmark item appears."""
    return op6_decontaminate.clean(docs.select(*_columns(docs)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_owned
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return op10_mix.mixed(docs.select(*_columns(docs)))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode all documents; doc_id, start, n_tokens, ids_crc32 as the file has them. The file is the result's, not the stage's."""
    scratch.release("stage")
    return op1_rans(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: No SQL: the string-kernel machine has none. The stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with scratch.owner(f"after {name}"):
                docs = scratch.write(docs, name)
        if k:
            scratch.release(f"after {STAGES[k - 1][0]}")
    return docs
