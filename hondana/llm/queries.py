"""The operators applied with production parameters to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hondana.llm import op2_tools, op9_topk, op10_mix, op11_multi_index, op12_divergence, op13_lloyd
from hondana.llm.op1_rans import op1_rans
from hondana.llm.op3_toxicity import op3_toxicity
from hondana.llm.op4_language import op4_language
from hondana.llm.op5_simhash import op5_simhash
from hondana.llm.op6_decontaminate import op6_decontaminate
from hondana.llm.op7_quality import op7_quality
from hondana.llm.op8_pseudolikelihood import op8_pseudolikelihood


def _table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_rans(_table("documents", spark, sf_dir))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = op2_tools.conversation_view(_table("conversations", spark, sf_dir))
    return op2_tools.op2_tools(calls, results, op2_tools.VIEW_SCHEMAS, unnamed=True)


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_toxicity(_table("documents", spark, sf_dir), _table("labels", spark, sf_dir))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_language(_table("documents", spark, sf_dir))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_simhash(_table("documents", spark, sf_dir))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_decontaminate(_table("documents", spark, sf_dir), _table("benchmark", spark, sf_dir))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality(_table("documents", spark, sf_dir), _table("labels", spark, sf_dir))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pseudolikelihood(_table("documents", spark, sf_dir))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_topk.op9_topk(_table("embeddings", spark, sf_dir))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mix.op10_mix(_table("documents", spark, sf_dir))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_multi_index.op11_multi_index(_table("embeddings", spark, sf_dir))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_divergence.op12_divergence(_table("documents", spark, sf_dir))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_lloyd.op13_lloyd(_table("embeddings", spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rans": _op1,
    "op2_tools": _op2,
    "op3_toxicity": _op3,
    "op4_language": _op4,
    "op5_simhash": _op5,
    "op6_decontaminate": _op6,
    "op7_quality": _op7,
    "op8_pseudolikelihood": _op8,
    "op9_topk": _op9,
    "op10_mix": _op10,
    "op11_multi_index": _op11,
    "op12_divergence": _op12,
    "op13_lloyd": _op13,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_tools": op2_tools.SQL,
    "op9_topk": op9_topk.SQL,
    "op10_mix": op10_mix.SQL,
    "op11_multi_index": op11_multi_index.SQL,
    "op12_divergence": op12_divergence.SQL,
    "op13_lloyd": op13_lloyd.SQL,
}
