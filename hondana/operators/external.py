"""Style check by an external linter: its JSON output as issues, or one skip issue per document without it."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hondana.functions.matching import matches, pattern
from hondana.schema import issue

SKIPPED = "チェックをスキップ"
UNKNOWN = "不明なルール"
NO_LINTER = "外部リンターが見つからないため AI 文体チェックをスキップしました"
BAD_OUTPUT = "外部リンターの出力を読み取れないため AI 文体チェックをスキップしました"
TOO_SLOW = "外部リンターが {} 秒以内に終わらなかったため AI 文体チェックをスキップしました"
NOT_RUN = "外部リンターを実行できなかったため AI 文体チェックをスキップしました: {}"
#: Fixed value: seconds a linter has for one document.
SECONDS = 60
LONGEST_SENTENCE = 80
_REPORTS = "array<variant>"


def skip_issues(docs: DataFrame, message: str | Column = NO_LINTER) -> DataFrame:
    extra = [c for c in ("file", "failure") if c in docs.columns]
    rows = docs.select("doc_id", *extra, F.lit(0).alias("n"), F.lit(0).alias("col"), F.lit("").alias("matched"))
    return issue(rows, "ai_writing", SKIPPED, message)


def runner(command: Sequence[str], configs: Mapping[str, str] | None = None, profile: str = "", seconds: float = SECONDS) -> Callable[[DataFrame], DataFrame]:
    """Runs ``command`` on each document, its text on standard input, and gives (doc_id, json, failure).

    ``{config}`` in the command stands for the configuration of the profile, or that of "" for profiles without one of their own. A linter that isn't there,
    can't be run or takes over ``seconds`` for a document is the document's ``failure``.
    """
    config = (configs or {}).get(profile, (configs or {}).get("", ""))
    words = [w.replace("{config}", config) for w in command]

    def lint_one(text: str | None) -> tuple[str | None, str | None]:
        try:
            done = subprocess.run(words, input=(text or "").encode("utf-8", "surrogatepass"), capture_output=True, timeout=seconds, check=False)
            return done.stdout.decode("utf-8", "replace"), None
        except FileNotFoundError:
            return None, NO_LINTER
        except subprocess.TimeoutExpired:
            return None, TOO_SLOW.format(f"{seconds:g}")
        except OSError as error:
            return None, NOT_RUN.format(error)

    def run(docs: DataFrame) -> DataFrame:
        names = ["doc_id", *[c for c in ("file",) if c in docs.columns]]

        def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):  # a row at a time: a process takes far longer than a batch costs
                    row = batch.slice(k, 1)
                    out, failure = lint_one(row.column(len(names))[0].as_py())
                    yield pa.RecordBatch.from_arrays([*row.columns[: len(names)], pa.array([out], pa.string()), pa.array([failure], pa.string())], [*names, "json", "failure"])

        source = docs.select(*names, F.col("text").cast("string"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(names)])
        return source.mapInArrow(batches_of, f"{kinds}, json string, failure string")

    return run


def json_issues(reports: DataFrame) -> DataFrame:
    """Issues from (doc_id, json and perhaps failure): an array of reports, each with messages.

    Entries that are no objects are left out; places that are no integers are 0. A failure, or a json that is no array, is a skip issue.
    """
    extra = [c for c in ("file",) if c in reports.columns]
    root = F.try_variant_get(F.try_parse_json("json"), "$", _REPORTS)
    failure = F.coalesce("failure", F.lit(BAD_OUTPUT)) if "failure" in reports.columns else F.lit(BAD_OUTPUT)
    read = reports.select("doc_id", *extra, root.alias("root"), failure.alias("failure"))
    bad = skip_issues(read.where("root is null"), F.col("failure"))
    each = read.where("root is not null").select("doc_id", *extra, F.posexplode("root").alias("i", "report"))
    each = each.select("doc_id", *extra, "i", F.posexplode(F.try_variant_get("report", "$.messages", _REPORTS)).alias("j", "m")).where(F.schema_of_variant("m").startswith("OBJECT"))

    def whole(key: str):
        v = F.try_variant_get("m", f"$.{key}", "variant")
        return F.when(F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False)), F.try_variant_get("m", f"$.{key}", "int")).otherwise(F.lit(0))

    def text(key: str):
        v = F.try_variant_get("m", f"$.{key}", "variant")
        return F.when(F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)), F.try_variant_get("m", f"$.{key}", "string"))

    rule = F.coalesce(F.when(text("ruleId") != "", F.substring_index(text("ruleId"), "/", -1)), F.lit(UNKNOWN))
    rows = each.select("doc_id", *extra, whole("line").alias("n"), whole("column").alias("col"), F.lit("").alias("matched"), F.coalesce(text("message"), F.lit("")).alias("message"), rule.alias("rule"), (F.col("i") * 100_000 + F.col("j")).alias("seq"))
    return issue(rows, "ai_writing", F.col("rule"), F.col("message"), seq=F.col("seq")).unionByName(bad)


def check_ai_writing(docs: DataFrame, run: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Issues of category ai_writing. ``run`` turns documents into (doc_id, json and perhaps failure), as :func:`runner` does; without one each document gets a skip issue."""
    return skip_issues(docs) if run is None else json_issues(run(docs))


def long_sentences(lines: DataFrame, most: int = LONGEST_SENTENCE) -> DataFrame:
    """Sentences of over ``most`` characters: doc_id, n, col, size."""
    from hondana.operators.style import SENTENCE

    return matches(lines, pattern(SENTENCE), "line", ("doc_id", "n")).select("doc_id", "n", "col", F.length("matched").alias("size")).where(F.col("size") > most)
