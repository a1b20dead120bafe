"""Divergence of sources: how differently the sources of a language use its terms.

Documents are counted where they lie: a task adds up the terms of its texts by (lang, source) and passes sums on, a row for each (lang, term), when it
holds ``HELD`` counts. The sums are dealt to shards by a hash of (lang, term), each shard in the order of that hash. A shard runs DuckDB over ``RUN`` rows at a time:
vectorised SQL keeps the terms in at least ``LEAST`` documents of the language (the rows of the last hash wait for what follows), adds up
their counts, and gives a row a term with its count in every source that has it. Spark adds up the totals of groups and languages.
Then DuckDB turns slices of those rows into the groups' probabilities, for the partial sums of |p - q| of every pair of sources and the ``TOP`` terms of every
group; Spark adds the partial sums, merges the best terms and ranks. All arithmetic is on integers, wide where a product needs it.

Groups go to the tasks in blocks of ``BLOCK`` as (lang, source, total, V); a pair of blocks is one pass, so a corpus with any
number of sources is held in pieces. A hot term costs a shard one row a task and source, added up as they stream by; terms of one hash stay together.

Edge cases: null text, lang and source are empty strings; an empty text has no terms, but its group exists; a language without kept terms
has its pairs with value 0; a language of one source has no pairs; equal values go by item in UTF-8 order; repeated rows are documents of
their own; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hondana.llm import scratch

LEAST = 30
TOP = 50
#: Terms that a counting task holds before it passes their sums on.
HELD = 500_000
#: Rows of a batch that a task passes on, and that a shard hands to DuckDB at once.
ROWS = 20_000
RUN = 200_000
#: Groups of a pass; pairs of them that a slice of terms makes at most.
BLOCK = 4096
PAIRS = 4_000_000

#: Bytes that are in no term become spaces, A-Z becomes a-z; bytes of letters beyond ASCII stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_HELD = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
_SUMS = pa.schema([("hash", pa.int64()), ("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("held", _HELD)])
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("held", _HELD)])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _engine():
    """A DuckDB of this task alone, in memory."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": False})


def _rows(engine, sql: str, schema: pa.Schema, **tables: pa.Table) -> list[pa.RecordBatch]:
    for name, table in tables.items():
        engine.register(name, table)
    found = engine.sql(sql).to_arrow_table()
    for name in tables:
        engine.unregister(name)
    return found.cast(schema).combine_chunks().to_batches()


def _counted(held: int):
    """A row for each (lang, term) of the texts of a task: in how many of them it is, and its count in every source that has it."""
    kind = pa.schema([f for f in _SUMS if f.name != "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        docs: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, of_source in count.items():
                found, sources = docs[lang], list(of_source)
                number = dict(zip(found, range(len(found))))
                at = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int32, len(c)) for c in of_source.values()])
                n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in of_source.values()])
                order = np.argsort(at, kind="stable")
                which = np.repeat(np.arange(len(sources)), [len(c) for c in of_source.values()])[order]
                parts = [pa.array(sources, pa.string()).take(pa.array(which)), pa.array(n[order])]
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(found)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["source", "n"]))
                names = pa.array([t.decode("utf-8", "replace") for t in found], pa.string())
                whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(found)), names, pa.array(list(found.values()), pa.int64()), lists], schema=kind)
                yield from (whole.slice(k, ROWS) for k in range(0, len(found), ROWS))
            count.clear()
            docs.clear()

        most = 0  # entries at most
        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = terms(text.as_py())
                if found:
                    once = set(found)
                    count[lang][source].update(found)
                    docs[lang].update(once)
                    most += len(once)
                if most > held:
                    most = sum(len(c) for of_source in count.values() for c in of_source.values())
                    if most > 0.75 * held:
                        yield from out()
                        most = 0
        yield from out()

    return run


_ADDED = """
WITH c AS (SELECT hash, lang, term, h.source AS source, sum(h.n)::BIGINT AS n FROM (SELECT hash, lang, term, unnest(held) AS h FROM part) GROUP BY ALL),
l AS (SELECT hash, lang, term, list({'source': source, 'n': n}) AS held FROM c GROUP BY ALL),
d AS (SELECT hash, lang, term, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL)
SELECT hash, lang, term, docs, held FROM d JOIN l USING (hash, lang, term)"""


def _kept_terms(least: int, size: int):
    """Whole terms of a shard, whose rows come in the order of their hash."""
    sql = f"""
    WITH often AS (SELECT lang, term FROM part GROUP BY ALL HAVING sum(docs) >= {least}),
    c AS (SELECT lang, term, h.source AS source, sum(h.n)::BIGINT AS n FROM (SELECT lang, term, unnest(held) AS h FROM part SEMI JOIN often USING (lang, term)) GROUP BY ALL)
    SELECT lang, term, list({{'source': source, 'n': n}} ORDER BY source) AS held FROM c GROUP BY lang, term"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, waiting, rows = _engine(), [], 0

        def cut() -> tuple[pa.Table, pa.Table]:
            """Rows of whole terms, and those of the last hash."""
            whole = pa.Table.from_batches(waiting, _SUMS)
            hashes = whole["hash"].to_numpy()
            at = int((hashes != hashes[-1]).nonzero()[0][-1]) + 1 if hashes[0] != hashes[-1] else 0
            return whole.slice(0, at), whole.slice(at)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch.select(_SUMS.names).cast(_SUMS))
                rows += batch.num_rows
            if rows >= size:
                whole, last = cut()
                if whole.num_rows:
                    yield from _rows(engine, sql, _KEPT, part=whole)
                waiting = _rows(engine, _ADDED, _SUMS, part=last)
                rows = sum(x.num_rows for x in waiting)
                rows = 0 if rows >= size else rows  # a term of very many sources: added up again after as many rows
        if waiting:
            yield from _rows(engine, sql, _KEPT, part=pa.Table.from_batches(waiting, _SUMS))
        engine.close()

    return run


#: p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in integers of 128 bits.
_P = "(1 + (1000000000::HUGEINT * ({count} + 5)) // (total + 5 * v))::BIGINT"

_GRID = f"""
WITH t AS (SELECT row_number() OVER () AS r, lang, term, held FROM part),
c AS (SELECT r, lang, term, h.source AS source, h.n AS n FROM (SELECT r, lang, term, unnest(held) AS h FROM t)),
sides AS (SELECT * FROM left_groups UNION SELECT * FROM right_groups),
p AS (
  SELECT t.r, t.lang, t.term, g.source, coalesce(c.n, 0) AS n, {_P.format(count="coalesce(c.n, 0)")} AS p
  FROM t JOIN sides g ON t.lang = g.lang LEFT JOIN c ON c.r = t.r AND c.source = g.source)
"""

_PAIR_SUMS = f"""{_GRID}
SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
FROM p a SEMI JOIN left_groups g ON a.lang = g.lang AND a.source = g.source
JOIN (SELECT p.* FROM p SEMI JOIN right_groups g ON p.lang = g.lang AND p.source = g.source) b ON a.r = b.r AND a.source < b.source
GROUP BY ALL"""

_BEST_TERMS = f"""{_GRID},
q AS (SELECT t.r, {_P.format(count="list_sum(list_transform(t.held, lambda h: h.n))::HUGEINT")} AS q FROM t JOIN (SELECT DISTINCT lang, lang_total AS total, v FROM left_groups) g ON t.lang = g.lang)
SELECT lang, source, 'term' AS part, term AS item, p - q AS value
FROM p JOIN q ON p.r = q.r WHERE p.n > 0 AND p.p > q.q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p.p - q.q DESC, term) <= {{top}}"""


def _partial(left: list[tuple], right: list[tuple], same: bool, top: int):
    """Partial pair sums between two blocks of groups; the best terms of the first where both are the same."""
    names = ["lang", "source", "total", "lang_total", "v"]
    largest = max(Counter(r[0] for r in {*left, *right}).values())
    step = max(1, 2 * PAIRS // (largest * largest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # DuckDB compares text by its UTF-8 bytes, as Spark does.
        engine = _engine()
        groups = [pa.table([pa.array(c, k) for c, k in zip(zip(*side), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=names) for side in (left, right)]
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = pa.Table.from_batches([batch.slice(at, step)])
                tables = {"part": some, "left_groups": groups[0], "right_groups": groups[1]}
                yield from _rows(engine, _PAIR_SUMS, _FOUND, **tables)
                if same:
                    yield from _rows(engine, _BEST_TERMS.format(top=top), _FOUND, **tables)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long"}
    return ", ".join(f"{f.name} {kinds.get(f.type, 'array<struct<source:string,n:bigint>>')}" for f in schema)


def counted(docs: DataFrame, least: int = LEAST, held: int = HELD, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, held: array of (source, n)) and groups (lang, source, total, lang_total, v)."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    rows = docs.select(text, lang, source)
    sums = rows.mapInArrow(_counted(held), _ddl(pa.schema([f for f in _SUMS if f.name != "hash"])))
    sums = sums.select(F.xxhash64("lang", "term").alias("hash"), "*").repartition("hash").sortWithinPartitions("hash")
    kept = sums.mapInArrow(_kept_terms(least, run), _ddl(_KEPT))
    kept = scratch.write(kept, "terms")
    of_group = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("held", F.lit(0).cast("long"), lambda t, h: t + h.n)).alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return kept, scratch.write(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "v")]), "groups")


def op12_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, held: int = HELD, run: int = RUN) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language by divergence, and the ``top`` terms of every source."""
    spark = docs.sparkSession
    kept, groups = counted(docs, least, held, run)
    path = scratch.folder(spark, "partial")
    spark.createDataFrame([], _ddl(_FOUND)).write.parquet(path)
    for number, left in enumerate(_blocks(groups, block)):
        for other, right in enumerate(_blocks(groups, block)):
            if other >= number and {r[0] for r in left} & {r[0] for r in right}:
                kept.mapInArrow(_partial(left, right, other == number, top), _ddl(_FOUND)).write.mode("append").parquet(path)
    partial = spark.read.schema(_ddl(_FOUND)).parquet(path)
    sums = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(partial.where("part = 'term'").select("*", rank).where(F.col("rank") <= top))


def _blocks(groups: DataFrame, block: int) -> Iterator[list[tuple]]:
    """The groups in order, ``block`` at a time."""
    rows = (tuple(r) for r in groups.orderBy("lang", "source").toLocalIterator())
    while some := list(islice(rows, block)):
        yield some


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 5 * v) AS p FROM grid JOIN sizes USING (lang)),
of_lang AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 5 * v) AS q FROM of_lang JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
