"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Every source gets a target of words. Within a source, longer documents weigh more: a document's weight is the number of
binary digits of its size, and its expected number of copies is in proportion to that, ``MOST_COPIES`` at most, so that the expected words
are the target. The whole part of the expected copies is taken for certain; the rest p, which differs
by size class, is the inclusion probability of one more copy. Documents are ranked by
random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and each source takes the first
ones up to a fixed size in words: the prefix whose words come nearest to what its whole copies leave of
the target. The random number u is a digest of seed, doc_id and text, so that reruns agree.

A source may hold a third of all rows. So no window runs over a source: ranks are cut to ``BUCKETS``
ranges, sizes are summed by source and range (partial sums before the shuffle), running totals are
taken over ranges, and only in the one range of each source where the prefix ends are distinct documents sorted. What comes of it, a row for
each source and size class, is joined to the documents, whose texts never move. Words are counted once, into a table without texts.

Edge cases: a null text has size 0 and is never taken; a source of size 0 has target 0; null is a source
of its own, the last one; rows alike in doc_id and text have one rank, and where the prefix ends among them as many as fit are
taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hondana.llm import scratch

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
BUCKETS = 4096
SEED = 17


def words(text: Column) -> Column:
    """Number of runs of bytes other than space and x09 to x0D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with size, digits (binary ones of the size: the size class and weight) and digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.withColumns({"_size": words(F.col("text")), "_digest": digest}).withColumn("_digits", F.length(F.bin("_size")))


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, from 0, in order of source: a distributed sort, and counts of its partitions."""
    near = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = scratch.write(sizes.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("_part"), near.alias("_near")), "sources")
    before, starts = 0, []
    for r in rows.groupBy("_part").count().orderBy("_part").collect():  # as many rows as partitions
        starts.append((r["_part"], before))
        before += r["count"]
    starts = sizes.sparkSession.createDataFrame(starts, "_part int, _before long")
    return rows.join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + F.col("_near")).drop("_part", "_near", "_before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size -> with ``target``: shares of all words by weight, none above ``most`` times its size.

    Sources in order of code point, null last, weigh ``weights`` in turn. Sources whose cap is below their share are capped
    and the rest is shared anew, until none is above: a few sums over the table of sources each time.
    """
    given = _numbered(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    given = scratch.write(given.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double")), "given")
    free, level = F.lit(True), None
    while True:
        capped = F.when(~free, F.col("cap")), F.when(~free, F.col("weight"))
        total, cap, weight, gone, n = given.agg(F.sum("source_size"), F.coalesce(F.sum(capped[0]), F.lit(0.0)), F.sum("weight"), F.coalesce(F.sum(capped[1]), F.lit(0.0)), F.count_if(~free)).first()
        if not weight or weight == gone or (level is not None and n == before):
            break
        level, before = (total - cap) / (weight - gone), n
        free = F.lit(level) * F.col("weight") <= F.col("cap")
    share = F.col("cap") if level is None else F.lit(level) * F.col("weight")
    return given.select("source", "source_size", F.least("cap", share).alias("target"))


def shares(classes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, digits, source_size, target, whole, p, rest of every size class; ``rest``: the source's words beside whole copies.

    ``classes``: source, digits, words: at most 63 rows a source.
    """
    rows = classes.alias("c").join(targets.withColumnRenamed("source", "of").alias("t"), F.expr("c.source <=> t.of")).drop("of")
    every = Window.partitionBy("source")
    before = every.orderBy(F.col("digits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = F.col("digits") * F.col("words")
    level = (F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(before), F.lit(0))) / (F.sum(weighed).over(every) - F.coalesce(F.sum(weighed).over(before), F.lit(0))).cast("double")
    rows = rows.withColumn("level", F.when(F.col("words") > 0, level))
    fits = F.when(F.col("level") * F.col("digits") <= most, F.struct("digits", "level"))
    rows = rows.withColumn("level", F.max(fits).over(every)["level"])
    rows = rows.withColumn("expected", F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("digits"), F.lit(float(most)))))
    rows = rows.withColumn("whole", F.when(F.col("target") > 0, F.floor("expected")).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every))
    return rows.select("source", "digits", "source_size", "target", "whole", F.when(F.col("target") > 0, F.col("expected") - F.col("whole")).otherwise(F.lit(0.0)).alias("p"), "rest")


def _ranked(rows: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with the columns of ``known`` (one row a source and size class), and ``_rank`` and ``_bucket`` of those that may get one more copy."""
    names = [c for c in known.columns if c not in ("source", "digits")]
    given = known.select(F.col("source").alias("_of"), F.col("digits").alias("_at"), *[F.col(c).alias(f"_{c}") for c in names])
    # A small table that was written: Spark broadcasts it below its own threshold, else joins by shuffle and splits hot keys.
    joined = rows.alias("d").join(given.alias("t"), F.expr("d.source <=> t._of and d._digits = t._at")).drop("_of", "_at")
    p = F.least(F.greatest(F.col("_p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    u = (F.conv(F.substring("_digest", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (p / (1 - p))
    rank = F.when((F.col("_p") > 0) & (F.col("_rest") > 0) & (F.col("_size") > 0), odds / (1 + odds))
    return joined.withColumn("_rank", rank).withColumn("_bucket", F.floor(F.col("_rank") * buckets))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, buckets: int = BUCKETS) -> DataFrame:
    """What decides for every document of ``rows`` (source, _size, _digits, _digest): one row a source and size class.

    With the columns of :func:`shares`, last (the range where the source's prefix ends), and of the last document in it rank, digest, and
    how many (``taken``) of the ``alike`` rows of it.
    """
    classes = scratch.write(rows.groupBy("source", F.col("_digits").alias("digits")).agg(F.sum("_size").alias("words")), "classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    known = scratch.write(shares(classes, targets, most), "shares")
    ranked = _ranked(rows, known, buckets)
    sums = ranked.where("_bucket is not null").groupBy("source", "_bucket").agg(F.sum("_size").alias("words"), F.first("_rest").alias("rest"))
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).where("before < rest")
    ends = ends.groupBy("source").agg(F.max(F.struct("_bucket", "before")).alias("last")).select(F.col("source").alias("of"), F.col("last._bucket").alias("last"), F.col("last.before").alias("before"))
    ends = scratch.write(ends, "ends")
    inside = ranked.alias("r").join(ends.alias("e"), F.expr("r.source <=> e.of and r._bucket = e.last"))
    alike = inside.groupBy("of", "last", "before", "_rest", F.col("_rank").alias("rank"), F.col("_digest").alias("digest"), F.col("_size").alias("size")).agg(F.count(F.lit(1)).alias("alike"))
    ordered = Window.partitionBy("of").orderBy("rank", "digest").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("alike")).over(ordered), F.lit(0))
    room = F.floor((F.col("_rest") - F.col("start") - F.col("size") / 2) / F.col("size")) + 1
    fits = F.when(F.col("alike") == 1, (F.col("start") + F.col("size") / 2 <= F.col("_rest")).cast("long")).otherwise(F.least(F.greatest(room, F.lit(0)), F.col("alike")))
    cuts = alike.withColumn("start", start).withColumn("taken", fits).where("taken > 0").groupBy("of").agg(F.max(F.struct(F.col("rank").alias("cut_rank"), F.col("digest").alias("cut_digest"), "taken", "alike")).alias("cut"))
    ends = ends.drop("before").alias("e").join(cuts.withColumnRenamed("of", "_of").alias("c"), F.expr("e.of <=> c._of"), "left").select("of", "last", "cut.*")
    out = known.alias("k").join(ends.alias("e"), F.expr("k.source <=> e.of"), "left").drop("of")
    return scratch.write(out, "plan")


def decided(rows: DataFrame, known: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` (see :func:`plan`) with _copies, _source_size and _target; no row moves but such as are alike where a prefix ends among them."""
    ranked = _ranked(rows, known, buckets)
    own, cut = F.struct(F.col("_rank").alias("r"), F.col("_digest").alias("d")), F.struct(F.col("_cut_rank").alias("r"), F.col("_cut_digest").alias("d"))
    inside = F.when(F.col("_cut_rank").isNull() | (own > cut), 0).when((own < cut) | (F.col("_taken") == F.col("_alike")), 1)  # null: some of the rows alike
    more = F.when(F.col("_bucket").isNull() | F.col("_last").isNull() | (F.col("_bucket") > F.col("_last")), 0).when(F.col("_bucket") < F.col("_last"), 1).otherwise(inside)
    names = [*rows.columns, "_source_size", "_target"]
    marked = ranked.withColumn("_more", more)
    sure = marked.where("_more is not null").select(*names, F.when(F.col("_size") > 0, F.col("_whole") + F.col("_more")).otherwise(0).cast("long").alias("_copies"))
    if not known.where("taken < alike").take(1):  # no source's prefix ends among rows alike
        return sure
    # Rows alike are numbered by partition: counts of partitions first, then places within each.
    some = scratch.write(marked.where("_more is null").withColumn("_part", F.spark_partition_id()), "alike")
    running = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = some.groupBy("source", "_part").count().select(F.col("source").alias("_of"), F.col("_part").alias("_at"), F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_before"))
    placed = some.alias("s").join(counts.alias("n"), F.expr("s.source <=> n._of and s._part = n._at"))
    k = F.col("_before") + F.row_number().over(Window.partitionBy("source", "_part").orderBy("_digest"))
    return sure.unionByName(placed.select(*names, (F.col("_whole") + (k <= F.col("_taken")).cast("long")).alias("_copies")))


def op10_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row of ``docs``."""
    rows = scratch.write(sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "sized")
    got = decided(rows, plan(rows, weights, most, buckets), buckets)
    return got.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs``, with all its columns, as often as the mix takes it."""
    rows = scratch.write(sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "sized")
    names = docs.columns
    got = decided(sized(docs, seed), plan(rows, weights, most, buckets), buckets)
    return got.where("_copies > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")


#: The same sample in DuckDB SQL: the digest, order and cut of the DataFrame form, without its ranges.
SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digest
  FROM documents),
given AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
         ((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM given WINDOW w AS (ORDER BY cap / weight, source COLLATE C NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT l.source, source_size, least(cap, coalesce(c.level * weight, cap)) AS target FROM levels l, common c),
classes AS (
  SELECT source, length(bin(size)) AS digits, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL),
filled AS (
  SELECT c.*, t.source_size, t.target,
         CASE WHEN words > 0 THEN (t.target - 3 * coalesce(sum(words) OVER w, 0)) / CAST(sum(digits * words) OVER (PARTITION BY c.source) - coalesce(sum(digits * words) OVER w, 0) AS DOUBLE) END AS level
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
  WINDOW w AS (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per_source AS (SELECT source, arg_max(level, digits) AS level FROM filled WHERE level * digits <= 3 GROUP BY source),
expected AS (
  SELECT f.source, digits, words, source_size, target, least(3.0::DOUBLE, coalesce(s.level * digits, 3.0::DOUBLE)) AS expected
  FROM filled f LEFT JOIN per_source s ON f.source IS NOT DISTINCT FROM s.source),
split AS (
  SELECT *, CASE WHEN target > 0 THEN floor(expected)::BIGINT ELSE 0 END AS whole FROM expected),
shares AS (
  SELECT *, CASE WHEN target > 0 THEN expected - whole ELSE 0 END AS p, target - sum(whole * words) OVER (PARTITION BY source) AS rest FROM split),
rated AS (
  SELECT d.doc_id, d.size, d.digest, d.source, s.source_size, s.target, s.whole, s.p AS odds_of, s.rest,
         (CAST('0x' || substr(digest, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u,
         least(greatest(s.p, 1e-12), 1 - 1e-12) AS p
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source AND length(bin(d.size)) = s.digits),
ranked AS (
  SELECT *, odds_of > 0 AND rest > 0 AND size > 0 AS is_open, (u / (1 - u)) / (p / (1 - p)) AS odds FROM rated),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN is_open THEN size ELSE 0 END) OVER (
           PARTITION BY source ORDER BY is_open DESC, odds / (1 + odds), digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE whole END + CASE WHEN is_open AND before + size / 2 <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST((whole + CASE WHEN is_open AND before + size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""
