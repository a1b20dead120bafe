"""SimHash near-duplicates by segment-popcount embedding.

Every text gets a 64-bit fingerprint. Rows with one fingerprint collapse first, so that copies cost
nothing later. A fingerprint maps to the bit counts of its 32 two-bit segments. One changed bit changes
one count by one, so the Manhattan distance of two such vectors is a lower bound of the Hamming distance. The range join under that
distance goes by a grid: the segments form ``GROUPS`` groups, at most two of which two changed bits can touch, so two
vectors within the range agree in all but two groups. Every choice of groups to agree on is a cell, and a
fingerprint lies in one cell of each (28 of 24 segments); hits must pass the bound over all
segments, then the exact Hamming distance. A cell of 24 segments holds a share of about 6e-11 of even fingerprints, so cells stay small
up to some 10^10 of them.

Only clusters of many fingerprints a few bits apart crowd a cell. One that holds more than ``DENSE`` isn't expanded into pairs: its
fingerprints are linked through common neighbours instead: two values differ in at most two bits if and only if
some value is within one bit of both, so each one joins the groups of its 65 such values, which is exact as well.

Components are found on distinct fingerprints by alternating large-star and small-star steps; lineage is cut
by tables in the shared folder, and nothing but sums reaches the driver: joins are by sort and merge, see :func:`_meet`.

Edge cases: a null text counts as empty; texts without words have fingerprint zero, which links like any
other; fewer than three words give one shingle of all of them; component_id is the smallest doc_id, null only where all of a
component's are; repeated rows come out once each; an empty table gives no rows; texts of any length are hashed whole; a bit that exactly half of the hashes have is not set; other columns are ignored unless kept by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hondana.llm import scratch

SHINGLE = 3
SEED = 42
MOST_BITS = 2
GROUPS = 8
DENSE = 64
#: For :func:`similar`: shingles that a task packs before it passes them on.
PACK = 500_000


def hashes_of(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    line, ends, at = b" ".join(words), [], 0
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *ends[:-1]]
    if len(words) <= shingle:
        return [xxh64_intdigest(line, SEED)]
    return [xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])]


def majority(hashes: list[int] | np.ndarray) -> int:
    """Bit b is set if over half of the hashes have it; zero for none."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for k in range(0, n, 8192):
        bits = np.unpackbits(np.array(hashes[k : k + 8192], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(hashes_of(text, shingle))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and the columns ``keep``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), *batch.columns[2:]], names)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    names = ["doc_id", "fp", *keep]
    schema = "doc_id long, fp long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return source.mapInArrow(hashed, schema)


def _counts(fp: Column, half: int) -> Column:
    """The counts of the 16 segments of one half, two bits for each: bit pairs added in place."""
    bits, low = F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0x55555555)
    return bits.bitwiseAND(low) + F.shiftrightunsigned(bits, 1).bitwiseAND(low)


def _cells(fp: Column, groups: int = GROUPS) -> Column:
    """array<struct<choice,cell>>: for every choice of two groups to leave out, the counts of all other groups."""
    width = 64 // groups
    counts = _counts(fp, 0).bitwiseOR(F.shiftleft(_counts(fp, 1), 32))
    out = []
    for number, gone in enumerate(combinations(range(groups), MOST_BITS)):
        mask = sum(((1 << width) - 1) << (width * g) for g in range(groups) if g not in gone)
        out.append(F.struct(F.lit(number).alias("choice"), counts.bitwiseAND(F.lit(_signed(mask))).alias("cell")))
    return F.array(*out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def manhattan(x: Column, y: Column) -> Column:
    """Distance of the count vectors of two fingerprints: |a - b| of counts 0 to 2 by masks of those >= 1 and those = 2."""
    total, low = F.lit(0), F.lit(0x55555555)
    for half in (0, 1):
        a, b = _counts(x, half), _counts(y, half)
        a2, b2 = F.shiftrightunsigned(a, 1).bitwiseAND(low), F.shiftrightunsigned(b, 1).bitwiseAND(low)
        a1, b1 = a2.bitwiseOR(a.bitwiseAND(low)), b2.bitwiseOR(b.bitwiseAND(low))
        total = total + F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))
    return total


def _meet(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """The join of two tables that both grow with the input, by sort and merge. Spark takes what a generator makes of a row for one row, and a compressed file's size for a table's, so left to itself it broadcasts, through the driver, what is many times its threshold."""
    return left.join(right.hint("merge"), on, how)


def links(values: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between values (column fp, distinct) whose graph has the components of Hamming distance at most 2."""
    cells = values.select("fp", F.explode(_cells(F.col("fp"))).alias("at")).select("fp", "at.*")
    sizes = cells.groupBy("choice", "cell").count().where("count > 1")
    shared = scratch.write(_meet(cells, sizes, ["choice", "cell"]), "cells")  # most fingerprints are alone in their cells
    a, b = shared.where(F.col("count") <= dense).alias("a"), shared.alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    near = (manhattan(x, y) <= MOST_BITS) & (F.bit_count(x.bitwiseXOR(y)) <= MOST_BITS)
    pairs = _meet(a, b, F.expr("a.choice = b.choice and a.cell = b.cell and a.fp > b.fp") & near).select(x.alias("a"), y.alias("b"))
    inside = shared.where(F.col("count") > dense).select("fp").distinct()
    if not inside.take(1):
        return pairs
    near_values = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    around = inside.select("fp", F.explode(near_values).alias("point"))
    least = around.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = _meet(around, least, "point").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def _sum(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes: equal for equal sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b).

    Large-star links every larger neighbour of a node to the least of it and its neighbours, small-star every smaller one; both keep components. Together they end, in about log(n) rounds, in stars.
    A star's centre has many edges but one row of ``least``, so the join on it splits like any hot key.
    """
    edges = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _sum(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = _meet(both, least, F.col("a") == F.col("node")).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        lower = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = _meet(large, lower, F.col("a") == F.col("node"))
        small = small.select(F.col("a"), F.col("m").alias("b")).union(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = scratch.write(small, "edges")
        scratch.drop(edges)
        edges, was, before = after, before, _sum(after)
        if was == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, keep: tuple[str, ...] = (), shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """doc_id, fp, component_id, rows (of the component) and the columns ``keep``, one row for each of ``docs``."""
    fps = scratch.write(fingerprints(docs, keep, shingle), "fingerprints")
    values = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "values")
    roots = components(links(values.select("fp"), dense))
    rooted = _meet(values, roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"))
    named = _meet(rooted, of_root, "root").select("fp", "component_id", "rows")
    return _meet(fps, named, "fp")


def _words_key(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), SEED)


def keyed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (of the sequence of words), words (how many), fp (the fingerprint's bits) of every row."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, fps = [], [], []
            for x in batch.column(1):
                text = x.as_py()
                keys.append(_signed(_words_key(text)))
                sizes.append(len((text or "").split()))
                fps.append(_signed(fingerprint(text, shingle)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (keys, sizes, fps)]], ["doc_id", "key", "words", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measured, "doc_id long, key long, words long, fp long")


def shared_shingles(docs: DataFrame, shingle: int, parts: int) -> DataFrame:
    """key, token, n of every shingle (its hash, ``token``) that n > 1 distinct sequences of words hold, once for each that does;
    and with token null the number n of distinct shingles of every sequence.

    Shingles travel packed, by ``parts`` remainders of their hashes, so the shuffle moves 16 bytes each.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, total = [], [], 0

        def out():
            sizes = np.array([len(x) for x in held], np.int64)
            owner = np.array(keys, np.uint64)
            # Sizes go as parts of their own, the negative ones.
            part = np.concatenate([(np.concatenate(held) % np.uint64(parts)).astype(np.int64), -1 - (owner % np.uint64(parts)).astype(np.int64)])
            token, owner = np.concatenate([*held, sizes.astype(np.uint64)]), np.concatenate([np.repeat(owner, sizes), owner])
            order = np.argsort(part, kind="stable")
            token, owner, part = token[order], owner[order], part[order]
            some, starts = np.unique(part, return_index=True)
            ends = [*starts[1:], len(part)]
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(some), cut(token), cut(owner)], ["part", "tokens", "owners"])

        seen: set[int] = set()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py()
                key = _words_key(text)
                if key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                held.append(np.unique(np.array(hashes_of(text, shingle), np.uint64)))
                total += len(held[-1]) + 1
                if total > PACK:
                    yield out()
                    held, keys, total = [], [], 0
                    seen.clear()
        if total:
            yield out()

    def shared(table: pa.Table) -> pa.Table:
        token = np.frombuffer(b"".join(x.as_py() for x in table["tokens"]), "<u8")
        owner = np.frombuffer(b"".join(x.as_py() for x in table["owners"]), "<u8")
        if table["part"][0].as_py() < 0:
            owner, first = np.unique(owner, return_index=True)
            return pa.table({"key": owner.view(np.int64), "token": pa.nulls(len(owner), pa.int64()), "n": token[first].view(np.int64)})
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])  # copies in several batches count once
        token, owner = token[new], owner[new]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.diff(np.r_[starts, len(token)])
        several = np.repeat(count > 1, count)
        return pa.table({"key": owner[several].view(np.int64), "token": token[several].view(np.int64), "n": np.repeat(count, count)[several].astype(np.int64)})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(packed, "part long, tokens binary, owners binary")
    return rows.groupBy("part").applyInArrow(shared, "key long, token long, n long")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose Jaccard similarity, from all shingles both hold, is at least ``least``."""
    side = lambda key, size, held: sets.select(F.col("key").alias(key), F.col("size").alias(size), F.col("tokens").alias(held))
    both = F.size(F.array_intersect("xs", "ys"))
    return _meet(_meet(pairs, side("a", "x", "xs"), "a"), side("b", "y", "ys"), "b").where(both >= least * (F.col("x") + F.col("y") - both) - 1e-9).select("a", "b")


def hash_links(texts: DataFrame) -> DataFrame:
    """a, b: texts (key, fp) whose fingerprints differ in ``MOST_BITS`` bits at most, by the operator's grid (:func:`links`): every text with the least key of its fingerprint, and those of linked fingerprints."""
    values = scratch.write(texts.groupBy("fp").agg(F.min("key").alias("first")), "values")
    same = _meet(texts, values, "fp").where("key != first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    ends = lambda s: values.select(F.col("fp").alias(f"fp_{s}"), F.col("first").alias(f"key_{s}"))
    near = links(values.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    near = _meet(_meet(near, ends("a"), "fp_a"), ends("b"), "fp_b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return same.unionByName(near)


def similar_pairs(docs: DataFrame, texts: DataFrame, words: int, shingle: int, least: float) -> DataFrame:
    """node, root: components of all pairs of texts of similarity ``least`` or more, by key, for the texts that have one; ``texts``: key and fp of each, ``words``: of all.

    Pairs come first from the fingerprints, see :func:`hash_links`. Two texts that alike mostly differ in more bits than any grid can search, so an exact check follows, which reads the shingles themselves:
    it measures those pairs and finds what they leave apart.
    Prefix filter: shingles in order of the number of texts that hold them; of two similar texts of size m, each must share one of its first
    m - ceil(least * m) + 1 with the other, and shingles of one text only never do. So texts are candidates that share such a shingle and whose sizes allow it.
    Each is first compared with the ends of every group that shares one; then all pairs of a group that those links leave in different components are.
    """
    spark = docs.sparkSession
    parts = max(words >> 18, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = shared_shingles(docs, shingle, parts).groupBy("key").agg(F.max(F.when(F.col("token").isNull(), F.col("n"))).alias("size"), F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("n", "token")))).alias("held"))
    room = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1 - (F.col("size") - F.size("held"))
    sets = found.where(F.size("held") > 0).withColumn("room", room.cast("int")).where("room > 0")
    sets = sets.select("key", "size", F.slice("held.token", 1, F.col("room")).alias("first"), F.col("held.token").alias("tokens"))
    sets = scratch.write(sets, "sets")
    index = scratch.write(sets.select("key", "size", F.explode("first").alias("token")), "index")
    fits = F.least("x", "y") >= F.greatest("x", "y") * least - 1e-9
    once = lambda df: df.where((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    end = F.struct("key", "size")
    ends = index.groupBy("token").agg(F.array(F.min(end), F.max(end)).alias("ends")).where("ends[0] != ends[1]")
    stars = _meet(index, ends, "token").select(F.col("key").alias("a"), F.col("size").alias("x"), F.explode("ends").alias("e")).select("a", "x", F.col("e.key").alias("b"), F.col("e.size").alias("y"))
    size = lambda s, name: sets.select(F.col("key").alias(s), F.col("size").alias(name))
    hashed = _meet(_meet(hash_links(texts), size("a", "x"), "a"), size("b", "y"), "b")
    edges = scratch.write(verified(once(hashed.select("a", "x", "b", "y").unionByName(stars)), sets, least), "links")
    rooted = _meet(index, components(edges), F.col("key") == F.col("node"), "left").select("key", "size", "token", F.coalesce("root", "key").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    # In a group of several components, every text outside the commonest one meets such texts of others as sizes and bits allow.
    common = rooted.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    mixed = scratch.write(_meet(rooted, common, "token"), "mixed")
    known = _meet(_meet(mixed, with_bits(_meet(sets, mixed.select("key").distinct(), "key")), "key"), sets.select("key", "first"), "key")
    a = known.where("root != most").select("token", F.col("key").alias("a"), F.col("size").alias("x"), F.col("root").alias("r"), F.col("held").alias("m"), F.col("bits").alias("u"), F.col("first").alias("p"))
    b = known.select(F.col("token").alias("at"), F.col("key").alias("b"), F.col("size").alias("y"), F.col("root").alias("s"), (F.col("root") == F.col("most")).alias("of_most"), F.col("held").alias("n"), F.col("bits").alias("v"), F.col("first").alias("q"))
    # Two texts of several groups in common meet in one: that of the first shingle their prefixes share, in the order of hashes.
    once_only = F.array_min(F.array_intersect("p", "q")) == F.col("token")
    rest = _meet(a, b, (F.col("token") == F.col("at")) & (F.col("r") != F.col("s")) & fits & (F.col("of_most") | (F.col("a") < F.col("b"))) & _may_be_alike(least) & once_only)
    return components(edges.unionByName(verified(once(rest), sets, least)))


def with_bits(sets: DataFrame) -> DataFrame:
    """key, held (shared shingles), bits: a bit for each of them by its hash's low bits, some four to eight times as many as the text has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for size, tokens in zip(batch.column(1).to_pylist(), batch.column(2)):
                flags = np.zeros(64 << max(0, size.bit_length() - 4), bool)
                flags[tokens.values.to_numpy().view(np.uint64) & np.uint64(len(flags) - 1)] = True
                rows.append(np.packbits(flags, bitorder="little").view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(2)], pa.int32()), pa.array(rows, pa.list_(pa.int64()))], ["key", "held", "bits"])

    return sets.select("key", "size", "tokens").mapInArrow(run, "key long, held int, bits array<long>")


def _may_be_alike(least: float) -> Column:
    """Whether two texts (x and y shingles, m and n of them shared, bits u and v) can reach ``least``: a bit that only one has stands for a shingle that only it has.

    Sizes that allow the similarity differ by less than two, so one of the bit arrays is at most twice as long; its halves then fold onto each other.
    """
    u, v = F.col("u"), F.col("v")

    def folded(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))

    def apart(p: Column, q: Column) -> Column:
        return F.bit_count(p.bitwiseAND(F.bitwise_not(q))).cast("long") + F.shiftleft(F.bit_count(q.bitwiseAND(F.bitwise_not(p))).cast("long"), 32)

    wide, narrow = F.when(F.size(u) > F.size(v), folded(u)).otherwise(u), F.when(F.size(v) > F.size(u), folded(v)).otherwise(v)
    both = F.aggregate(F.zip_with(wide, narrow, apart), F.lit(0).cast("long"), lambda t, k: t + k)
    common = F.transform(F.array(both), lambda k: F.least(F.col("m") - k.bitwiseAND(F.lit(0xFFFFFFFF)), F.col("n") - F.shiftrightunsigned(k, 32)))[0]
    return common >= F.lit(least / (1 + least)) * (F.col("x") + F.col("y")) - 1e-6


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """key, doc_id (the smallest of the group), chosen (the key that has it), rows (with both) for every distinct sequence of words.

    Groups are the components of all pairs with a Jaccard similarity of shingles of at least ``least``, found and measured exactly.
    """
    all_rows = scratch.write(keyed(docs, shingle), "keyed")
    texts = scratch.write(all_rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("words").alias("words"), F.first("fp").alias("fp")), "texts")
    roots = similar_pairs(docs, texts.select("key", "fp"), texts.agg(F.sum("words")).first()[0] or 0, shingle, least)
    rooted = _meet(texts, roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("m"))
    named = _meet(rooted, best, "root").select("key", F.col("m.least").alias("doc_id"), F.col("m.key").alias("chosen"))
    copies = all_rows.groupBy(F.col("key").alias("of"), F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    return _meet(named, copies, F.expr("chosen = of and doc_id <=> id"), "left").select("key", "doc_id", "chosen", "rows")


def first_of_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first of their group of similar texts: one a group."""
    stays = scratch.write(similar(docs, shingle, least).where("key = chosen").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), F.col("rows").alias("_rows")), "stays")
    names, at = docs.columns, docs.columns.index("text")

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([_signed(_words_key(x.as_py())) for x in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*names, "_key"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _key long"
    rows = _meet(docs.mapInArrow(with_key, schema), stays, "_key").where("doc_id <=> _id")
    single = rows.where("_rows = 1").select(*names)
    several = rows.where("_rows > 1").groupBy("_key").agg(F.min(F.struct(*names)).alias("r")).select("r.*")
    return single.unionByName(several)


def op5_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "rows")
