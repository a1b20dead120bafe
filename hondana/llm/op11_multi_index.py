"""Near-duplicate vectors by an inverted multi-index.

The halves of unit vectors have codebooks of their own (k-means on a bounded sample); a vector lies in the cell of its nearest centroid
pair, one of K x K. A vector's neighbours within the range lie in cells near to it: the squared distance of its half to the plane between its own
centroid and another bounds, for both halves together, how far away that other cell is. The multi-sequence traversal visits cells in ascending order of that sum
until ``limit``, the one at which the target recall is reached: the quantile of the bound over pairs *at* the threshold, made of sampled vectors
turned by random directions, and over such links as the sample has (closer pairs need less). Every candidate is verified by its cosine, in double
precision, so no false link comes out. A pair of two cells meets in one of them only, by the parity of their numbers.

Equal vectors are one node with a weight, so copies cost nothing. A group of near copies would still be compared with itself: vectors within half the
range of a dense direction of the sample (a ball) all link with each other, so those are counted and tied to the least one instead.
Balls still lie in cells: each entry of a vector says what it is to meet there, the vectors of no ball, or a ball whose edge it may lie near. Cells hold units of
entries of one kind, cut to chunks of ``CHUNK`` by digest; a task compares two chunks and returns the degree of its vectors and a spanning forest of its links.
Nothing emits pairs, and no task holds more than two chunks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components have no links and are their own components; shorter
vectors count as padded with zeros; labels and other columns are ignored; repeated rows and other rows of one vec_id are vectors of their own, which link; component_id
is null only where all of a component's ids are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import acos, cos, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hondana.llm import scratch
from hondana.llm.op5_simhash import components

LEAST = 0.95
RECALL = 0.99
#: Vectors that codebooks are fitted on, and those of them that balls and links are looked for in.
SAMPLE = 16_384
DENSE_SAMPLE = 4096
#: Of the latter, how many a dense direction has within its ball at least.
DENSE = 8
#: Vectors a cell, on average; centroids a half at most.
PER_CELL = 64
MOST = 1024
CHUNK = 2048
BLOCK = 512
#: Angles this close to a bound count as beyond it.
MARGIN = 1e-7


@dataclass
class Index:
    """Codebooks of both halves, the bound at which the traversal stops, and the directions of the balls."""

    width: int
    books: tuple[np.ndarray, np.ndarray]
    limit: float
    balls: np.ndarray
    angle: float

    def cell(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Numbers of the cells of unit vectors, and for both halves the squared bounds of their distance to each centroid's region."""
        at = self.width // 2
        homes, bounds = zip(*[_regions(h, b) for h, b in zip((x[:, :at], x[:, at:]), self.books)])
        return homes[0] * len(self.books[1]) + homes[1], list(bounds)

    def visited(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Cells in ascending order of a[i] + b[j], as far as the limit: the multi-sequence traversal."""
        first, second = (some[np.argsort(x[some], kind="stable")] for x in (a, b) if len(some := np.flatnonzero(x <= self.limit)))
        heap = [(a[first[0]] + b[second[0]], 0, 0)]
        while heap:
            bound, p, q = heappop(heap)
            if bound > self.limit:
                return
            yield int(first[p]) * len(b) + int(second[q])
            if q + 1 < len(second):
                heappush(heap, (a[first[p]] + b[second[q + 1]], p, q + 1))
            if q == 0 and p + 1 < len(first):
                heappush(heap, (a[first[p + 1]] + b[second[0]], p + 1, 0))

    def around(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ball of each unit vector (from 1; 0 for none), and which other balls may hold a neighbour of it."""
        if not len(self.balls):
            return np.zeros(len(x), np.int64), np.zeros((len(x), 0), bool)
        angles = np.arccos(np.clip(x @ self.balls.T, -1, 1))
        own = angles.argmin(axis=1)
        inside = angles[np.arange(len(x)), own] <= self.angle / 2 - MARGIN
        near = angles <= 1.5 * self.angle + MARGIN
        near[np.arange(len(x))[inside], own[inside]] = False
        return np.where(inside, own + 1, 0), near


def unit(rows, width: int) -> np.ndarray:
    """Unit vectors of ``width`` components, in double precision and safe from overflow."""
    if len(rows) and {len(r) for r in rows} == {width}:
        out = np.stack(rows).astype(np.float64)
    else:
        out = np.zeros((len(rows), width))
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
    out /= np.maximum(np.abs(out).max(axis=1, initial=0), 1e-320)[:, None]
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)


def _regions(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _squares(x, book)
    home = d.argmin(axis=1)
    more = np.maximum(d - d[np.arange(len(x)), home][:, None], 0)
    gaps = 2 * np.sqrt(np.maximum(_squares(book, book), 0))[home]
    # Two centroids at one place leave no region to the second.
    bound = np.divide(more, gaps, out=np.full_like(more, np.inf), where=gaps > 1e-9) ** 2
    bound[np.arange(len(x)), home] = 0
    return home, bound


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from the first vectors of the sample, which comes in the order of digests."""
    book = x[:k].copy()
    for _ in range(rounds):
        home = np.concatenate([_squares(x[a : a + 4096], book).argmin(axis=1) for a in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        some, starts = np.unique(home[order], return_index=True)
        book[some] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.r_[starts, len(x)])[:, None]
    return book


def dense_directions(x: np.ndarray, angle: float) -> np.ndarray:
    """Directions that have at least ``DENSE`` of ``x`` within half the ``angle``, the fullest first, none of them within another's ball."""
    near = x @ x.T >= cos(angle / 2)
    found, left = [], np.ones(len(x), bool)
    degree = near.sum(axis=1)
    while len(x) and degree.max() >= DENSE:
        mine = near[degree.argmax()] & left
        centre = x[mine].sum(axis=0)
        centre /= np.sqrt(centre @ centre)
        found.append(centre)
        mine |= (x @ centre >= cos(angle / 2)) & left
        left &= ~mine
        degree = (degree - near[:, mine].sum(axis=1)) * left
    return np.array(found).reshape(len(found), x.shape[1])


def fit(x: np.ndarray, nodes: int, least: float = LEAST, recall: float = RECALL) -> Index:
    """The index for ``nodes`` vectors from a sample ``x`` of unit vectors."""
    width, k = x.shape[1], max(1, min(MOST, len(x), round(sqrt(nodes / PER_CELL))))
    books = codebook(x[:, : width // 2], k), codebook(x[:, width // 2 :], k)
    few = x[:DENSE_SAMPLE]
    index = Index(width, books, 0.0, dense_directions(few, acos(least)), acos(least))
    turn = np.random.default_rng(11).normal(size=few.shape)
    turn -= (turn * few).sum(axis=1)[:, None] * few
    size = np.sqrt((turn * turn).sum(axis=1))[:, None]
    other = np.where(size > 1e-9, least * few + sqrt(max(0.0, 1 - least * least)) * turn / np.maximum(size, 1e-9), few)
    limits = [_bound(index, few, other, np.arange(len(few)), np.arange(len(few)))]
    for at in range(0, len(few), BLOCK):
        a, b = np.nonzero(few[at : at + BLOCK] @ few.T >= least)
        if (a + at != b).any():
            limits.append(_bound(index, few, few, a[a + at != b] + at, b[a + at != b]))
    made, met = limits[0], np.concatenate([*limits[1:], np.zeros(1)])
    index.limit = float(max(np.quantile(made, recall, method="higher"), np.quantile(met, recall, method="higher")))
    return index


def _bound(index: Index, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the traversal from x[a] must go to visit the cell of y[b]."""
    _, (p, q) = index.cell(x)
    home, _ = index.cell(y)
    i, j = np.divmod(home[b], len(index.books[1]))
    return p[a, i] + q[a, j]


def _entries(index: Index):
    """cell, home, ball, target, node of every cell a vector lies in or visits, once for what it is to meet there: no ball (0) or a ball."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(1).to_numpy(zero_copy_only=False), index.width)
            homes, (a, b) = index.cell(x)
            balls, near = index.around(x)
            cells, of = [], []
            for k, home in enumerate(homes.tolist()):
                cells.append(home)
                for c in index.visited(a[k], b[k]):
                    if c != home and (home < c) == ((home + c) % 2 == 0):
                        cells.append(c)
                of += [k] * (len(cells) - len(of))
            cells, of = np.array(cells, np.int64), np.array(of, np.int64)
            more, ball = np.nonzero(near[of])
            rows, targets = np.r_[np.arange(len(of)), more], np.r_[np.zeros(len(of), np.int64), ball + 1]
            node, at = batch.column(0).to_numpy(), of[rows]
            yield pa.RecordBatch.from_arrays([pa.array(cells[rows]), pa.array(cells[rows] == homes[at]), pa.array(balls[at]), pa.array(targets), pa.array(node[at])], ["cell", "home", "ball", "target", "node"])

    return run


def compared(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (of x, of y) of the links of two chunks, a block of x at a time; without a vector and itself if both are the ``same``."""
    for at in range(0, len(x), BLOCK):
        a, b = np.nonzero(x[at : at + BLOCK] @ y.T >= least)
        a += at
        yield (a[a != b], b[a != b]) if same else (a, b)


def _task(width: int, least: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable")
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        same = not len(right)
        right = left if same else right
        x = unit(left["v"].to_list(), width)
        y = x if same else unit(right["v"].to_list(), width)
        nodes, weights = np.r_[left["node"], right["node"]], [side["n"].to_numpy(np.int64) for side in (left, right)]
        shift = 0 if same else len(left)
        links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for a, b in compared(x, y, least, same):
            np.add.at(links, a, weights[1][b])
            if not same:
                np.add.at(links, b + shift, weights[0][a])
            some, starts = np.unique(a, return_index=True)  # a ascends
            for i, mine in zip(some, np.split(b, starts[1:])):
                both = np.unique(np.r_[label[i], label[mine + shift]])
                if len(both) > 1:
                    label[np.isin(label, both)] = both[0]
        linked, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": np.r_[nodes[linked], nodes[tied]], "b": pd.array([None] * len(linked) + nodes[label[tied]].tolist(), "Int64"), "links": np.r_[links[linked], np.zeros(len(tied), np.int64)]})

    return run


def _meetings(entries: DataFrame) -> DataFrame:
    """cell, home, ball, target, chunk, side and the key of the task (t_...) of every chunk that takes part in a comparison."""
    units = entries.groupBy("cell", "home", "ball", "target").agg(F.count(F.lit(1)).alias("size"))
    chunks = units.select("cell", "home", "ball", "target", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / CHUNK).cast("int") - 1)).alias("chunk"))
    side = lambda s: chunks.select([F.col(c).alias(f"{s}_{c}") for c in chunks.columns])
    # Entries meet that are looking for each other. Units of two homes meet once, and a unit's chunks among themselves too.
    meet = F.expr("l_cell = r_cell and l_ball = r_target and l_target = r_ball and l_home")
    once = F.expr("not r_home or l_ball < r_ball or (l_ball = r_ball and l_chunk <= r_chunk)")
    tasks = side("l").join(side("r"), meet & once)
    names = ["home", "ball", "target", "chunk"]
    one = lambda s, k: F.struct(F.lit(k).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in names])
    alone = F.expr("r_home and l_ball = r_ball and l_chunk = r_chunk")
    sides = F.when(alone, F.array(one("l", 0))).otherwise(F.array(one("l", 0), one("r", 1)))
    key = [F.col(f"l_{c}").alias(f"t_{c}") for c in ("ball", "target", "chunk")] + [F.col(f"r_{c}").alias(f"u_{c}") for c in ("home", "chunk")]
    return tasks.select(F.col("l_cell").alias("cell"), *key, F.explode(sides).alias("s")).select("cell", "s.*", "t_ball", "t_target", "t_chunk", "u_home", "u_chunk")


def links(nodes: DataFrame, entries: DataFrame, width: int, least: float) -> DataFrame:
    """a, b, links: the degree of node a in a task's links (b null), or an edge of their spanning forest."""
    units = entries.groupBy("cell", "home", "ball", "target").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    placed = entries.join(units, ["cell", "home", "ball", "target"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    key = ["cell", "t_ball", "t_target", "t_chunk", "u_home", "u_chunk"]
    dealt = placed.join(_meetings(entries), ["cell", "home", "ball", "target", "chunk"]).select(*key, "side", "node")
    return dealt.join(nodes.select("node", "n", "v"), "node").groupBy(*key).applyInPandas(_task(width, least), "a long, b long, links long")


def _fine(x: Column) -> Column:
    return x.isNotNull() & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))) & F.exists(x, lambda y: y != 0)


def op11_multi_index(vectors: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(_fine(x), x).alias("v"))
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    count, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    own = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not count:
        return own.withColumn("kept", F.lit(True))
    sample = nodes.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow().column(0).to_numpy()
    index = fit(unit(sample, max(2, width)), count, least, recall)
    entries = scratch.write(nodes.select("node", "v").mapInArrow(_entries(index), "cell long, home boolean, ball long, target long, node long"), "entries")
    found = scratch.write(links(nodes, entries, index.width, least), "links")
    inside = entries.where("home and ball > 0 and target = 0").select("node", "ball").join(nodes.select("node", "n"), "node")
    balls = inside.groupBy("ball").agg(F.sum("n").alias("weight"), F.min("node").alias("centre"))
    tied = scratch.write(inside.join(balls, "ball").select("node", "centre", (F.col("weight") - F.col("n")).alias("others")), "balls")
    roots = components(found.where("b is not null").select("a", "b").unionByName(tied.select(F.col("node").alias("a"), F.col("centre").alias("b"))))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.join(degree, "node", "left").join(tied.select("node", "others"), "node", "left").join(roots, "node", "left")
    known = known.select("v", "least_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least_ids = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = known.join(least_ids, "root").select("v", "n_links", "component_id")
    linked = rows.where("v is not null").join(named, "v").select("vec_id", "n_links", "component_id")
    return linked.unionByName(own).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All links, without an index: what the operator returns where its recall is one, as it has been wherever it was measured.
SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0, false) AS fine
  FROM embeddings),
linked AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.fine AND b.fine AND a.r != b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a),
least AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a),
degree AS (SELECT a AS r, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN degree USING (r)
"""
