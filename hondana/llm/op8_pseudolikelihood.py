"""Language-model scoring by masked pseudo-likelihood.

A token is predicted from the ``WINDOW`` tokens on both of its sides, itself masked. The network adds up one row per
neighbour (embedding and first layer in one table per place), applies tanh, and predicts in two steps: the
token's class, then the token within its class, so a prediction costs two short softmaxes instead of one over
the vocabulary. A document's score is the sum of the conditional log-probabilities of all its tokens.

Tokens are lower-cased runs of letters, single digits and other marks. The vocabulary is the most frequent ones, counted over
the whole corpus, as many as an eighth of the square root of its tokens, ``VOCABULARY`` at least; classes cut it, in order of frequency, into runs of
about the square root of it. A token outside it is predicted as the rare token, and then by a mixture of two distributions: the corpus's counts of the next ``LEXICON`` tokens in order of
frequency, and a spelling, each byte given the one before, from counts over all rare tokens. The spelling's share is that of PPM method C: rare tokens beyond the
lexicon, and one more for each of the lexicon. So all tokens' probabilities, in one place, add up to one. The output biases start from corpus counts.

Training reads every document: in each, a share ``MASKED`` of the places, spread evenly, is masked and predicted, one place at least. (That is a share of the work as well; the README says what it
costs in likelihood.) Documents are dealt by digest of id and text, so alike however the input is split, to groups of about
``GROUP`` tokens; from one start a network is trained on each group in numpy, batch by batch, and the networks' mean, by places, is the result, added up by ``SLICE`` weights at a time.

What travels is bounded: the network by its vocabulary, spelling by pairs of bytes, the lexicon by its size.

Edge cases: an empty table gives no rows, texts of any length are read whole; null and empty texts and texts without tokens have 0 tokens, sum 0 and mean null; ends of a text are seen as an edge
token; equal texts score alike; rows come out once each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hondana.llm import scratch

WINDOW = 2
VOCABULARY = 1023
CLASS = 32
HIDDEN = 24
STEP = 16384
MASKED = 0.1
#: Tokens a group has about, and how many groups there are at most (beyond that they grow).
GROUP, GROUPS = 8_000_000, 4096
#: Networks of which one task averages a slice, and weights of a slice.
FAN, SLICE = 16, 1 << 20
#: Tokens whose value a task keeps.
KNOWN = 150_000
#: Tokens after the vocabulary that are known by their counts.
LEXICON = 1 << 16
PARTS = ("near", "bias", "to_class", "class_bias", "to_word", "word_bias")

_TOKENS = re.compile(r"[^\W\d_]+|\d|[^\w\s]")
_END = 256


def tokens_of(text: str | None) -> list[str]:
    return _TOKENS.findall((text or "").lower())


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, n over all of ``docs``: each task counts what it reads before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([t.encode("utf-8", "replace") for t in seen], pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for x in batch.column(0):
                seen.update(tokens_of(x.as_py()))
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def byte_logs(pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of each byte given the one before, from counts of pairs; ``_END`` stands before the first and after the last."""
    pairs = pairs.reshape(257, 257).astype(np.float64)
    single = (pairs.sum(axis=0) + 1) / (pairs.sum() + 257)
    return np.log((pairs + single) / (pairs.sum(axis=1, keepdims=True) + 1)).astype(np.float32)


def spelt(logs: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """Log-probabilities of tokens by their bytes."""
    if not tokens:
        return np.zeros(0)
    data, size = _chained(tokens)
    return np.add.reduceat(logs[data[:-1], data[1:]], np.cumsum(size + 1) - size - 1, dtype=np.float64)


def _chained(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens one after the other with ``_END`` around each, and their lengths."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    data = np.full(int(size.sum()) + len(size) + 1, _END, np.int64)
    of = np.repeat(np.arange(len(size)), size)
    data[np.arange(len(of)) + of + 1] = np.frombuffer(b"".join(tokens), np.uint8)
    return data, size


def spelling(rare: DataFrame) -> np.ndarray:
    """:func:`byte_logs` of the tokens of ``rare`` (token, n); at most 257 * 257 sums reach the driver."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(257 * 257, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, size = _chained(batch.column(0).cast(pa.binary()).to_pylist())
            seen += np.bincount(data[:-1] * 257 + data[1:], np.repeat(batch.column(1).to_numpy(), size + 1), 257 * 257).astype(np.int64)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["pair", "n"])

    out = np.zeros(257 * 257, np.int64)
    for r in rare.select("token", "n").mapInArrow(pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return byte_logs(out)


class Rare:
    """P(token | rare): ``known`` tokens by their counts, any token by its spelling."""

    def __init__(self, known: dict[str, int], total: int, logs: np.ndarray):
        self.logs = logs
        counted = sum(known.values())
        #: Share of the counts; the rest is the spelling's.
        self.share = counted / (total + len(known) + 1)
        self.known = {t: self.share * n / counted for t, n in known.items()}

    def log_probabilities(self, tokens: list[str]) -> np.ndarray:
        as_bytes = [t.encode("utf-8", "replace") for t in tokens]
        counted = np.fromiter((self.known.get(t, 0.0) for t in tokens), np.float64, len(tokens))
        by_letters = spelt(self.logs, as_bytes) + np.log1p(-self.share)
        return np.where(counted > 0, np.logaddexp(np.log(np.maximum(counted, 1e-300)), by_letters), by_letters)


class Network:
    """Two-sided window network over token numbers: 0 rare, 1 to V the vocabulary, V + 1 the edge of a text."""

    def __init__(self, words: list[str], counts: list[int], rare: int, size: int = CLASS, hidden: int = HIDDEN, window: int = WINDOW):
        rng = np.random.default_rng(3)
        n = len(words) + 1  # with rare, the first
        self.words, self.size, self.window = words, size, window
        self.classes = -(-n // size)
        self.edge = n
        weight = np.array([max(rare, 1), *counts], np.float64)
        # Tokens by frequency, cut into classes; number -> class and place in it.
        order = np.argsort(-weight, kind="stable")
        self.slot = np.empty(n, np.int32)
        self.slot[order] = np.arange(n)
        full = np.full(self.classes * size, 1e-6)
        full[:n] = weight[order]
        full = full.reshape(self.classes, size)
        self.near = (rng.standard_normal((2 * window, n + 1, hidden)) * 0.1).astype(np.float32)
        self.bias = np.zeros(hidden, np.float32)
        self.to_class = (rng.standard_normal((hidden, self.classes)) * 0.1).astype(np.float32)
        self.class_bias = np.log(full.sum(axis=1) / full.sum()).astype(np.float32)
        self.to_word = (rng.standard_normal((self.classes, hidden, size)) * 0.1).astype(np.float32)
        self.word_bias = np.log(full / full.sum(axis=1, keepdims=True)).astype(np.float32)

    def framed(self, numbers: np.ndarray) -> np.ndarray:
        edge = np.full(self.window, self.edge, np.int32)
        return np.concatenate([edge, numbers, edge])

    def windows(self, framed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row per place of ``at``: its neighbours from left to right, then the token itself."""
        steps = [k for k in range(-self.window, self.window + 1) if k]
        return framed[at[:, None] + np.array([*steps, 0])]

    def _hidden(self, rows: np.ndarray) -> np.ndarray:
        total = np.broadcast_to(self.bias, (len(rows), len(self.bias))).copy()
        for k in range(2 * self.window):
            total += self.near[k][rows[:, k]]
        return np.tanh(total, out=total)

    def _by_class(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Rows ordered by the class of their token, classes and places in it, and each class's stretch of the rows."""
        slot = self.slot[rows[:, -1]]
        order = np.argsort(slot, kind="stable")
        c, w = slot[order] // self.size, slot[order] % self.size
        cuts = np.searchsorted(c, np.arange(self.classes + 1))
        return order, c, w, [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of the token of every row (see :meth:`windows`), given its neighbours."""
        order, c, w, stretches = self._by_class(rows)
        h = self._hidden(rows[order])
        z = h @ self.to_class + self.class_bias
        at = np.arange(len(rows))
        got = z[at, c] - _log_sum(z)
        for k, a, b in stretches:
            z = h[a:b] @ self.to_word[k] + self.word_bias[k]
            got[a:b] += z[at[: b - a], w[a:b]] - _log_sum(z)
        out = np.empty(len(rows), np.float32)
        out[order] = got
        return out

    def trainer(self, rate: float = 0.3) -> "Trainer":
        return Trainer(self, rate)


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1)
    return top + np.log(np.exp(z - top[:, None]).sum(axis=1))


class Trainer:
    """Gradient steps with Adagrad; ``seen``: rows trained on."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.seen = net, rate, 0
        self.square = {k: np.full_like(getattr(net, k), 1e-2) for k in PARTS}

    def _step(self, part: str, gradient: np.ndarray, at=...) -> None:
        self.square[part][at] += gradient * gradient
        getattr(self.net, part)[at] -= self.rate * gradient / np.sqrt(self.square[part][at])

    def batch(self, rows: np.ndarray) -> None:
        net = self.net
        order, c, w, stretches = net._by_class(rows)
        rows, at = rows[order], np.arange(len(rows))
        h = net._hidden(rows)
        scale = np.float32(1 / len(rows))
        p = _softmax(h @ net.to_class + net.class_bias)
        p[at, c] -= 1
        p *= scale
        dh = p @ net.to_class.T
        self._step("to_class", h.T @ p)
        self._step("class_bias", p.sum(axis=0))
        for k, a, b in stretches:
            z = _softmax(h[a:b] @ net.to_word[k] + net.word_bias[k])
            z[at[: b - a], w[a:b]] -= 1
            z *= scale
            dh[a:b] += z @ net.to_word[k].T
            self._step("to_word", h[a:b].T @ z, k)
            self._step("word_bias", z.sum(axis=0), k)
        dh *= 1 - h * h
        self._step("bias", dh.sum(axis=0))
        for k in range(2 * net.window):
            near = np.argsort(rows[:, k], kind="stable")
            some, starts = np.unique(rows[near, k], return_index=True)
            self._step("near", np.add.reduceat(dh[near], starts, axis=0), (k, some))
        self.seen += len(rows)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    return z


def masked_places(text: str, n: int, share: float = MASKED) -> np.ndarray:
    """A share of the places 0 to n - 1, one at least, spread evenly from a start that depends on the text."""
    start = zlib.crc32(text.encode("utf-8", "replace"))
    turns = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B1) + np.uint64(start)) & np.uint64(0xFFFFFFFF)
    found = np.flatnonzero(turns < np.uint64(int(share * 2**32)))
    return found if len(found) or not n else np.array([start % n])


def train(docs: DataFrame, vocabulary: int | None = None, share: float = MASKED, batch: int = 2048) -> Network:
    """Vocabulary, biases, rare tokens and weights, all from the whole of ``docs``."""
    spark = docs.sparkSession
    counts = scratch.write(count_tokens(docs), "tokens")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if vocabulary is None:
        vocabulary = max(VOCABULARY, math.isqrt(total) // 8)
    often = counts.orderBy(F.col("n").desc(), "token").limit(vocabulary + LEXICON).collect()
    top = often[:vocabulary]
    words = [r.token for r in top]
    network = Network(words, [r.n for r in top], total - sum(r.n for r in top), max(CLASS, math.isqrt(vocabulary)))
    known = spark.createDataFrame([(w,) for w in words], "token string")
    rare = scratch.write(counts.join(F.broadcast(known), "token", "left_anti"), "rare")  # the vocabulary: its size is a parameter
    network.rare = Rare({r.token: r.n for r in often[vocabulary:]}, total - sum(r.n for r in top), spelling(rare))
    scratch.drop(counts)
    scratch.drop(rare)
    if not total:
        return network
    groups = max(1, min(GROUPS, total // GROUP))
    shared = spark.sparkContext.broadcast({k: v for k, v in vars(network).items() if k != "rare"})

    def given() -> Network:
        net = Network.__new__(Network)
        vars(net).update({k: v.copy() if k in PARTS else v for k, v in shared.value.items()})
        return net

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = given()
        get = {w: k + 1 for k, w in enumerate(net.words)}.get
        for some in batches:
            rows = []
            for x in some.column(1):
                text = x.as_py()
                tokens = tokens_of(text)
                framed = net.framed(np.array([get(t, 0) for t in tokens], np.int32))
                rows.append(net.windows(framed, masked_places(text, len(tokens), share) + net.window).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.binary())], ["key", "rows"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, held, size = given(), [], 0
        trainer = net.trainer()

        def work(rows: np.ndarray):
            for k in range(0, len(rows), batch):
                trainer.batch(rows[k : k + batch])

        for some in batches:
            for x in some.column(1):
                held.append(np.frombuffer(x.as_py(), "<i4").reshape(-1, 2 * net.window + 1))
                size += len(held[-1])
                if size >= 64 * batch:
                    rows = np.random.default_rng(5).permutation(np.concatenate(held))
                    cut = len(rows) - len(rows) % batch
                    work(rows[:cut])
                    held, size = [rows[cut:]], len(rows) - cut
        if size:
            work(np.random.default_rng(5).permutation(np.concatenate(held)))
        weights = np.concatenate([getattr(net, k).ravel() for k in PARTS]).astype("<f4")
        part = TaskContext.get().partitionId()
        for number, at in enumerate(range(0, len(weights), SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int32()), pa.array([trainer.seen], pa.int64()), pa.array([weights[at : at + SLICE].tobytes()], pa.binary())], names)

    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["n"].to_pylist(), table["weights"]), key=lambda r: r[0])
        n = sum(r[1] for r in rows)
        out = np.zeros(len(rows[0][2].as_py()) // 4)
        for _, m, w in rows:
            out += np.frombuffer(w.as_py(), "<f4") * (m / max(n, 1))
        return pa.table({"part": pa.array([rows[0][0] // FAN], pa.int64()), "slice": table["slice"][:1], "n": pa.array([n], pa.int64()), "weights": pa.array([out.astype("<f4").tobytes()], pa.binary())})

    kind, names = "part long, slice int, n long, weights binary", ["part", "slice", "n", "weights"]
    texts = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    dealt = texts.mapInArrow(mask, "key long, rows binary").repartition(groups, "key").sortWithinPartitions("key", "rows")
    networks = scratch.write(dealt.mapInArrow(trained, kind), "networks")
    groups = networks.agg(F.max("part")).first()[0] + 1  # as many as there are partitions
    while groups > 1:
        networks = scratch.write(networks.groupBy(F.floor(F.col("part") / FAN).alias("over"), "slice").applyInArrow(mean, kind), "networks")
        groups = -(-groups // FAN)
    at, weights = 0, np.concatenate([np.frombuffer(bytes(r.weights), "<f4") for r in networks.orderBy("slice").toLocalIterator()])
    for k in PARTS:
        old = getattr(network, k)
        setattr(network, k, weights[at : at + old.size].reshape(old.shape).copy())
        at += old.size
    return network


class Scorer:
    """Scores texts by a network; keeps what it found out about up to ``KNOWN`` tokens."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {w: k + 1 for k, w in enumerate(self.net.words)}  # as they are numbered; others follow
        self.rare = len(self.place) + 1
        self.value = np.zeros(0)

    def places(self, texts: list[list[str]]) -> np.ndarray:
        """A number for every token, from ``rare`` on for those outside the vocabulary."""
        if len(self.place) > KNOWN:
            self._forget()
        new = list(set().union(*texts).difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.place) + 1, len(self.place) + len(new) + 1)))
            self.value = np.concatenate([self.value, self.net.rare.log_probabilities(new)])
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(texts)), np.int32, sum(map(len, texts)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and sum of log-probabilities of every text."""
        net, tokens = self.net, [tokens_of(x) for x in texts]
        sizes = np.array([len(x) for x in tokens])
        number = self.places(tokens)
        rare = number >= self.rare
        value = np.zeros(len(number))
        value[rare] = self.value[number[rare] - self.rare]
        number[rare] = 0
        # Each text's frame of edges shifts what follows it.
        framed = np.full(len(number) + 2 * net.window * len(sizes), net.edge, np.int32)
        places = np.arange(len(number)) + net.window * (2 * np.repeat(np.arange(len(sizes)), sizes) + 1)
        framed[places] = number
        for k in range(0, len(places), STEP):
            value[k : k + STEP] += net.log_probabilities(net.windows(framed, places[k : k + STEP]))
        return sizes, np.bincount(np.repeat(np.arange(len(sizes)), sizes), value, len(sizes))


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (natural logarithms, summed), mean of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(network))  # vocabulary times hidden units, pairs of bytes, the lexicon

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.__new__(Network)
        vars(net).update(shared.value)
        scorer = Scorer(net)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                sizes, sums = scorer(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array([s / n if n else None for s, n in zip(sums, sizes)], pa.float64())], ["doc_id", "n_tokens", "log_likelihood", "mean"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(score, "doc_id long, n_tokens long, log_likelihood double, mean double")


def op8_pseudolikelihood(docs: DataFrame) -> DataFrame:
    """Score every text of ``docs`` by a network trained on the same corpus."""
    return scored(docs, train(docs))
