"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``ORDER`` bytes. A byte is coded from the longest context
that the language's tree holds; where it never followed there, an escape is coded and the next shorter
context is asked, down to an even spread over all bytes. Escape probabilities are those of PPM method C: distinct
followers over count plus distinct followers. The statistics are frozen after training, so every code length
is a fixed number per context and byte. A tree is kept as sorted arrays of what its training holds and no more, so that the trees grow with the
languages in proportion; each distinct run of ORDER + 1 bytes of some texts is looked up once.

A text's code length in a language is the exact sum over all its bytes (lower-cased letters, runs of
anything else as one space). The shortest wins; the score is its share of exp(-code length / ``SCALE``)
over all languages.

The trees take at most ``TRAIN`` documents per language (a documented bound), whole texts; every text is scored whole.

Edge cases: null texts and texts without letters (Unicode category L) get ``und`` and score 0; equal code lengths go to the
first language by code point; without training rows all get ``und``, and an empty table gives no rows; texts of any length are scored whole, some bytes at a
time; rows come out once each; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hondana.llm import sampling, scratch

FOLDS, HELD_OUT = 5, 0
ORDER = 3
TRAIN = 400
SCALE = 20.0
SLICE = 1 << 20
#: Ids of chosen documents, of all languages, that go to every task; more are joined by a shuffle.
BROADCAST = 200_000

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters with the marks that follow them (vowel signs, accents), each run of anything else as one space; empty if there is no letter."""
    low = (text or "").lower()
    marks = "".join(sorted(c for c in set(low) if not c.isalnum() and unicodedata.category(c)[0] == "M"))
    if marks:
        plain = re.sub(f"(?:(?![{marks}])[\\W\\d_])+", " ", low)
        plain = re.sub(f"(?:(?<![^ ])[{marks}])+ ?", "", plain)  # marks of no letter
    else:
        plain = _OTHER.sub(" ", low)
    # What is left beside letters: other numbers, such as fractions and Roman numerals.
    if others := [c for c in set(plain) if not c.isalpha() and c != " " and c not in marks]:
        plain = re.sub(f"[{re.escape(''.join(others))} ][{re.escape(''.join(others))} {marks}]*", " ", plain)
    plain = plain.strip()
    return f" {plain} ".encode("utf-8", "surrogatepass") if plain else b""


def _codes(data: np.ndarray, size: int) -> np.ndarray:
    """Every run of ``size`` bytes as one number."""
    wide = data.astype(np.uint32 if size <= 4 else np.uint64)
    n = max(0, len(wide) - size + 1)
    out = np.zeros(n, wide.dtype)
    for k in range(size):
        out = out << wide.dtype.type(8) | wide[k : k + n]
    return out


def _counted(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``size`` bytes in order, and how often each occurs; some bytes at a time."""
    keys, times = _codes(data[:0], size), np.zeros(0, np.int64)
    for at in range(0, max(0, len(data) - size + 1), SLICE):
        more, n = np.unique(_codes(data[at : at + SLICE + size - 1], size), return_counts=True)
        both = np.concatenate([keys, more])
        keys, inverse = np.unique(both, return_inverse=True)
        times = np.bincount(inverse, np.concatenate([times, n]), len(keys)).astype(np.int64)
    return keys, times


class Trees:
    """Frozen code lengths in bits. ``levels[language][k]``: runs of k + 1 bytes in order and their costs, contexts of k bytes in order and the costs of their escapes."""

    def __init__(self, texts: dict[str, bytes], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        self.levels = []
        for name in self.languages:
            data, levels = np.frombuffer(texts[name], np.uint8), []
            for k in range(order + 1):
                grams, times = _counted(data, k + 1)
                contexts, at = np.unique(grams >> grams.dtype.type(8), return_inverse=True)
                total, distinct = np.bincount(at, times, len(contexts)), np.bincount(at, minlength=len(contexts))
                cost = -np.log2(times / (total + distinct)[at]) if len(at) else np.zeros(0)
                levels.append((grams, cost.astype(np.float32), contexts, (-np.log2(distinct / (total + distinct)) if len(contexts) else np.zeros(0)).astype(np.float32)))
            self.levels.append(levels)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of every run of order + 1 bytes, in every language."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        for i, levels in enumerate(self.levels):
            left, mine = np.arange(len(codes)), out[:, i]
            for k in range(self.order, -1, -1):
                grams, cost, contexts, escape = levels[k]
                own = codes[left] & codes.dtype.type((1 << 8 * (k + 1)) - 1)
                own = own.astype(grams.dtype)
                at, hit = _find(grams, own)
                mine[left[hit]] += cost[at[hit]]
                left, own = left[~hit], own[~hit] >> own.dtype.type(8)
                at, hit = _find(contexts, own)
                mine[left[hit]] += escape[at[hit]]
            mine[left] += 8
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language, exact sums over all bytes."""
        out, k = np.zeros((len(texts), len(self.languages))), self.order
        sizes = np.array([len(t) + k for t in texts])  # each text starts after spaces of its own, which cost nothing
        data = np.frombuffer(b" " * k + b"".join(b" " * k + t for t in texts), np.uint8)  # k more in front: a run ends at each place
        ends = np.cumsum(sizes)
        lead = (ends - sizes)[:, None] + np.arange(k)
        for a in range(0, int(sizes.sum()), SLICE):
            b = min(a + SLICE, int(sizes.sum()))
            codes = _codes(data[a : b + k], k + 1)
            known = np.unique(codes)
            cost = self.costs(known)[np.searchsorted(known, codes)]
            cost[lead[(lead >= a) & (lead < b)] - a] = 0
            first, last = np.searchsorted(ends, [a, b - 1], side="right")
            starts = np.maximum(ends[first : last + 1] - sizes[first : last + 1], a) - a
            out[first : last + 1] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.intp), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def train(docs: DataFrame, most: int = TRAIN) -> Trees:
    """Trees from at most ``most`` documents (whole; chosen by digest of doc_id) of each language outside the held-out fold."""
    mark = F.xxhash64("doc_id")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (sampling.fold(FOLDS) != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"), mark.alias("mark"))

    def least(df: DataFrame, *order: str) -> DataFrame:
        """The first ``most`` rows of each language: each task passes on that many at most, before any shuffle."""
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)

    # First by ids alone, so that texts are only read for the documents chosen, by a join with their few ids.
    ids = scratch.write(least(rows.select("lang", "mark", "doc_id"), "mark", "doc_id").select("lang", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")).distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    mine = rows.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_none", F.col("doc_id").isNull()).join(few, ["lang", "_id", "_none"], "left_semi")
    chosen = least(mine.select("lang", "mark", "doc_id", "text"), "mark", "doc_id", "text").select("lang", "rank", "text")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([letters(x.as_py()) for x in batch.column(2)], pa.binary())], ["lang", "rank", "text"])

    by: dict[str, list[tuple[int, bytes]]] = {}
    for r in chosen.mapInArrow(plain, "lang string, rank int, text binary").collect():
        by.setdefault(r.lang, []).append((r.rank, bytes(r.text)))
    return Trees({k: b"".join(t for _, t in sorted(v)) for k, v in by.items()})


def predicted(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(trees))  # in proportion to the bounded sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees.__new__(Trees)
        vars(model).update(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [letters(x.as_py()) for x in some.column(2)]
                if not model.languages:
                    texts = [b""] * len(texts)
                bits = model.code_lengths(texts) if model.languages else np.zeros((len(texts), 1))
                best = bits.argmin(axis=1)
                score = 1 / np.exp(-np.clip((bits - bits.min(axis=1, keepdims=True)) * np.log(2) / SCALE, 0, 700)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([model.languages[k] if t else "und" for k, t in zip(best, texts)], pa.string()), pa.array([float(s) if t else 0.0 for s, t in zip(score, texts)], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (sampling.fold(FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(docs: DataFrame) -> DataFrame:
    """Predict the language of every text of ``docs`` from trees of its rows outside the held-out fold."""
    return predicted(docs, train(docs))
