"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-cased letters and digits with single spaces. An item of n
characters may appear with up to ``k = n // SPACING`` edits. Split into k + 1 pieces, at least one piece of any
such appearance is untouched, so exact hits of pieces (one Aho-Corasick automaton over all of them) give all
candidates. Each candidate's stretch of text, the item's length and k to both sides of where the hit puts it,
is verified with Myers' bit-parallel distance, the item's characters in the bits of one integer; the best end position
within k edits is a match, its start the nearest one at that distance. An item of fewer than ``SHORT`` characters must appear unedited, as whole words.

The items travel to the workers in blocks of ``BLOCK`` characters, each a pass over the texts whose result is a table before the next
block is read, so that no broadcast and nothing on the driver exceeds that size whatever the benchmark holds.

Edge cases: null and empty texts match nothing, nor do items that are null or without letters and digits; matches of one item
in a text don't overlap, the first counts; equal items match under each item_id; rows of ``docs`` come out once each in
:func:`clean`; an empty benchmark matches nothing, empty ``docs`` give no rows; texts of any length are searched whole; other columns are ignored unless kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hondana.llm import scratch
from hondana.llm.worker import kept

SPACING = 20
SHORT = 40
BLOCK = 8_000_000

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower-cased letters and digits, every run of anything else as one space, none at the ends."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(n: int, spacing: int = SPACING) -> int:
    """Edits allowed in an item of ``n`` characters."""
    return n // spacing if n >= SHORT else 0


def pieces(item: str, spacing: int = SPACING) -> list[tuple[int, str]]:
    """Start and text of budget + 1 pieces of nearly equal length."""
    parts = budget(len(item), spacing) + 1
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """For every character the bits of its places in ``item``."""
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(item_masks: dict[str, int], n: int, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of the item to any substring of ``text``, and where the first such one ends; None if over ``most``.

    Myers' recurrence on vertical differences, one bit per item character, with a free start in the text.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, None
    for at, c in enumerate(text):
        eq = item_masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
            if not score:
                break
    return best


def nearest_start(item: str, text: str, stop: int, edits: int) -> int:
    """Start of the shortest stretch of ``text`` that ends at ``stop`` and is ``edits`` from the item: the recurrence from the end back, with a fixed start."""
    n = len(item)
    item_masks, full, top = masks(item[::-1]), (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    for at in range(stop - 1, max(-1, stop - 1 - n - edits), -1):
        eq = item_masks.get(text[at], 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score == edits:
            return at
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
    return max(0, stop - n)


class Matcher:
    """All pieces of some items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], spacing: int = SPACING):
        import ahocorasick

        self.items, where = items, {}
        for k, (_, item) in enumerate(items):
            for at, piece in pieces(item, spacing):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.masks = [masks(item) for _, item in items]
        self.spacing = spacing

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, start, end, edits of every match in a normalised text."""
        if not self.items or not text:
            return []
        wanted: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, at in places:
                wanted.setdefault(k, set()).add(end + 1 - length - at)
        out = []
        for k, starts in wanted.items():
            item_id, item = self.items[k]
            n, most, free = len(item), budget(len(item), self.spacing), 0
            for start in sorted(starts):
                if start + most < free:
                    continue
                low = max(free, start - most)
                if start >= free and text.startswith(item, start):
                    if n < SHORT and not (text[start - 1 : start] in ("", " ") and text[start + n : start + n + 1] in ("", " ")):
                        continue
                    found = (start, start + n, 0)
                elif most and (best := myers(self.masks[k], n, text[low : start + n + most], most)):
                    stop = low + best[1]
                    found = (max(low, nearest_start(item, text, stop, best[0])), stop, best[0])
                else:
                    continue
                out.append((item_id, *found))
                free = found[1]
        return out


def _matcher(items: list[tuple[int, str]], spacing: int) -> Matcher:
    return kept("matcher", f"{len(items)} {hash(tuple(items))} {spacing}", lambda: Matcher(items, spacing))


def matches(docs: DataFrame, benchmark: DataFrame, spacing: int = SPACING, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end, edits (places in the normalised text) of every match."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, edits int"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    path = scratch.folder(spark, "matches")
    spark.createDataFrame([], schema).write.parquet(path)
    for items in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, spacing)
            for batch in batches:
                ids, rows = [], []
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    if hits := matcher.matches(normal(text.as_py())):
                        ids += [doc_id.as_py()] * len(hits)
                        rows += hits
                columns = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.int32())], ["doc_id", "item_id", "start", "end", "edits"])

        texts.mapInArrow(match, schema).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, read in order of item_id and handed on ``block`` characters at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        item = normal(r.text)
        if not item:
            continue
        if rows and size + len(item) > block:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, item))
        size += len(item)
    if rows:
        yield rows


def clean(docs: DataFrame, benchmark: DataFrame, spacing: int = SPACING, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item of ``benchmark`` appears.

    One pass per block of items decides row by row, so copies of a doc_id with other texts are judged by their own; between blocks the rows kept are a table.
    """
    names, left, shared = docs.columns, docs, None
    for items in _blocks(benchmark, block):
        if shared is not None:
            left = scratch.write(left, "clean")
            shared.destroy()
        shared, at = docs.sparkSession.sparkContext.broadcast(items), names.index("text")

        def judge(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, spacing)
            for batch in batches:
                yield batch.filter(pa.array(np.array([not matcher.matches(normal(x.as_py())) for x in batch.column(at)], bool)))

        left = left.mapInArrow(judge, docs.schema)
    return left


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every match of an item in a text: doc_id, item_id, start, end, edits."""
    return matches(docs, benchmark)
