"""Matches of many literal terms: one automaton for all of them, whatever their number.

The terms are a table. A task builds the automaton once and reads every text once, so time grows with the text and its matches, not with the terms. Terms beyond
``BLOCK`` characters go in blocks, which read the rows one after the other as they stream by (``BLOCKS`` of them at most, an error beyond: nothing larger goes to every task); each term's own
matches, all, or the leftmost longest are told from the matches of all blocks together. Letters match in any case, one for one, so places are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the terms of a pass.
BLOCK = 8_000_000
BLOCKS = 16
#: Matches that a task gathers before it passes them on, but for those of one text.
HELD = 50_000
MODES = ("each", "all", "longest")


class _OneCase(dict):
    """For str.translate: every case of a letter as one, never more than one character for one."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper()
        low = (up if len(up) == 1 else c).lower()
        self[code] = ord(low[0]) if len(low) == 1 or c == "İ" else code
        return self[code]


_ONE_CASE = _OneCase()


def one_case(text: str) -> str:
    return text.translate(_ONE_CASE)


class Automaton:
    """States are numbers; ``go`` holds the edges of the tree of terms by (state, character), ``back`` the state of the longest ending of a state that is one itself."""

    def __init__(self, terms: list[str]):
        self.go: dict[tuple[int, str], int] = {}
        self.back, self.ends, self.next_end, self.sizes = [0], [-1], [-1], [len(t) for t in terms]
        parents: list[tuple[int, str]] = [(0, "")]
        for number, term in enumerate(terms):
            state = 0
            for c in term:
                after = self.go.get((state, c))
                if after is None:
                    after = self.go[state, c] = len(self.back)
                    self.back.append(0)
                    self.ends.append(-1)
                    self.next_end.append(-1)
                    parents.append((state, c))
                state = after
            if term:
                self.ends[state] = number
        depth = [0] * len(parents)
        for state in range(1, len(parents)):
            depth[state] = depth[parents[state][0]] + 1
        for state in sorted(range(1, len(parents)), key=depth.__getitem__):
            parent, c = parents[state]
            if parent:
                at = self.back[parent]
                while at and (at, c) not in self.go:
                    at = self.back[at]
                self.back[state] = self.go.get((at, c), 0)
            behind = self.back[state]
            self.next_end[state] = behind if self.ends[behind] >= 0 else self.next_end[behind]

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, number of the term) of every match, by their ends, the longer of one end first."""
        state, go, back = 0, self.go, self.back
        for k, c in enumerate(text, 1):
            after = go.get((state, c))
            while after is None and state:
                state = back[state]
                after = go.get((state, c))
            state = after or 0
            end = state if self.ends[state] >= 0 else self.next_end[state]
            while end > 0:
                yield k - self.sizes[self.ends[end]], self.ends[end]
                end = self.next_end[end]


def each_apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, size, term): of each term the matches that a scan from the left finds, none within the one before it."""
    out, until = [], {}
    for start, size, term in sorted(found):
        if start >= until.get(term, 0):
            out.append((start, size, term))
            until[term] = start + size
    return out


def leftmost_longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The matches of a scan from the left that takes the longest term at each place and goes on behind it."""
    out, until = [], 0
    for start, size, term in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= until:
            out.append((start, size, term))
            until = start + size
    return out


_RESOLVE = {"each": each_apart, "all": sorted, "longest": leftmost_longest}


def resolved(found: list[tuple[int, int, str]], mode: str) -> list[tuple[int, int, str]]:
    """What a ``mode`` leaves of all matches (start, size, term)."""
    return _RESOLVE[mode](found)


def _blocks(terms: DataFrame, block: int) -> Iterator[list[tuple[str, str]]]:
    """(term in one case, term) in order, at most ``block`` characters at a time."""
    held, size = [], 0
    for r in terms.orderBy("term").toLocalIterator():
        if held and size + len(r.term) > block:
            yield held
            held, size = [], 0
        held.append((one_case(r.term), r.term))
        size += len(r.term)
    if held:
        yield held


def term_matches(texts: DataFrame, terms: DataFrame, on: str = "line", mode: str = "each", block: int = BLOCK) -> DataFrame:
    """``texts`` with one row per match of a term (column ``term`` of ``terms``): col (1-based), matched, term.

    Terms are taken without repeats; null and empty ones match nothing, as does a null text. Terms that differ only in case are one place's matches each.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    given = terms.where("term is not null and term != ''").select("term").distinct()
    blocks = list(islice(_blocks(given, block), BLOCKS + 1))
    if len(blocks) > BLOCKS:
        raise ValueError(f"more than {BLOCKS} blocks of {block} characters of terms: search for parts of the dictionary")
    names, kind = [*texts.columns, "_found"], "array<struct<start:int,size:int,term:string>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields) + f", _found {kind}"
    found = texts.withColumn("_found", F.array().cast(kind))
    for number, some in enumerate(blocks):
        found = found.mapInArrow(_search(some, names.index(on), names, mode if number == len(blocks) - 1 else "all"), schema)
    names.pop()
    at = F.explode("_found").alias("_at")
    matched = F.substr(F.col(on), F.col("_at.start") + 1, F.col("_at.size"))
    return found.select(*names, at).select(*names, (F.col("_at.start") + 1).alias("col"), matched.alias("matched"), F.col("_at.term").alias("term"))


def _search(some: list[tuple[str, str]], at: int, names: list[str], mode: str):
    """Adds the matches of a block of terms to those known, and leaves of all together what ``mode`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt: dict[str, list[str]] = {}
        for folded, term in some:
            spelt.setdefault(folded, []).append(term)
        words = list(spelt)
        automaton = Automaton(words)
        for batch in batches:
            first, held = 0, _Held()
            for k in range(batch.num_rows):
                text, known = batch.column(at)[k].as_py() or "", batch.column(len(names) - 1)[k].as_py()
                new = [(start, len(words[n]), term) for start, n in automaton.matches(one_case(text)) for term in spelt[words[n]]]
                held.add(_RESOLVE[mode]([(x["start"], x["size"], x["term"]) for x in known] + new if known else new))
                if len(held.starts) >= HELD:  # a batch of long texts has more matches than a worker should hold at once
                    yield _joined(batch.slice(first, k + 1 - first), held, names)
                    first, held = k + 1, _Held()
            if first < batch.num_rows:
                yield _joined(batch.slice(first), held, names)

    return run


class _Held:
    """Matches of some rows, a list for each of their parts."""

    def __init__(self):
        self.offsets: list[int] = [0]
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.terms: list[str] = []

    def add(self, found: list[tuple[int, int, str]]) -> None:
        for start, size, term in found:
            self.starts.append(start)
            self.sizes.append(size)
            self.terms.append(term)
        self.offsets.append(len(self.starts))


def _joined(rows: pa.RecordBatch, held: _Held, names: list[str]) -> pa.RecordBatch:
    parts = [pa.array(held.starts, pa.int32()), pa.array(held.sizes, pa.int32()), pa.array(held.terms, pa.string())]
    found = pa.ListArray.from_arrays(pa.array(held.offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "size", "term"]))
    return pa.RecordBatch.from_arrays([*rows.columns[:-1], found], names)
