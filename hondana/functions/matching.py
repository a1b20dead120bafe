"""Regular-expression matches with their places, as built-in expressions.

``find_all`` is the relational form of "find every match with its offset": matches and the gaps between
them come from two built-ins, and a match's column is the length of all that stands before it. Nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode classes, Unicode case folding, and only \n as a line end.
FLAGS = "(?U)(?u)(?d)"


def pattern(rx: str, ignore_case: bool = False) -> str:
    return FLAGS + ("(?i)" if ignore_case else "") + rx


#: Lengths that are added up one by one before sums of as many are.
CHUNK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _add(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def running_sums(sizes: Column) -> Column:
    """Sums of all that stand before each element: sums of chunks first, so that long arrays cost little more than their length."""

    def placed(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: _add(F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))
        grown = F.aggregate(chunks, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")), lambda a, c: F.struct((a["sum"] + c).alias("sum"), F.array_append(a["all"], a["sum"]).alias("all")))["all"]
        return bound(grown, lambda before: F.transform(x, lambda _, k: before[F.floor(k / CHUNK).cast("int")] + _add(F.slice(x, k - k % CHUNK + 1, k % CHUNK))))

    return F.when(F.size(sizes) > 0, bound(sizes, placed)).otherwise(F.array().cast("array<int>"))


def find_all(line: Column, rx: str | Column) -> Column:
    """array<struct<col:int,matched:string>>: 1-based code-point columns of all matches, zero-width ones too."""
    rule = F.lit(rx) if isinstance(rx, str) else rx
    # One cheap test first: most lines match nothing.
    return F.when(F.rlike(line, rule), placed_matches(line, rule)).otherwise(F.array().cast("array<struct<col:int,matched:string>>"))


def placed_matches(line: Column, rule: Column) -> Column:
    """:func:`find_all` of a line that is known to match."""

    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        lengths = F.transform(found, lambda m, k: F.length(m) + F.length(gaps[k]))
        return bound(running_sums(lengths), lambda before: F.transform(found, lambda m, k: F.struct((before[k] + F.length(gaps[k]) + 1).alias("col"), m.alias("matched"))))

    def single(both: Column) -> Column:
        return F.array(F.struct((F.length(both["gaps"][0]) + 1).alias("col"), both["found"][0].alias("matched")))

    both = F.struct(F.regexp_extract_all(line, rule, F.lit(0)).alias("found"), F.split(line, rule, -1).alias("gaps"))
    return bound(both, lambda b: F.when(F.size(b["found"]) == 1, single(b)).otherwise(placed(b)))


def first_match(text: Column, rx: str) -> Column:
    """struct<col:int,matched:string> of the first match, null if there is none."""
    hit = F.regexp_extract(text, rx, 0)
    before = F.split(text, rx, 2)[0]
    return F.when(F.rlike(text, F.lit(rx)), F.struct((F.length(before) + 1).alias("col"), hit.alias("matched")))


def matches(lines: DataFrame, rx: str, on: str = "line", keep: tuple[str, ...] = ("doc_id", "n", "line")) -> DataFrame:
    """One row per match: the columns ``keep``, col, matched, and k (0-based number within the line)."""
    at = F.posexplode(find_all(F.col(on), rx)).alias("k", "at")
    return lines.select(*keep, at).select(*keep, "k", "at.col", "at.matched")


def folded(text: Column) -> Column:
    """``text`` with all cases of a letter made one; the dot that lower-casing leaves of a capital dotted I goes."""
    return F.replace(F.lower(F.upper(text)), F.lit("\u0307"), F.lit(""))


def folded_text(text: str) -> str:
    return text.upper().lower().replace("\u0307", "")


def needle(literal: str) -> tuple[str, ...]:
    """What a line must hold, in any case, for a literal pattern to match; nothing for other patterns."""
    return (folded_text(literal),) if re.escape(literal) == literal or literal.isalnum() else ()


@dataclass(frozen=True)
class Probe:
    """A literal pattern and the column it is looked for in; a line without any of its ``needles`` (folded) has none, nor one outside of ``within``.

    ``test`` is a quicker pattern that matches the same lines.
    """

    rx: str
    needles: tuple[str, ...] = ()
    on: str = "line"
    within: str | None = None
    test: str | None = None


def rule_matches(lines: DataFrame, probes: list[Probe]) -> DataFrame:
    """``lines`` with one row per match of any probe: variant (number of the probe), col, matched.

    Every line is tested against all patterns as literals, compiled once a task; a pattern with ``needles`` only if the line holds one of them. Only
    where a pattern matches is the line
    taken apart, by one expression for all, so plans stay small however many rules there are.
    """

    def cased(x: str) -> bool:
        return x != x.upper() or x != x.lower()

    # Without letters a needle is looked for as the line stands: folding a line costs more than most tests.
    rows = lines
    for on in sorted({p.on for p in probes if any(map(cased, p.needles))}):
        rows = rows.withColumn(f"_folded_{on}", folded(F.col(on)))

    def test(p: Probe) -> Column:
        hit = F.col(p.on).rlike(p.test or p.rx)
        if p.needles:
            hit = reduce(or_, [F.contains(F.col(f"_folded_{p.on}" if cased(x) else p.on), F.lit(x)) for x in p.needles]) & hit
        return F.col(p.within) & hit if p.within else hit

    # Compiled as a whole: a lambda over the tests would have them all interpreted, line by line.
    hit = F.array_remove(F.array(*[F.when(test(p), F.lit(k)).otherwise(-1) for k, p in enumerate(probes)]), F.lit(-1))
    rows = rows.withColumn("variant", F.explode(hit)).drop(*[c for c in rows.columns if c.startswith("_folded_")])
    rx = F.element_at(F.array(*[F.lit(p.rx) for p in probes]), F.col("variant") + 1)
    ons = sorted({p.on for p in probes})
    text = F.col(ons[0])
    for on in ons[1:]:
        text = F.when(F.col("variant").isin(*[k for k, p in enumerate(probes) if p.on == on]), F.col(on)).otherwise(text)
    rows = rows.withColumn("_text", text)
    return rows.withColumn("at", F.explode(placed_matches(F.col("_text"), rx))).select("*", "at.*").drop("at", "_text")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def char_at(text: Column, place: Column) -> Column:
    """The character at a 1-based place; empty before the start and past the end."""
    return F.when(place >= 1, F.substr(text, place, F.lit(1))).otherwise(F.lit(""))
