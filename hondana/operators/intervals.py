"""Joins of two tables of places: ranges that overlap, and the last start before a place.

``overlapping`` cuts ranges to bins of a few widths, each 16 times the one before. A range is at home in the narrowest width that isn't narrower than
itself, in two bins at most, and looks in at the wider ones that the other side has at home. Two ranges meet by equality of key, width and bin, in the width of
the longer one, and count in the one bin that holds the later start, so each pair comes once and no range is compared with those far from it.
Bins that very many ranges of the left side share are dealt to several tasks by a digest; those ranges of the right side that are in them go to each.

``as_of`` sorts within stretches of ``STRETCH`` places only; what a stretch begins with is carried from the one before by its last start, a row a
stretch. A document of any length is thus many groups.

Both shuffle rows, never arrays of a document, and read nothing to the driver but which widths occur and the most ranges of a key.

Edge cases: empty ranges and ranges with a null key, start or end overlap nothing; equal ranges each make their pairs; starts below zero are fine; a place without a start at or before it
gets nulls; of several rows with one start the last by all its columns counts; empty tables give what the other side leaves.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits of the widths of bins.
WIDTHS = tuple(range(4, 64, 4))
#: Ranges of the left side in a bin before it is dealt to several tasks.
HOT = 50_000
STRETCH = 16


def _width(start: Column, end: Column) -> Column:
    out = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        out = F.when(end - start <= (1 << w), w).otherwise(out)
    return out


def _bins(side: DataFrame, name: str, keys: tuple[str, ...], given: list[str], other: list[int]) -> DataFrame:
    """One row for each width and bin: w, bin, at_home, and the row itself as a struct ``name``."""
    start, end = (F.col(c).cast("long") for c in ("start", "end"))
    own = _width(start, end)
    rows = side.where((start < end) & reduce(and_, [F.col(k).isNotNull() for k in keys])).select(*[F.col(k).alias(f"_{k}") for k in keys], start.alias("_start"), end.alias("_end"), own.alias("_own"), F.struct(*given).alias(name))
    # Its own width, and the wider ones where the other side has ranges at home.
    widths = F.array_union(F.array("_own"), F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda w: w > F.col("_own")))
    rows = rows.withColumn("_w", F.explode(widths))
    first, last = _shift(F.col("_start"), F.col("_w")), _shift(F.col("_end") - 1, F.col("_w"))
    return rows.withColumn("_bin", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_w") == F.col("_own"))


def _shift(place: Column, width: Column) -> Column:
    """Floor of ``place`` over two to the power of ``width``."""
    out = F.shiftright(place, WIDTHS[-1])
    for w in WIDTHS[:-1]:
        out = F.when(width == w, F.shiftright(place, w)).otherwise(out)
    return out


def overlapping(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc_id",), hot: int = HOT) -> DataFrame:
    """One row (``keys``, left, right: both rows as structs) for every pair with equal keys whose half-open [start, end) overlap."""
    (most, first), (_, second) = _kinds(left, right, keys)
    a = _bins(left, "left", keys, left.columns, second)
    b = _bins(right, "right", keys, right.columns, first)
    at = [f"_{k}" for k in keys] + ["_w", "_bin"]
    side = lambda df, s, name: df.select(*at, "_part", F.col("_start").alias(f"{s}_start"), F.col("_end").alias(f"{s}_end"), F.col("_home").alias(f"{s}_home"), name)
    if most <= hot:  # a bin holds no more ranges than its key
        part = F.lit(0).alias("_part")
        return _pairs(side(a.select("*", part), "l", "left").join(side(b.select("*", part), "r", "right").drop("_part"), at), keys)
    full = a.groupBy(*at).count().where(F.col("count") > hot).select(*at, F.ceil(F.col("count") / hot).cast("int").alias("_parts"))
    a = a.join(full, at, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_start", "_end", "left"), F.col("_parts")).cast("int")))
    b = b.join(full, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return _pairs(side(a, "l", "left").join(side(b, "r", "right"), [*at, "_part"]), keys)


def _kinds(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> list[tuple[int, list[int]]]:
    """For both sides the most ranges that a key has and which widths occur, in one job; a row a side comes to the driver."""
    sides = []
    for k, side in enumerate((left, right)):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), _width(F.col("start").cast("long"), F.col("end").cast("long")))
        each = side.where("start < end").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("bits"))
        sides.append(each.agg(F.lit(k).alias("side"), F.max("n").alias("n"), F.bit_or("bits").alias("bits")))
    rows = sorted(sides[0].union(sides[1]).collect())
    return [(r.n or 0, [w for w in WIDTHS if (r.bits or 0) >> w & 1]) for r in rows]


def _pairs(met: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    pairs = met.where("(l_home or r_home) and l_start < r_end and r_start < l_end").where(F.col("_bin") == _shift(F.greatest("l_start", "r_start"), F.col("_w")))
    return pairs.select(*[F.col(f"_{k}").alias(k) for k in keys], "left", "right")


def as_of(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc_id",), place: str = "place", start: str = "start", name: str = "found") -> DataFrame:
    """``left`` with the row of ``right`` (a struct ``name``, null where there is none) of equal keys whose ``start`` is the last at or before ``place``."""
    kept = [c for c in right.columns if c not in keys]
    there = F.struct(F.col(start).cast("long").alias("_start"), F.struct(*kept).alias("row"))
    starts = right.where(F.col(start).isNotNull()).select(*keys, F.col(start).cast("long").alias("_at"), there.alias("_row"))
    rows = left.select(*keys, F.col(place).cast("long").alias("_at"), F.struct(*left.columns).alias("_left"))
    stretch = F.shiftright("_at", STRETCH).alias("_stretch")
    both = rows.select(*keys, "_at", stretch, "_left", F.lit(None).cast(starts.schema["_row"].dataType).alias("_row")).unionByName(starts.select(*keys, "_at", stretch, F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), "_row"))
    order = Window.partitionBy(*keys, "_stretch").orderBy("_at", F.col("_left").isNotNull(), "_row").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_row", ignorenulls=True).over(order)).where("_left is not null")
    # The last start of each stretch, and for each stretch that of the stretches before it.
    last = starts.groupBy(*keys, stretch).agg(F.max("_row").alias("_last"))
    wanted = near.where("_near is null").select(*keys, "_stretch").distinct()
    steps = last.unionByName(wanted.select(*keys, "_stretch", F.lit(None).cast(starts.schema["_row"].dataType).alias("_last")))
    steps = steps.groupBy(*keys, "_stretch").agg(F.max("_last").alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    carried = steps.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_stretch").alias("_of"), before.alias("_carried")).where("_carried is not null")
    same = reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys]) & (F.col("_stretch") == F.col("_of"))
    found = near.join(carried, same, "left").select("_left.*", F.coalesce("_near", "_carried")["row"].alias(name))
    return found
