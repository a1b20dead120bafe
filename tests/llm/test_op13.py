"""Lloyd rounds against Python integers, and on odd rows."""

import hashlib
import math
import random

import pytest

from hondana.llm import op13_lloyd as m
from hondana.llm import scratch

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string"


@pytest.fixture(autouse=True)
def _clean():
    yield
    scratch.release()


def plain(rows, k=16, rounds=3):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(fine, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        mine = [[v for _, v in fine if nearest(v)[1] == n] for n in range(len(centres))]
        centres = [[sum(c) // len(vs) for c in zip(*vs)] if vs else old for vs, old in zip(mine, centres)]
    out = [(i, *nearest(v)[::-1]) for i, v in fine]
    of = [sum(d for _, n, d in out if n == k) for k in range(len(centres))]
    return sorted(((i, n, d, of[n], sum(of), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, n, d in out), key=repr)


def found(spark, rows):
    return sorted(map(tuple, m.op13_lloyd(spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(3)).collect()), key=repr)


def test_rounds_are_the_plain_ones(spark):
    rng = random.Random(4)
    rows = [(k * 7 - 300, [rng.gauss(k % 5 - 2, 0.3) for _ in range(64)]) for k in range(150)]
    got = found(spark, rows)
    assert got == plain(rows) and len({r[1] for r in got}) > 3


def test_odd_vectors(spark):
    rng = random.Random(5)
    some = [rng.uniform(-1, 1) for _ in range(64)]
    ties = [[float(s)] * 64 for s in (-1, 1)]
    large = [4e6 * x for x in some]
    rows = [(1, None), (2, []), (3, some[:63]), (4, [*some[:63], None]), (5, [*some[:63], float("nan")]), (6, [*some[:63], float("inf")]), (7, some), (7, some), (7, ties[0]), (None, some), (8, ties[0]), (9, ties[1]), (10, [0.0] * 64), (11, [-0.0] * 64), (12, large)]
    got = found(spark, rows)
    assert got == plain(rows) and sum(r[0] == 7 for r in got) == 3
    many = rows + [(100 + k, [x + k / 8 for x in some]) for k in range(20)]
    assert found(spark, many) == plain(many)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e300] * 64), (2, [-1e9] * 64)])
