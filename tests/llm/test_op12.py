"""Divergence of sources against plain counting, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from hondana.llm import op12_divergence as m
from hondana.llm import scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(autouse=True)
def _clean():
    yield
    scratch.release()


def plain(rows, least, top):
    """rows: (text, lang, source)."""
    fold = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(fold))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in held if held[t] >= least)
        count = defaultdict(Counter)
        for _, source, ts in mine:
            count[source].update(t for t in ts if held[t] >= least)
        whole = sum(count.values(), Counter())

        def p(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        q = p(whole)
        for a in count:
            pa = p(count[a])
            pairs = [(b, sum(abs(pa[t] - pb[t]) for t in kept)) for b in count if b != a for pb in [p(count[b])]]
            best = [(t, pa[t] - q[t]) for t in kept if count[a][t] and pa[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, a, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def docs_of(spark, rows):
    table = [(k, *r, "z", 1, 2) for k, r in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, term string, n int, value long")


def random_rows(n, seed, sources=6):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "of", "é", "É", "漢字", "🔍x", "a1b", "x-y", "Ünï", "it's", "ſ", "İ", "\x80z", "", "   ", "1 2 3"]
    return [(" ".join(rng.choice(words) + rng.choice(["", ",", str(rng.randrange(30))]) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice([None, *map(str, range(sources))])) for _ in range(n)]


def test_divergence_is_the_plain_one(spark):
    rows = random_rows(900, 1)
    got = sorted(map(tuple, m.op12_divergence(docs_of(spark, rows), least=30).collect()))
    assert got == plain(rows, 30, 50) and {r[2] for r in got} == {"pair", "term"}


def test_blocks_of_groups_and_small_batches(spark, monkeypatch):
    """Groups in several blocks, slices of one term, tasks that pass their sums on early, ranks cut at ties."""
    monkeypatch.setattr(m, "PAIRS", 1)
    rows = random_rows(300, 2, sources=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, m.op12_divergence(docs_of(spark, rows), least=9, top=3, block=3, held=5, run=4).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows, 9, 3)


def test_odd_documents(spark, odd, empty):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    for least in (1, 2, 30):
        assert sorted(map(tuple, m.op12_divergence(odd, least=least).collect())) == plain(rows, least, 50)
    assert m.op12_divergence(empty).collect() == []
    alone = m.op12_divergence(docs_of(spark, [(None, None, None), (None, "x", "b"), ("", "x", "a")])).collect()
    assert sorted(map(tuple, alone)) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]
