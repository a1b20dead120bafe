"""Stages on a small corpus, each judged on its own input, and the whole run."""

import random

import corpus_pipeline
import pytest
from hondana.llm import op5_simhash, scratch
from tests.llm.conftest import ODD

DATA = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def _clean():
    yield
    scratch.release()


def test_stages(spark, tmp_path, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 300")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    clean = {d for d in texts if labels.get(d) == 0}
    assert len(clean - ids["toxicity"]) <= 0.05 * len(clean)
    first = {}
    for d in sorted(ids["toxicity"]):
        first.setdefault(texts[d], d)
    assert len({texts[d] for d in ids["near_duplicates"]}) == len(ids["near_duplicates"]) and ids["near_duplicates"] <= set(first.values())
    leaks = {d for d in ids["near_duplicates"] if any(i in texts[d] for i in items)}
    assert not leaks & ids["decontamination"] and ids["decontamination"] >= ids["near_duplicates"] - leaks
    assert all(r.text == texts[r.doc_id] for r in seen["mixing"]) and len(seen["token_ids"]) == len(seen["mixing"])
    assert sum(r.n_tokens for r in seen["token_ids"]) == max(r.start + r.n_tokens for r in seen["token_ids"])
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert set(seen[name][0].asDict()) == set(corpus_pipeline.COLUMNS)


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeats and clashing columns: what each stage keeps."""
    kept = {name: [(r.doc_id, r.text) for r in stage(spark, odd, DATA).select("doc_id", "text").collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    rows = sorted(((r[0], r[1]) for r in ODD), key=str)
    assert sorted(kept["toxicity"], key=str) == rows and sorted(kept["decontamination"], key=str) == rows
    by_id = {r[0]: r[1] for r in ODD}
    assert sorted(kept["near_duplicates"], key=str) == sorted(((d, by_id[d]) for d in (0, 3, 5, 6, 7, None)), key=str)  # blank texts are alike, as are 3, 3 and 4
    assert set(kept["mixing"]) <= set(rows) and all(t and t.strip() for _, t in kept["mixing"])
    ids = corpus_pipeline.STAGES[-1][1](spark, odd, DATA).collect()
    assert sorted((str(r.doc_id) for r in ids)) == sorted(str(r[0]) for r in ODD) and min(r.n_tokens for r in ids) == 1


def test_stages_on_empty_tables(spark, empty, tmp_path):
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, str(tmp_path))
        assert got.collect() == [] and (name == "token_ids" or set(got.columns) == set(corpus_pipeline.COLUMNS)), name
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:3]:
        assert stage(spark, docs, str(tmp_path)).count() == 20, name  # nothing is learnt, so nothing goes


def test_run_is_the_stages_and_spares_other_results(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    groups = op5_simhash.op5_simhash(docs)  # lazy: its tables must outlive the pipeline
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, "/root/testdata/sf0.001")
        if "n_tokens" not in want.columns:
            want = scratch.write(want, "kept")
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, want.collect())) and result.count() > 50
    assert groups.count() == docs.count()


def test_near_duplicates_are_all_found(spark):
    """Recall and precision against all pairs at the similarity asked for, on thousands of documents."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(900):
        base = [rng.choice(words) for _ in range(rng.randrange(40, 160))]
        texts.append(base)
        for _ in range(rng.randrange(0, 3)):
            near = list(base)
            for k in rng.sample(range(len(base)), rng.randrange(0, max(1, len(base) // 25) + 1)):
                near[k] = rng.choice(words)
            texts.append(near)
    rng.shuffle(texts)
    sets = [frozenset(zip(*[t[k:] for k in range(5)])) for t in texts]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in {(x, y) for h in holders.values() for x in h for y in h if x < y}:  # pairs without a shingle in common have similarity 0
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {k for k in range(len(texts)) if find(k) == k}
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()} == want and len(texts) - len(want) > 300


def test_near_duplicates_come_from_fingerprints(spark, monkeypatch):
    """The stage takes its first pairs from SimHash by segment counts: those within two bits, compared with all pairs; the exact check measures them."""
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(12)]
    texts = base + [f"{t} w{k}" for k, t in enumerate(base)] + [t.replace(" ", "  ") for t in base]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    seen, plain = [], op5_simhash.hash_links

    def told(given):
        seen.append((sorted(map(tuple, given.collect())), plain(given)))
        return seen[-1][1]

    monkeypatch.setattr(op5_simhash, "hash_links", told)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()} == set(range(12))
    (given, found), = seen
    assert [dict(given)[k] for k in sorted(dict(given))] == [fp for _, fp in given] and {fp for _, fp in given} == {op5_simhash._signed(op5_simhash.fingerprint(t, corpus_pipeline.SHINGLE)) for t in texts}
    edges = {frozenset((r.a, r.b)) for r in found.collect()}
    near = {frozenset((a, b)) for a, x in given for b, y in given if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}
    assert edges == near and len(near) >= 3


def test_scratch_folders(spark, tmp_path):
    """The session's checkpoint folder comes first; owners' tables go alone."""
    with scratch.owner("a"):
        mine = scratch.write(spark.range(3), "x")
    other = scratch.write(spark.range(4), "y")
    scratch.release("a")
    assert other.count() == 4
    with pytest.raises(Exception):
        mine.count()
