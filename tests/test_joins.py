"""Interval and as-of joins and the dictionary automaton, against plain loops."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hondana.functions import dictionary
from hondana.operators import intervals, notation

PLACES = "doc_id long, start long, end long, k int"


def ranges(rng, n, docs=3, most=5000):
    out = []
    for k in range(n):
        start = rng.randrange(-50, most)
        size = rng.choice([0, 1, 1, 5, 15, 16, 17, 200, 4097, rng.randrange(most)])
        out.append((rng.choice([*range(docs), None]), rng.choice([start] * 9 + [None]), start + size, k))
    return out


@pytest.mark.parametrize("seed, hot", [(1, 50_000), (2, 3)])
def test_overlaps_are_all_pairs(spark, seed, hot):
    """Widths from one place to all, ties, empty and null ranges; bins dealt to several tasks."""
    rng = random.Random(seed)
    a, b = ranges(rng, 150), ranges(rng, 150)
    want = sorted((x[3], y[3]) for x in a for y in b if None not in (*x, *y) and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    left, right = spark.createDataFrame(a, PLACES), spark.createDataFrame(b, PLACES)
    got = intervals.overlapping(left, right, hot=hot)
    assert sorted((r.left.k, r.right.k) for r in got.collect()) == want and len(want) > 300
    assert intervals.overlapping(left.limit(0), right).collect() == [] and intervals.overlapping(left, right.limit(0)).collect() == []


def test_overlaps_by_several_keys_and_far_places(spark):
    a = spark.createDataFrame([("x", 1, 2**40, 2**40 + 3, "left"), ("x", 2, 0, 9, "left")], "name string, doc_id long, start long, end long, _w string")
    b = spark.createDataFrame([("x", 1, -(2**41), 2**41, "wide"), ("y", 1, 0, 2**41, "no"), ("x", 2, 9, 10, "beside")], "name string, doc_id long, start long, end long, _bin string")
    rows = intervals.overlapping(a, b, ("name", "doc_id")).collect()
    assert [(r.name, r.doc_id, r.left._w, r.right._bin) for r in rows] == [("x", 1, "left", "wide")]


@pytest.mark.parametrize("stretch", [16, 3])
def test_as_of_is_the_last_start(spark, monkeypatch, stretch):
    monkeypatch.setattr(intervals, "STRETCH", stretch)
    rng = random.Random(stretch)
    a = [(rng.randrange(3), rng.choice([None, *range(-20, 400)]), k) for k in range(200)]
    b = [(rng.randrange(4), rng.choice([None, *range(-10, 390)]), k) for k in range(12)]
    left, right = spark.createDataFrame(a, "doc_id long, place long, k int"), spark.createDataFrame(b, "doc_id long, start long, k int")
    got = {r.k: (r.found.start, r.found.k) if r.found else None for r in intervals.as_of(left, right).collect()}
    plain = {k: max(((s, j) for e, s, j in b if e == d and s is not None and p is not None and s <= p), default=None) for d, p, k in a}
    assert got == plain and None in plain.values()
    assert all(r.found is None for r in intervals.as_of(left, right.limit(0)).collect()) and intervals.as_of(left.limit(0), right).collect() == []


TERMS = st.lists(st.text(alphabet="abAB鶏İſé", min_size=1, max_size=4), min_size=1, max_size=8, unique=True)
TEXT = st.text(alphabet="abAB鶏iIsSéÉ \n", max_size=40)


@settings(max_examples=300, deadline=None)
@given(TERMS, TEXT)
def test_automaton_finds_every_place(terms, text):
    words = sorted({dictionary.one_case(t) for t in terms})
    folded = dictionary.one_case(text)
    got = sorted(dictionary.Automaton(words).matches(folded))
    assert got == sorted((k, n) for n, w in enumerate(words) for k in range(len(text)) if folded.startswith(w, k))
    apart = dictionary.each_apart([(s, len(words[n]), words[n]) for s, n in got])
    assert sorted(apart) == sorted((m.start(), len(w), w) for w in words for m in re.finditer(re.escape(w), folded))
    longest = dictionary.leftmost_longest([(s, len(words[n]), words[n]) for s, n in got])
    assert [(s, w) for s, _, w in longest] == [(m.start(), m.group()) for m in re.finditer("|".join(map(re.escape, sorted(words, key=len, reverse=True))), folded)]


@pytest.mark.parametrize("mode", dictionary.MODES)
def test_term_matches(spark, mode):
    """Blocks of one term give what one automaton gives; repeats, nulls and terms of other cases."""
    texts = spark.createDataFrame([(1, "aXbaxB 鶏鶏鶏 aaaa", 9), (2, None, 9), (3, "", 9)], "doc_id long, line string, term int").select("doc_id", "line", F_col("term").alias("_found2"))
    terms = spark.createDataFrame([("ax",), ("AXB",), ("鶏鶏",), ("aa",), ("aa",), ("",), (None,), ("zz",)], "term string")
    rows = [sorted((r.doc_id, r.col, r.matched, r.term) for r in dictionary.term_matches(texts, terms, mode=mode, block=b).collect()) for b in (1000, 3)]
    assert rows[0] == rows[1]
    assert {(c, m) for _, c, m, _ in rows[0]} == {
        "each": {(1, "aX"), (1, "aXb"), (4, "ax"), (4, "axB"), (8, "鶏鶏"), (12, "aa"), (14, "aa")},
        "all": {(1, "aX"), (1, "aXb"), (4, "ax"), (4, "axB"), (8, "鶏鶏"), (9, "鶏鶏"), (12, "aa"), (13, "aa"), (14, "aa")},
        "longest": {(1, "aXb"), (4, "axB"), (8, "鶏鶏"), (12, "aa"), (14, "aa")},
    }[mode]
    assert dictionary.term_matches(texts, terms.limit(0), mode=mode).collect() == [] and dictionary.term_matches(texts.limit(0), terms, mode=mode).collect() == []
    with pytest.raises(ValueError, match="blocks"):
        dictionary.term_matches(texts, spark.range(40).selectExpr("cast(id as string) as term"), block=1)


@pytest.mark.parametrize("mode", dictionary.MODES)
def test_a_worker_holds_few_matches_at_once(monkeypatch, mode):
    """A batch with many matches comes out in pieces, rows in order and whole, whatever their number."""
    import pyarrow as pa

    monkeypatch.setattr(dictionary, "HELD", 100)
    texts = ["ab" * (k % 7 * 20) for k in range(200)] + [None, "", "x"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("term", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([[]] * len(texts), kind)], ["doc_id", "text", "_found"])
    pieces = list(dictionary._search([("ab", "ab"), ("b", "B")], 1, batch.schema.names, mode)(iter([batch])))
    rows = [r for p in pieces for r in p.to_pylist()]
    automaton = dictionary.Automaton(["ab", "b"])
    want = [dictionary.resolved([(s, (2, 1)[n], ("ab", "B")[n]) for s, n in automaton.matches(t or "")], mode) for t in texts]
    assert [[(x["start"], x["size"], x["term"]) for x in r["_found"]] for r in rows] == want
    assert [r["doc_id"] for r in rows] == list(range(len(texts))) and [r["text"] for r in rows] == texts
    assert len(pieces) > 50 and max(sum(map(len, p.column(2).to_pylist())) for p in pieces) < 100 + 240


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_translations_are_those_of_one_rule_each(spark):
    """The table form gives the issues of a regular expression a term, in their order of emission."""
    given = {"比較": "対比", "AB": "ab", "ab": "AB", "a.b": "x", "プロンプト": "指示"}
    lines = [(1, k, t, t) for k, t in enumerate(["比較と比較案", "abAB aB a.b A.Bab", "漢比較", "プロンプトぷ", "", "axb"], 1)]
    table = spark.createDataFrame(lines, "doc_id long, n int, line string, masked string")
    by_rules = notation.check_notation_blog(table, notation.translation_rules(given))
    by_table = notation.check_translations(table, notation.dictionary_table(spark, given))
    assert sorted(map(tuple, by_table.collect()), key=repr) == sorted(map(tuple, by_rules.collect()), key=repr) and by_rules.count() >= 8


def test_time_is_flat_in_the_number_of_terms():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    text = " ".join(word() for _ in range(20_000))
    took = []
    for n in (40, 10_000):
        automaton = dictionary.Automaton(sorted({word() for _ in range(n)}))
        start = time.process_time()
        sum(1 for _ in automaton.matches(text))
        took.append(time.process_time() - start)
    assert took[1] < 4 * took[0]


def test_sql_functions_give_what_the_library_gives(spark):
    """Lateral joins and scalar functions from SQL, on nulls too."""
    from hondana.functions import article, markdown
    from hondana.plans.sql_functions import register

    texts = ["# 一 `x`\n\n本文 **b** <b>t</b>\n\n二\n==\n", "", None, "import x\n\n比較 eufy と比較案 EUFY\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").createOrReplaceTempView("texts_of_test")
    register(spark)
    rows = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    given = [(k, t) for k, t in enumerate(texts) if t is not None]
    assert rows("SELECT d.doc_id, r.* FROM texts_of_test d, LATERAL markdown_ranges(d.text) r") == [(k, a, b) for k, t in given for a, b in markdown.parse(t).ranges]
    assert rows("SELECT d.doc_id, h.* FROM texts_of_test d, LATERAL markdown_headings(d.text) h") == [(0, 1, 1, "一 `x`"), (0, 5, 2, "二")]
    assert rows("SELECT doc_id, mask_markdown(text), article_text(text) FROM texts_of_test WHERE doc_id != 2") == [(k, markdown.parse(t).masked, article.extract_article(t)) for k, t in given]
    assert [tuple(r) for r in spark.sql("SELECT mask_markdown(text), article_text(text) FROM texts_of_test WHERE doc_id = 2").collect()] == [(None, None)]
    found = rows("SELECT d.doc_id, t.* FROM texts_of_test d, LATERAL term_places(d.text, array('比較', '比較案', 'eufy', NULL, ''), 'longest') t")
    assert found == [(3, 11, "比較", "比較"), (3, 14, "eufy", "eufy"), (3, 20, "比較案", "比較案"), (3, 24, "EUFY", "eufy")]
    assert rows("SELECT d.doc_id, t.* FROM texts_of_test d, LATERAL term_places(d.text, CAST(NULL AS ARRAY<STRING>), 'all') t") == []
    with pytest.raises(Exception, match="mode must be"):
        spark.sql("SELECT * FROM term_places('a', array('a'), 'odd')").collect()


def test_few_ranges_a_key_move_once(spark):
    """Where no key has more ranges than a full bin, each side is shuffled once, for the join; results are those of dealt bins."""
    rng = random.Random(5)
    rows = lambda n: [(rng.randrange(4), a := rng.randrange(3000), a + rng.choice((0, 1, 7, 40, 700))) for _ in range(n)]
    left, right = (spark.createDataFrame(rows(n), "doc_id long, start long, end long") for n in (300, 200))
    plain = intervals.overlapping(left, right)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, intervals.overlapping(left, right, hot=3).collect()))
    pairs = sorted((x[0], tuple(x), tuple(y)) for x in left.collect() for y in right.collect() if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert sorted((r.doc_id, tuple(r.left), tuple(r.right)) for r in plain.collect()) == pairs
