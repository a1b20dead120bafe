"""Extraction, sections, filters, thresholds and constraints on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from hondana.functions import article
from hondana.operators import dataset
from hondana.plans import catalog
from hondana.sources.documents import logical_lines


@pytest.mark.parametrize(
    "text, body",
    [
        ("---\na: b\n---\n本文", "本文"),
        ("---\na: b\n本文", ""),
        ("前\n```\ncode\n``\n~~~\n```` x\n後", "前 後"),
        ("a<!-- x -->b{/* y */}c", "abc"),
        ("a<Foo><Foo>x</Foo></Foo>b<Bar/>c</Baz>d", "abcd"),
        ("a{x{'}'}}b", "ab"),
        ("import x\n\n> q\n| t |\n***\n（出典: x）\n[a](b)\n![a](b)\n[id]: x\n本文", "本文"),
        ("# 題\n一\n二\n- 甲\n- `乙`\n\n[説明](x)と**強**&amp;", "# 題\n\n一 二\n\n- 甲\n\n- 乙\n\n説明と強&"),
    ],
)
def test_extract(text, body):
    assert article.extract_article(text) == body


def test_sections(spark):
    text = "前文\n## 一 ##\n本\n### 小\n\n##\n二\n## 空"
    docs = spark.createDataFrame([(0, text), (1, ""), (2, None), (3, "\n\n")], "doc_id long, text string")
    rows = dataset.sections(docs).orderBy("doc_id", "section_index").collect()
    assert [(r.doc_id, r.section_index, r.heading, r.text, r.chars) for r in rows] == [(0, 0, "（前文）", "前文", 2), (0, 1, "一", "## 一 ##\n本\n### 小", 6 - 1), (0, 2, "（無題）", "##\n二", 1), (0, 3, "空", "## 空", 1)]


def test_similar_sections(spark):
    base = "吾輩は猫である。名前はまだ無い。" * 8
    drafts = spark.createDataFrame([("a", 0, base, 200), ("a", 1, base[:-1] + "？", 200), ("a", 2, "x" * 128, 200), ("b", 0, base, 200), ("a", 3, "短", 1)], "article string, section_index int, text string, chars int")
    published = spark.createDataFrame([("a", 0, base + " \n", 200), ("a", 1, "y" * 128, 200), ("c", 0, base, 200)], "article string, section_index int, text string, chars int")
    pairs = {(r.article, r.draft_index, r.published_index) for r in dataset.similar_sections(drafts, published).collect()}
    assert pairs == {("a", 0, 0), ("a", 1, 0)}
    kept_d, kept_p = dataset.filtered_sections(drafts, published)
    assert {(r.article, r.section_index) for r in kept_d.collect()} == {("a", 2), ("b", 0)}
    assert {(r.article, r.section_index) for r in kept_p.collect()} == {("a", 1), ("c", 0)}
    assert tuple(dataset.exclusions(drafts, published).first()) == (1, 0, 2, 1)
    with pytest.raises(ValueError):
        dataset.filtered_sections(drafts, published, -1)


def brute_threshold(rows):
    values = sorted({v for v, _ in rows})
    cuts = [values[0] - 1.0, *[(a + b) / 2 for a, b in zip(values, values[1:])], values[-1]]
    best = (-1.0, 0.0, "")
    for cut in cuts:
        for way in ("<=", ">"):
            right = sum(((v <= cut) == (way == "<=")) == (label == "ai") for v, label in rows) / len(rows)
            if right > best[0]:
                best = (right, cut, way)
    return best


def test_best_threshold(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        rows = [(float(rng.randrange(10)), rng.choice(["ai", "human"])) for _ in range(n)]
        got = dataset.best_threshold(spark.createDataFrame(rows, "v double, label string"), "v").first()
        assert (got.accuracy, got.threshold, got.ai_when) == brute_threshold(rows)


def test_violations(spark, tmp_path):
    info = [(a, "train", v, {"draft": "ai", "published": "human"}[v], "c", "p", f"text {a} {v}") for a in ("x", "y") for v in ("draft", "published")]
    articles = spark.createDataFrame(info, "article string, split string, variant string, label string, commit string, source_path string, text string")
    kept = spark.createDataFrame([(a, v, "h", 0, "body", 4) for a in ("x", "y") for v in ("draft", "published")], "article string, variant string, heading string, section_index int, text string, chars int")
    records = dataset.assemble(articles, kept)
    assert dataset.violations(records).collect() == []
    broken = dataset.assemble(articles.where("article != 'y' or variant != 'draft'"), kept.where("article != 'x' or variant != 'draft'"))
    assert {(r["check"], r["key"]) for r in dataset.violations(broken).collect()} == {("sections of one variant", "x"), ("variants", "y"), ("sections of one variant", "y")}
    report = dataset.markdown_report(records, dataset.exclusions(*(kept.where(f"variant = '{v}'") for v in ("draft", "published"))), "2026")
    assert "| 計 | 計 | 計 | 8 |" in report and "生成日時: 2026" in report and "| 200 文字未満 | 2 | 2 | 4 |" in report and "多数派の正解率 0.500、1 件の重み 0.250" in report and "- article の chars だけで正解率 1.000" in report
    only = dataset.markdown_report(records.where("label = 'ai'"))
    assert "| chars | - | - | - | - |" in only and "ありません。" in only
    dataset.write_dataset(records, str(tmp_path / "set"), {"seed": "1"})
    assert sorted(map(tuple, dataset.read_dataset(spark, str(tmp_path / "set")).collect()), key=str) == sorted(map(tuple, records.collect()), key=str)
    info = spark.read.json(str(tmp_path / "set/info")).first()
    assert (info.records, info.seed) == ("8", "1") and '"heading":null' in spark.read.text(str(tmp_path / "set/records")).where("value like '%null%'").first()[0]


def test_source_violations(spark):
    kind = "article string, split string, commit string, source_path string"
    table = spark.createDataFrame([("a", "train", "c", "p"), ("b", "test", "c", "q"), ("d", "test", "c", None)], kind)
    found = lambda rows: {tuple(r) for r in dataset.source_violations(spark.createDataFrame(rows, kind), table).collect()}
    assert found(table.collect()) == set()
    assert found([("a", "test", "c", "p"), ("a", "train", "c", "p"), ("b", "test", "x", "q"), ("e", None, "c", "p")]) == {
        ("repeated article", "a"), ("split unlike the table", "a"), ("version unlike the table", "b"), ("unknown article", "e"), ("missing article", "d"),
    }


def test_similar_sections_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("あいうえおかきくけこ。、") for _ in range(rng.randrange(30, 90))) for _ in range(8)]
    near = lambda t: "".join(c if rng.random() > 0.02 else rng.choice("さしす") for c in t)
    sides = [[("a" if k % 3 else "b", k, near(rng.choice(base)), 200) for k in range(40)] for _ in range(2)]
    kind = "article string, section_index int, text string, chars int"
    want = {(x[0], x[1], y[1]) for x in sides[0] for y in sides[1] if x[0] == y[0] and article.ratio(article.comparison_key(x[2]), article.comparison_key(y[2])) >= 0.9}
    got = {(r.article, r.draft_index, r.published_index) for r in dataset.similar_sections(*(spark.createDataFrame(s, kind) for s in sides), 0.9).collect()}
    assert got == want and len(want) > 20


def test_validate_records_reads_every_document(spark, tmp_path):
    rows = [(k, f"text of {k}\nand more") for k in (0, 1, 398, 399, 5000, 5001, 5003)] + [(9000, ""), (9001, "fine")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["check"], r["key"]) for r in catalog.QUERIES["validate_records"](spark, str(tmp_path)).collect()}
    pairs = {}
    for d, _ in rows:
        pairs.setdefault(f"a{d // 2}", set()).add(d % 2)
    assert {k for c, k in found if c == "variants"} == {a for a, v in pairs.items() if len(v) < 2} == {"a2501"}


def test_violations_of_nulls_and_counts(spark):
    rows = [(f"x:{v}:{g}", "x", "train", v, {"draft": "ai", "published": "human"}[v], g, "h" if k else None, 0 if k else None, "c", "p", v, len(v)) for v in ("draft", "published") for k, g in enumerate(("article", "section"))]
    found = lambda rows: {r["check"] for r in dataset.violations(spark.createDataFrame(rows, dataset.RECORD)).collect()}
    other = lambda at, value: [(*rows[1][:at], value, *rows[1][at + 1 :]), rows[0], *rows[2:]]
    assert found(rows) == set()
    assert found(rows[1:]) == {"variants"} and found([*rows, ("again", *rows[0][1:])]) == {"variants"}
    assert found(other(4, None)) == {"label"} and found(other(7, -1)) == {"section without heading"} and found(other(11, None)) == {"chars"}
    assert found(other(0, "")) == {"empty id"} and "granularity" in found(other(5, None)) and "unknown split" in found(other(2, "dev"))


def test_similar_texts_are_those_of_all_pairs(spark):
    """Edits spread or in one place, insertions, passages that all share, copies, empty texts; ratios around the bound, three bounds."""
    from difflib import SequenceMatcher

    from hondana.functions.article import comparison_key

    rng = random.Random(5)
    letters = "あいうえおかきくけこabcde 。"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = text(150)

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t) + 1)
            kind = rng.randrange(3)
            t[k : k + (kind != 0)] = [rng.choice(letters)] if kind != 1 else []
        return "".join(t)

    drafts, published = [], []
    for k in range(60):
        base = text(rng.choice([1, 2, 3, 10, 30, 60, 100, 300, 700])) + (shared if k % 3 == 0 else "")
        drafts.append((k % 2, k, base))
        published.append((k % 2, k, edited(base, rng.choice([0, 0, 1, 2, len(base) // 60, len(base) // 40, len(base) // 25]))))
    drafts += [(0, 60, ""), (0, 61, None), (0, 62, drafts[0][2]), (None, 63, "x" * 300)]
    published += [(0, 60, ""), (0, 61, drafts[0][2]), (None, 62, "x" * 300)]
    a, b = (spark.createDataFrame(x, "article int, section_index int, text string") for x in (drafts, published))
    for least in (0.98, 0.9, 0.5):
        got = {(r.article, r.draft_index, r.published_index): r.ratio for r in dataset.similar_sections(a, b, least).collect()}
        want = {}
        for p, i, x in drafts:
            for q, j, y in published:
                if p == q and p is not None:
                    ratio = SequenceMatcher(None, comparison_key(x or ""), comparison_key(y or ""), autojunk=False).ratio()
                    if ratio >= least:
                        want[p, i, j] = ratio
        assert got == want and len(want) > 30
        gone = dataset.unchanged_sections(a, b, least)
        assert [sorted(map(tuple, g.collect())) for g in gone] == [sorted({(p, i) for p, i, _ in want}), sorted({(p, j) for p, _, j in want})]


def test_a_length_always_has_more_grams_than_edits():
    for least in (0.8, 0.9, 0.98, 1.0):
        cuts = dataset.gram_lengths(least)
        for n in range(1, 3000):
            q = next(q for length, q in cuts if n >= length)
            assert n // q > dataset.edits(n, least)
        assert [q for _, q in cuts] == sorted((q for _, q in cuts), reverse=True) and cuts == sorted(cuts, reverse=True)


def test_constraints_take_one_scan_and_one_shuffle(spark, tmp_path):
    spark.createDataFrame([], dataset.RECORD).write.parquet(str(tmp_path / "r"))
    plan = dataset.violations(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().sparkPlan().toString()
    full = dataset.violations(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and full.count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in dataset.violations(spark.createDataFrame([], dataset.RECORD)).collect()] == [("no sections", "0")]


def test_similar_texts_by_any_route(spark, monkeypatch):
    """Crowded cells go by grams, the others by counts: the same pairs, also where both are mixed; a worker passes grams on in pieces."""
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(n)) for n in (40, 200, 205, 210, 900)]
    near = lambda t, n: "".join(rng.choice("xyz") if k in at else c for at in [set(rng.sample(range(len(t)), n))] for k, c in enumerate(t))
    sides = [[(k % 2, k, near(t, rng.randrange(len(t) // 50 + 1))) for k, t in enumerate(base * 6)] for _ in range(2)]
    a, b = (spark.createDataFrame(x, "article int, section_index int, text string") for x in sides)
    texts = [dataset._counted(df).select("article", "id", "key", "size", "bins").dropDuplicates(["article", "id"]) for df in (a, b)]
    found = [sorted(map(tuple, dataset.similar_texts(*texts, 0.95, crowd=c).collect())) for c in (10_000, 3, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 30
    monkeypatch.setattr(dataset, "HELD", 50)
    assert sorted(map(tuple, dataset.similar_texts(*texts, 0.95, crowd=0).collect())) == found[0]


def test_sections_of_small_cells_make_no_grams(spark, monkeypatch):
    """Only crowded cells are cut to grams; a row for each character of every published text is what a large table can't hold."""
    made = []
    plain = dataset._by_grams

    def counted(a, b, least):
        made.append(b.count())
        return plain(a, b, least)

    monkeypatch.setattr(dataset, "_by_grams", counted)
    kind = "article string, section_index int, text string"
    a, b = (spark.createDataFrame([("a", k, "".join(random.Random(k % 20).choice("abcdef") for _ in range(100 + k % 20)) + tail) for k in range(40)], kind) for tail in ("x", "y"))
    pairs = dataset.similar_sections(a, b, 0.98)
    assert pairs.count() >= 80 and made == [0]


def test_ratio_is_that_of_sequence_matcher(monkeypatch):
    """Edits, moved and repeated passages, ties, few letters; long near copies in little time."""
    import time
    from difflib import SequenceMatcher

    rng = random.Random(3)
    monkeypatch.setattr(article, "_SHORT", 20)
    for _ in range(400):
        letters = rng.choice(["ab", "abcdef", "あいうa\U0001f600"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))
        b = a if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))
        for _ in range(rng.randrange(6)):
            k, n = rng.randrange(len(b) + 1), rng.randrange(4)
            b = b[k:] + b[:k] if n == 3 and rng.random() < 0.3 else b[:k] + "".join(rng.choice(letters) for _ in range(n)) + b[k + rng.randrange(3) :]
        want = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert article.ratio(a, b) == want
        for least in (0.5, 0.9, 0.98):
            assert article.ratio(a, b, least) == (want if want >= least else 0.0)
    monkeypatch.undo()
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40_000))
    other = "".join(c if rng.random() > 0.01 else "Z" for c in long)
    start = time.process_time()
    assert article.ratio(long, other, 0.98) == 2 * (40_000 - other.count("Z")) / 80_000
    assert time.process_time() - start < 10


ODD = ("#", "##", "### ", "## ", "  ##", "-", "- ", "1. ", "１) ", "*", "+ ", "\n", "\r\n", "\x1c", "\x1f", "\x85", " ", " ", "\t", "　", "\xa0", "a", "語", "です", "ます。", "。", "！", "?", "、", "\U0001f600", "x y", " ##")


def odd_texts(spark, n):
    rng = random.Random(8)
    return spark.createDataFrame([(k, "".join(rng.choice(ODD) for _ in range(rng.randrange(30)))) for k in range(n)] + [(n, None), (n + 1, "")], "doc_id int, text string").repartition(4).cache()


def visible_by_built_ins(text):
    """The plain form: every line of a text by regular expressions of the other kind."""
    lines = F.transform(logical_lines(text), lambda x: F.regexp_replace(F.regexp_replace(x, "(?U)^\\s{0,3}#{1,6}(?:\\s+|$)", ""), "(?U)^\\s*(?:[-+*]|\\d+[.)])\\s+", ""))
    return F.length(F.regexp_replace(F.array_join(lines, ""), "(?U)\\s+", ""))


def test_features_are_those_of_built_ins(spark):
    """Sentences by a plain pattern, characters by the plain form, of texts with odd white space and marks; a text is read in one pass, not once for each feature."""
    docs = odd_texts(spark, 1000)
    bare = F.transform(logical_lines(F.col("text")), lambda x: F.when(x.rlike("(?U)^\\s{0,3}#{1,6}(?:\\s+|$)"), "").otherwise(F.regexp_replace(x, "(?U)^\\s*(?:[-+*]|\\d+[.)])\\s+", "")))
    said = F.flatten(F.transform(bare, lambda x: F.regexp_extract_all(F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""), F.lit("(?d).+?(?:[。！？!?]+|$)"), F.lit(0))))
    said = F.filter(F.transform(said, lambda s: F.regexp_replace(s, "(?U)^\\s+|\\s+$", "")), lambda s: s != "")
    lines = F.filter(logical_lines(F.col("text")), lambda x: x.rlike("(?U)\\S"))
    total = lambda f: F.aggregate(said, F.lit(0), lambda a, s: a + f(s)).cast("double")
    rate = lambda x, of: F.when(F.size(of) > 0, x / F.size(of)).otherwise(0.0)
    many = lambda rx: F.size(F.filter(lines, lambda x: x.rlike(rx))).cast("double")
    want = docs.select(
        "doc_id", visible_by_built_ins(F.col("text")).cast("double"), rate(total(visible_by_built_ins), said), rate(total(lambda s: s.endswith("。").cast("int")), said), rate(total(lambda s: F.regexp_count(s, F.lit("、"))), said),
        rate(many("(?U)^\\s*(?:[-+*]|\\d+[.)])\\s+"), lines), many("(?U)^\\s{0,3}#{1,6}(?:\\s+|$)"), rate(total(lambda s: s.rlike("(?:です|ます)[。！？!?]?$").cast("int")), said),
    )
    found = dataset.surface_features(docs)
    assert found.columns == ["doc_id", *dataset.FEATURES]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = dataset.surface_features(spark.range(1).selectExpr("id AS doc_id", "string(id) AS text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan and "regexp" not in plan


def test_sections_and_characters_of_odd_texts(spark):
    """Characters of whole texts and of sections are those of the plain form; every second-level heading of a text opens a section."""
    docs = odd_texts(spark, 1000)
    assert docs.where(~dataset.visible_chars(F.col("text")).eqNullSafe(visible_by_built_ins(F.col("text")))).count() == 0
    found = dataset.sections(docs)
    assert found.where(~F.col("chars").eqNullSafe(visible_by_built_ins(F.col("text"))) | (F.col("text") != F.regexp_replace("text", "(?U)^\\s+|\\s+$", ""))).count() == 0
    heads = F.size(F.filter(logical_lines(F.col("text")), lambda x: x.rlike("(?U)^\\s{0,3}##(?!#)(?:\\s+|$)")))
    counts = {r.doc_id: r.n for r in found.where("heading != '（前文）'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r.doc_id: r.n for r in docs.where("text is not null").select("doc_id", heads.alias("n")).where("n > 0").collect()}
    assert counts == want and len(want) > 100
    assert article.sections("##  ##\n## a  ##\n## b## \n##   ") == [("##", "##  ##"), ("a", "## a  ##"), ("b##", "## b##"), ("（無題）", "##")]


def test_records_are_made_without_moving_texts(spark, tmp_path):
    """Sections that bring their article's columns are not joined with it again: only the facts of a record go to its groups."""
    import duckdb

    rows = [(k, "## a\n" + "text " * 100 + str(k)) for k in range(-4, 40)] + [(50, None), (51, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["validate_records"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalog.ORACLE_SQL["validate_records"]).fetchall())
    info = spark.createDataFrame([("x", "train", "draft", "ai", "c", "p", "t")], "article string, split string, variant string, label string, commit string, source_path string, text string")
    bare = spark.createDataFrame([("x", "draft", "h", 0, "body", 4)], "article string, variant string, heading string, section_index int, text string, chars int")
    whole = bare.join(info.drop("text"), ["article", "variant"])
    assert sorted(map(tuple, dataset.assemble(info, whole).collect()), key=str) == sorted(map(tuple, dataset.assemble(info, bare).collect()), key=str)


def test_extraction_of_long_plain_texts_takes_little_time():
    """What has no braces, comments, tags or marks is passed over, not read character by character."""
    import time

    text = "\n\n".join(["plain words and more of them " * 400] * 200)
    start = time.process_time()
    assert article.strip_expressions(text) == text and article.extract_article(text).count("\n\n") == 199
    assert time.process_time() - start < 0.25


@pytest.mark.parametrize(
    "text, bare",
    [
        ("a{b}c{d", "ac"), ("a{'}'}b", "ab"), ("a{'\\'}'}b", "ab"), ("a{`x{`}b}c", "ab}c"), ("a{\"x\\", "a"), ("}a{{}b}c", "}ac"), ("", ""),
    ],
)
def test_strip_expressions(text, bare):
    assert article.strip_expressions(text) == bare


def test_strip_comments_that_meet():
    assert article.strip_comments("a<!-->b-->c{/*<!--*/}d-->e<!--f") == "acd-->e"
    assert article.strip_components('a<b x="<" y>c</b>d<i q="\\">">e') == "ade"


def test_extract_article_of_any_doc_id(spark, tmp_path):
    """The forms of known texts are told by doc_id, also by one below zero."""
    import duckdb

    rows = [(k, "one\ntwo words\n3\n\nlast") for k in range(-9, 9)] + [(20, None), (21, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, catalog.QUERIES["extract_article"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.ORACLE_SQL["extract_article"]).fetchall())
