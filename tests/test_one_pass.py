"""Checks that read their lines once: plans, and results on small documents."""

import re

import pytest
from pyspark.sql import functions as F

from hondana.functions import markdown
from hondana.functions.matching import pattern
from hondana.operators import notation, style
from hondana.plans import lint
from hondana.plans.catalog import QUERIES, article_docs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_style_mixing_finds_endings_once(spark):
    texts = ["行くです。見る。読むます!! 末尾", "", "です。", "仕事がない。少ない。書かない。です。ます。", "、。だ。です！？"]
    lines = spark.createDataFrame([(k, 1, x) for k, x in enumerate(texts)], "doc_id long, n int, line string")
    found = style.sentences(lines)
    cut = {k: [(m.start() + 1, m.group()) for m in re.finditer("[^。！？!?]*[。！？!?]+", x)] for k, x in enumerate(texts)}
    assert {(r.doc_id, r.col, r.sentence) for r in found.collect()} == {(k, *x) for k, xs in cut.items() for x in xs}
    ended = style.endings(found)
    mixed = style.check_style_mixing(ended.withColumn("col", F.col("col") + F.col("at")))
    assert "Join" not in plan(mixed) and plan(mixed).count("regexp_extract_all") == 1
    assert sorted((r.doc_id, r.column, r.matched_text) for r in mixed.collect()) == [(3, 13, "ない。"), (4, 3, "だ。"), (4, 5, "です！？")]


def test_kept_lines_hold_what_the_checks_read(spark):
    docs = spark.createDataFrame([(1, "## a\n\nサーバ と eufy と githubをA/B に\n")], "doc_id long, text string")
    with lint.keeping():
        found = lint.lint(docs, "blog", checks=("notation",))
        assert "Union" not in plan(found) and "Join" not in plan(found)
        kept = lint._kept.get()[0]
        assert kept.columns == ["doc_id", "lines"] and kept.schema["lines"].dataType.elementType.names == ["n", "line", "masked"]
        assert {r.rule_name for r in found.collect()} == {"brand-capitalization", "表記ブレ: GitHub", "slash-coordination", "alnum-japanese-spacing"}


def test_places_between_kinds_of_letters(spark):
    lines = spark.createDataFrame([(1, "aあb1ア c 漢"), (2, "abc"), (3, "")], "n int, line string").select(F.lit(1).alias("doc_id"), "n", "line", F.col("line").alias("masked"))
    assert [(r.line_number, r.column, r.matched_text, r.suggestion) for r in notation.check_spacing(lines).collect()] == [(1, 1, "aあ", "a あ"), (1, 2, "あb", "あ b"), (1, 4, "1ア", "1 ア")]
    assert lines.where(F.col("line").rlike(pattern(notation.MEETING)) != F.col("line").rlike(pattern(notation.BOUNDARY))).count() == 0


def test_kept_documents_are_small_and_on_disk(spark):
    """In memory the parsed documents of a large input take all the heap that blocks may have; a place a character is four bytes of each."""
    docs = spark.createDataFrame([(1, "## a\n\nサーバ と `eufy` です。<b>行く</b>する。\n")], "doc_id long, text string")
    with lint.keeping():
        found = lint.lint(docs, "blog")
        kept = lint._kept.get()[0]
        assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory and kept.columns == ["doc_id", "lines"]
        assert set(kept.schema["lines"].dataType.elementType.names) == {"n", "line", "masked", "shown", "nominal", "heading_end", "title"}
        assert sorted((r.column, r.matched_text) for r in found.where("rule_name = 'style-mixing'").collect()) == [(14, "です。"), (26, "する。")]


def test_pieces_are_the_visible_line(spark):
    written = ["`a`", "", "a `b` c\n<b>漢字</b>です。\n`x", "https://x.jp/ と `a\nb` c", "𠮷 `𠮷` 𠮷です。 ![a](b)"]
    docs = spark.createDataFrame(list(enumerate(written)), "doc_id long, text string").unionByName(article_docs(spark, "/root/testdata/sf0.001").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    lines = markdown.parsed(docs, columns=("lines",), fields=(*markdown.FIELDS, "shown")).select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*")
    made = lines.select("*", markdown.visible_of(F.col("line"), F.col("shown")).alias("made"))
    places = F.transform(F.sequence(F.lit(1), F.length("visible")), lambda p: markdown.column_of(F.col("shown"), p) - 1)
    rows = made.withColumn("places", F.when(F.length("visible") > 0, places).otherwise(F.array())).collect()
    assert len([r for r in rows if r.shown is not None]) > 100 and {len(r.shown) for r in rows if r.shown is not None} >= {1, 3, 5}
    assert all(r.made == r.visible and r.places == (list(range(len(r.line))) if r.columns is None else r.columns) for r in rows)


@pytest.mark.parametrize("name", ["lint_articles", "lint_blog"])
def test_queries_keep_nothing_in_memory(spark, name):
    with lint.keeping():
        QUERIES[name](spark, "/root/testdata/sf0.001")
        (kept,) = lint._kept.get()
        assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory and not {"visible", "columns"} & set(kept.schema["lines"].dataType.elementType.names)
