"""Rules for notes of a vault: front matter, names, links. One array program per document, no shuffle but for tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hondana.functions.matching import strip
from hondana.schema import issue
from hondana.sources.documents import logical_lines

LINKS_FROM = "2026-07-01"
_VALUE = "struct<scalar:string,items:array<string>>"
_STATE = f"struct<open:string,entries:array<struct<key:string,value:{_VALUE}>>>"


def _entry(key: Column, scalar: Column, items: Column) -> Column:
    return F.struct(key.alias("key"), F.struct(scalar.cast("string").alias("scalar"), items.cast("array<string>").alias("items")).alias("value"))


def _step(state: Column, line: Column) -> Column:
    """One line of front matter: an item of the open list, or a key with a value, an inline list or a list to come."""
    s = strip(line)
    skip = (s == "") | s.startswith("#")
    item = strip(F.substring(s, 2, 2_000_000_000))
    is_item = state["open"].isNotNull() & s.startswith("-")
    last = F.element_at(state["entries"], -1)
    grown = F.struct(
        state["open"].alias("open"),
        F.when(item == "", state["entries"]).otherwise(F.concat(F.slice(state["entries"], F.lit(1), F.size(state["entries"]) - 1), F.array(_entry(last["key"], last["value"]["scalar"], F.concat(last["value"]["items"], F.array(item)))))).alias("entries"),
    )
    key, raw = strip(F.regexp_extract(line, "(?s)^([^:]*):", 1)), strip(F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1))
    inline = raw.startswith("[") & raw.endswith("]") & (F.length(raw) > 1)
    items = F.filter(F.transform(F.split(F.substr(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0))), ",", -1), strip), lambda x: x != "")
    entry = F.when(inline, _entry(key, F.lit(None), items)).when(raw == "", _entry(key, F.lit(None), F.array())).otherwise(_entry(key, raw, F.lit(None)))
    known = F.contains(line, F.lit(":")) & (key != "")
    others = F.filter(state["entries"], lambda e: e["key"] != key)
    keyed = F.struct(F.when(known & (raw == ""), key).alias("open"), F.when(known, F.concat(others, F.array(entry))).otherwise(state["entries"]).alias("entries"))
    return F.when(skip, state).when(is_item, grown).otherwise(keyed)


def parsed(notes: DataFrame) -> DataFrame:
    """``notes`` (with text) plus has_block, closed, values (map of key to scalar or items), body.

    A key given twice keeps the later value. A value ``[`` alone counts as a scalar.
    """
    lines = logical_lines(F.coalesce("text", F.lit("")))
    df = notes.withColumn("_lines", lines)
    rule = F.transform("_lines", lambda x: strip(x) == "---")
    df = df.withColumn("_rule", rule).withColumn("has_block", F.coalesce(F.try_element_at("_rule", F.lit(1)), F.lit(False)))
    # array_position in what follows the first line; 0 if there is none.
    df = df.withColumn("_close", F.when(F.col("has_block"), F.array_position(F.slice("_rule", F.lit(2), F.size("_rule")), True)).otherwise(F.lit(0)))
    df = df.withColumn("closed", F.col("_close") > 0)
    inner = F.when(F.col("closed"), F.slice("_lines", F.lit(2), (F.col("_close") - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(f"array<struct<key:string,value:{_VALUE}>>").alias("entries"))
    state = F.aggregate(inner, start.cast(_STATE), lambda a, x: _step(a, x).cast(_STATE))
    df = df.withColumn("values", F.map_from_entries(state["entries"]))
    body = F.when(F.col("closed"), F.array_join(F.slice("_lines", (F.col("_close") + 2).cast("int"), F.size("_lines")), "\n"))
    return df.withColumn("body", body).drop("_lines", "_rule", "_close")


def links(body: Column) -> Column:
    return F.regexp_count(body, F.lit("\\[\\[[^\\[\\]]+\\]\\]"))


def _truthy(value: Column) -> Column:
    return F.coalesce((value["scalar"] != "") | (F.size(value["items"]) > 0), F.lit(False))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def flagged(notes: DataFrame) -> DataFrame:
    """One row per broken rule but the tags': doc_id, path, rule, message, matched, seq. ``notes``: :func:`parsed` with path."""
    value = lambda key: F.try_element_at("values", F.lit(key))
    parts, name, n = F.split("path", "/"), name_of(F.col("path")), links(F.col("body"))
    at = lambda k, word: F.coalesce(F.try_element_at(parts, F.lit(k)) == word, F.lit(False))
    concept, worklog, report = at(1, "wiki") & at(2, "concepts"), at(1, "worklog"), at(1, "reports")
    day = F.regexp_extract(name, "^([0-9]{4}-[0-9]{2}-[0-9]{2})\\.md$", 1)
    good_author = F.coalesce(value("author")["scalar"].isin("human", "claude"), F.lit(False))
    rules = (
        (~F.col("has_block"), "frontmatter 必須", "frontmatter ブロックがありません", None),
        (F.col("has_block") & ~F.col("closed"), "frontmatter 未終端", "frontmatter を閉じる区切り（---）がありません", None),
        (F.col("closed") & ~good_author, "author 必須", "author は human または claude を指定してください", None),
        (F.col("closed") & concept & ~_truthy(value("sources")), "sources 必須", "wiki/concepts のノートには sources が必要です", None),
        (F.col("closed") & concept & (n < 2), "wikilink 必須", "wiki/concepts の本文には wikilink が2つ以上必要です", None),
        (F.col("closed") & worklog & (day == ""), "worklog 命名規則", "worklog のファイル名は YYYY-MM-DD.md 形式にしてください", name),
        (F.col("closed") & worklog & ((day == "") | (day >= LINKS_FROM)) & (n < 1), "wikilink 必須", "worklog の本文には wikilink が1つ以上必要です", None),
        (F.col("closed") & report & ~name.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}_[^/]+\\.md$"), "reports 命名規則", "reports のファイル名は YYYY-MM-DD_slug.md 形式にしてください", name),
        (F.col("closed") & report & _truthy(value("researched_at")) & ~_truthy(value("expires")), "調査日と期限", "researched_at がある場合は expires も指定してください", None),
    )
    rows = [F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"), (F.lit("") if matched is None else matched).alias("matched"), F.lit(1000 * k if k < 3 else 1_000_000 * k).alias("seq"))) for k, (when, rule, message, matched) in enumerate(rules)]
    extra = [c for c in ("file",) if c in notes.columns]
    return notes.select("doc_id", "path", *extra, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("at")).select("doc_id", "path", *extra, "at.*")


def unknown_tags(notes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row per tag that ``vocabulary`` (tag) lacks, repeats included: doc_id, path, place, tag."""
    extra = [c for c in ("file",) if c in notes.columns]
    tags = notes.where("closed").select("doc_id", "path", *extra, F.posexplode(F.try_element_at("values", F.lit("tags"))["items"]).alias("place", "tag"))
    return tags.join(vocabulary, "tag", "left_anti")


def check_frontmatter(notes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Issues of category frontmatter; ``notes``: doc_id, path (relative to the vault's root), text."""
    known = parsed(notes)
    rules = flagged(known).withColumn("n", F.lit(1)).withColumn("col", F.lit(1))
    tags = unknown_tags(known, vocabulary).withColumn("n", F.lit(1)).withColumn("col", F.lit(1)).withColumn("matched", F.col("tag"))
    message = F.concat(F.lit("タグ「"), F.col("tag"), F.lit("」はタグ語彙に登録されていません"))
    return issue(rules, "frontmatter", F.col("rule"), F.col("message"), seq=F.col("seq")).unionByName(issue(tags, "frontmatter", "タグ語彙", message, seq=F.lit(10_000) + F.col("place")))
