"""Style rules of the blog profile."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hondana.functions.matching import Probe, bound, char_at, find_all, pattern, running_sums
from hondana.operators.notation import KANJI
from hondana.schema import Family, issue, line_issues

#: Expressions better written in kana, and their kana.
OPEN_KANJI = {
    "事が出来る": "ことができる",
    "事ができる": "ことができる",
    "出来ます": "できます",
    "出来ません": "できません",
    "出来る": "できる",
    "出来ない": "できない",
    "出来た": "できた",
    "の為": "のため",
}
# Marks, endings, stems and joints of the style rules.
COMPOUND = ("事が出来る", "事ができる", "の為")
MARKS = "。！？!?"
END = f"[{MARKS}]"
#: Only where the one before ends: what follows the last mark is then read once, not from each of its characters.
SENTENCE = f"\\G[^{MARKS}\\n]*{END}+"
POLITE_ENDINGS = ("ませんでした", "でした", "ました", "ません", "でしょう", "ください", "です", "ます")
POLITE = f"(?:{'|'.join(POLITE_ENDINGS)}){END}+$"
PLAIN_ENDINGS = ("である", "だ", "する", "した", "しない", "できる", "できない", "できた", "なる", "なった", "ある", "ない", "いる", "いた", "書く", "読む", "使う")
PLAIN = f"(?:{'|'.join(PLAIN_ENDINGS)}){END}+$"
STEM = "[^\\s、。！？!?はがをにへとでのも]+$"
CONTENT = "[A-Za-z0-9ァ-ヶー一-鿿々〆ヶ]"
#: Characters before ない of verbs (a row; i and e rows), and before いた of verbs; adjectives whose stems look like verbs.
NEGATIVE_A = "わかがさたなばまらり"
NEGATIVE_IE = "いきぎしじちにひびみりえけげせぜてでねべめれ"
ONBIN = "いきぎしじちにひびみりつづてで"
ADJECTIVES = ("少", "危", "切", "汚", "情け", "申し訳", "味気", "何気", "素っ気", "大人げ", "勿体", "他愛")
JOIN = "[）)]、\\s*(?:そのため|したがって|しかし|ただし|これ|それ|なお|また)"
BRACKETED = "[（(][^（()）\\n]*[）)]\\s*[をがはにでとへも]"
NOT_CONNECTORS = ("その他", "その際", "その後", "その上")


def check_open_kanji(lines: DataFrame) -> DataFrame:
    """Candidates of all expressions, by place and then longest; compounds fall out before the greedy choice without overlap.

    The choice only looks at the last accepted one: candidates come in order of place, so an overlap can only be with it.
    """
    kind = "array<struct<col:int,size:int,matched:string>>"
    found = []
    for term in OPEN_KANJI:
        found.append(F.transform(find_all(F.col("masked"), pattern(re.escape(term))), lambda m: F.struct(m["col"].alias("col"), (-F.length(m["matched"])).alias("size"), m["matched"].alias("matched"))))
    line = F.col("line")

    def fine(m: Column) -> Column:
        before, after = char_at(line, m["col"] - 1).rlike(KANJI), char_at(line, m["col"] - m["size"]).rlike(KANJI)
        return ~F.when(m["matched"] == "の為", after).when(m["matched"].isin(*COMPOUND), before | after).otherwise(F.lit(False))

    candidates = F.array_sort(F.filter(F.concat(*found), fine))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("taken"))
    chosen = F.aggregate(candidates, start, lambda a, m: F.when(m["col"] >= a["end"], F.struct((m["col"] - m["size"]).alias("end"), F.concat(a["taken"], F.array(m)).alias("taken"))).otherwise(a))["taken"]
    extra = [c for c in ("file",) if c in lines.columns]
    hits = lines.where(reduce(or_, [F.contains("masked", F.lit(x)) for x in ("出来", "事ができる", "の為")])).select("doc_id", "n", *extra, F.explode(chosen).alias("at")).select("doc_id", "n", *extra, "at.*")
    kana = F.element_at(F.create_map(*[F.lit(x) for pair in OPEN_KANJI.items() for x in pair]), F.col("matched"))
    message = F.concat(F.lit("「"), F.col("matched"), F.lit("」は「"), kana, F.lit("」と開くことを推奨します。"))
    return issue(hits, "style", "open-kanji", message, kana, seq=F.col("n"))


def sentences(lines: DataFrame, on: str = "line", keep: tuple[str, ...] = ("doc_id", "n")) -> DataFrame:
    """Terminated sentences of each line with their columns; an unterminated tail is no sentence."""
    # Without a mark the pattern reads a line twice to find nothing. Sentences follow each other, so their lengths are their places.
    marked = lines.where(reduce(or_, [F.contains(F.col(on), F.lit(m)) for m in MARKS]))

    def placed(found: Column) -> Column:
        return bound(running_sums(F.transform(found, F.length)), lambda before: F.transform(found, lambda x, k: F.struct((before[k] + 1).alias("col"), x.alias("sentence"))))

    at = F.posexplode(bound(F.regexp_extract_all(F.col(on), F.lit(pattern(SENTENCE)), F.lit(0)), placed)).alias("k", "at")
    return marked.select(*keep, at).select(*keep, "k", "at.*")


def plain_stem(sentence: Column, size: Column) -> Column:
    """The word stem before a plain ending of ``size`` characters."""
    return F.regexp_extract(F.substr(sentence, F.lit(1), F.length(sentence) - size), pattern(STEM), 0)


def is_plain(ending: Column, stem: Column) -> Column:
    """Whether a plain ending, without marks, is an inflected ending and not a part of a word."""
    return F.when(~ending.isin("ない", "いた", "した"), F.lit(True)).otherwise(bound(stem, lambda s: _inflected(ending, s)))


def _inflected(ending: Column, stem: Column) -> Column:
    last, kanji = F.right(stem, F.lit(1)), stem.rlike(KANJI)
    adjective = F.lit(False)
    for word in ADJECTIVES:
        adjective = adjective | stem.endswith(word)
    negative = kanji & ~adjective & last.rlike(f"[{NEGATIVE_A}{NEGATIVE_IE}]|{KANJI}")
    onbin = kanji & last.rlike(f"[{ONBIN}]|{KANJI}")
    return F.when(ending == "ない", negative).when(ending == "いた", onbin).when(ending == "した", stem.rlike(CONTENT)).otherwise(F.lit(True))


def _longest(body: Column, endings: tuple[str, ...]) -> Column:
    """The longest of ``endings`` that ``body`` ends with, null for none."""
    out = F.lit(None).cast("string")
    for ending in sorted(endings, key=len):
        out = F.when(body.endswith(ending), F.lit(ending)).otherwise(out)
    return out


def endings(found: DataFrame) -> DataFrame:
    """Sentences with ``style`` (polite or plain), ``matched`` and ``at`` (0-based place of the ending in the sentence); others go."""
    sentence = F.col("sentence")

    def told(body: Column, ends: Column) -> Column:
        stem = plain_stem(sentence, F.length(sentence) - F.length(body) + F.length(ends["plain"]))
        style = F.when(ends["polite"].isNotNull(), F.lit("polite")).when(ends["plain"].isNotNull() & is_plain(ends["plain"], stem), F.lit("plain"))
        at = F.length(body) - F.length(F.coalesce(ends["polite"], ends["plain"]))
        return F.struct(style.alias("style"), at.alias("at"), F.substr(sentence, at + 1).alias("matched"))

    def ended(body: Column) -> Column:
        ends = F.struct(_longest(body, POLITE_ENDINGS).alias("polite"), _longest(body, PLAIN_ENDINGS).alias("plain"))
        return bound(ends, lambda e: F.when(e["polite"].isNotNull() | e["plain"].isNotNull(), told(body, e)))

    # Of a generator's row nothing is computed twice, whatever is asked of it.
    rows = found.withColumn("_told", F.explode(F.filter(F.array(bound(F.rtrim("sentence", F.lit(MARKS)), ended)), lambda x: x["style"].isNotNull())))
    return rows.select("*", "_told.*").drop("_told")


def check_style_mixing(found: DataFrame) -> DataFrame:
    """Issues from endings (doc_id, n, col, style, matched): the fewer kind of a document, or all on a tie."""
    # Endings are found once and move once, as narrow rows; a window without an order takes a document's from disk where memory is short.
    extra = [c for c in ("file",) if c in found.columns]
    rows = found.select("doc_id", *extra, "n", "col", "style", "matched")
    of = Window.partitionBy("doc_id")
    counted = rows.withColumns({kind: F.count(F.when(F.col("style") == kind, 1)).over(of) for kind in ("polite", "plain")})
    mixed = counted.where("polite > 0 and plain > 0 and (polite = plain or style = if(polite > plain, 'plain', 'polite'))")
    tie = F.col("polite") == F.col("plain")
    wish = F.when(tie, "敬体か常体のどちらか").when(F.col("polite") > F.col("plain"), "敬体（です・ます調）").otherwise("常体（だ・である調）")
    message = F.when(tie, "敬体と常体が混在しています。文体をどちらかに統一してください。").otherwise(F.concat(F.lit("記事の多数派に合わせ、"), wish, F.lit("に統一してください。")))
    return issue(mixed, "style", "style-mixing", message, wish, seq=F.lit(100_000_000) + F.col("n"))


def comma_family() -> Family:
    """A comma after a closing bracket that joins another sentence, in masked lines."""

    def made(k: Column) -> dict[str, Column]:
        word = F.regexp_extract("matched", "(そのため|したがって|しかし|ただし|これ|それ|なお|また)$", 1)
        rest = F.substr("masked", F.col("col") + F.length("matched"))
        following = F.substr(rest, F.lit(1), F.lit(1))
        this = word.isin("これ", "それ")
        noun = this & (following != "") & ~following.rlike("(?U)\\s|[をがはにでとへも、。！？!?]")
        listed = this & ~following.isin("は", "も") & F.regexp_extract(rest, "^[^。！？!?\\n]*", 0).rlike(pattern(BRACKETED))
        # An empty following is a substring of any text, so it doesn't count as another character than は or も.
        listed = listed & (following != "")
        suffix = F.concat(word, rest)
        other = F.lit(False)
        for start in NOT_CONNECTORS:
            other = other | suffix.startswith(start)
        there = F.substr("line", "col", F.length("matched"))
        place = F.locate("、", there)
        suggestion = F.concat(F.substr(there, F.lit(1), place - 1), F.lit("。"), F.substr(there, place + 1))
        kept = ~(((word == "また") & (following == "は")) | noun | listed | other)
        return {"rule": F.lit("comma-sentence-join"), "message": F.lit("閉じ括弧後の読点で別の文をつないでいます。"), "suggestion": suggestion, "matched": there, "kept": kept, "seq": F.lit(200_000_000) + F.col("n")}

    return Family("blog_style", "style", (Probe(pattern(JOIN), ("、",), "masked"),), made)


def check_comma_join(lines: DataFrame) -> DataFrame:
    """A comma after a closing bracket that joins another sentence."""
    return line_issues(lines, [comma_family()])


def check_opening_mazu(lines: DataFrame) -> DataFrame:
    """Headings whose next non-blank masked line opens with まず and a comma, in ``lines`` (doc_id, n, line, masked, heading_end).

    ``heading_end``: 0 or, on the last line of a heading, 1. The next filled line is looked up from below, so the frame only grows.
    """
    below = Window.partitionBy("doc_id").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.col("masked").rlike("(?U)\\S"), F.struct("n", "line", "masked"))
    extra = [c for c in ("file",) if c in lines.columns]
    after = lines.withColumn("next", F.last(filled, ignorenulls=True).over(below)).where("heading_end = 1 and next is not null").select("doc_id", *extra, "next.*")
    return _mazu_issues(after)


def check_opening_mazu_of(trees: DataFrame) -> DataFrame:
    """:func:`check_opening_mazu` of parsed documents (doc_id, masked, lines), within each row: of the filled lines those after the end of a heading."""
    extra = [c for c in ("file",) if c in trees.columns]
    filled = F.filter("lines", lambda x: (x["heading_end"] == 1) | x["masked"].rlike("(?U)\\S"))
    after = bound(filled, lambda rows: F.filter(rows, lambda x, k: F.when(k > 0, F.get(rows, k - 1)["heading_end"] == 1).otherwise(F.lit(False))))
    rows = trees.where(F.contains("masked", F.lit("まず"))).select("doc_id", *extra, F.explode(after).alias("x"))
    return _mazu_issues(rows.select("doc_id", *extra, "x.n", "x.line", "x.masked"))


def _mazu_issues(after: DataFrame) -> DataFrame:
    hits = after.where(F.col("masked").rlike("^(?U)\\s*まず[、,]")).withColumn("matched", F.regexp_extract("line", "まず[、,]", 0)).withColumn("col", F.locate("まず", F.col("line")))
    return issue(hits, "style", "section-opening-mazu", "見出し直後の段落を「まず、」以外で始めることを推奨します。", "対象や目的を直接説明する", seq=F.lit(300_000_000) + F.col("n"))
