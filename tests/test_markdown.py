"""Masking: written cases, and properties on arbitrary texts."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hondana.functions import article, tags
from hondana.functions import markdown as m


def masked(text):
    return m.parse(text).masked


@pytest.mark.parametrize(
    "text, hidden, shown",
    [
        ("`サーバ` と ``サ`ー`バ``", ["サーバ", "サ`ー`バ"], ["と"]),
        ("```\nサーバ\n```\n本文", ["サーバ"], ["本文"]),
        ("~~~~\nサーバ\n~~~\nまだ\n~~~~\n本文", ["サーバ", "まだ"], ["本文"]),
        ("> ```\n> サーバ\n> ```\n> 本文", ["サーバ"], ["本文"]),
        ("- 項目\n\n      サーバ\n", ["サーバ"], ["項目"]),
        ("[説明](./eufy \"題\") を読む", ["eufy", "題"], ["説明", "を読む"]),
        ("![代替](eufy.png)本文", ["代替", "eufy"], ["本文"]),
        ("[x][id]\n\n[id]: http://eufy.example 'eufy'\n", ["eufy"], ["x"]),
        ("[x][a b]\n\n[a\n b]:\n  /eufy\n  'eufy\n二行'\n本文", ["eufy", "二行"], ["x", "本文"]),
        ("[x][id]\n\n[id]: /eufy\n\"題\" 本文", ["/eufy"], ["x", "本文", "題"]),
        ("[id]: /eufy 本文", [], ["eufy", "本文"]),
        ("<https://eufy.example> 本文", ["eufy"], ["本文"]),
        ('<img alt="eufy" /> 本文 <b>太字</b>', ["eufy"], ["本文", "太字"]),
        ('<Card\n  title={a > "eufy"}\n>中身</Card>', ["eufy", "title"], ["中身"]),
        ("<script>eufy</script>後", ["eufy"], ["後"]),
        ("<!-- eufy -->後", ["eufy"], ["後"]),
        ("https://example.com/eufy_(a)を見る", ["eufy", "(a)"], []),
        ("https://example.com/eufy。次", ["eufy"], ["。次"]),
        ("（https://example.com/eufy）次", ["eufy"], ["）次", "（"]),
        ("**強調** と *弱* と __下__", ["*", "_"], ["強調", "弱", "下"]),
        ("snake_case_name", [], ["snake_case_name"]),
        ("---\neufy: 1\n---\n本文", ["eufy"], ["本文"]),
        ("---\neufy: 1\n本文", [], ["eufy"]),
        ("\\`eufy\\`", [], ["eufy"]),
        ("1 < 2 eufy > 1", [], ["eufy"]),
    ],
)
def test_what_is_prose(text, hidden, shown):
    out = masked(text)
    assert len(out) == len(text)
    for x in hidden:
        assert x not in out, x
    for x in shown:
        assert x in out, x


@pytest.mark.parametrize(
    "text, hidden, shown",
    [
        # The seven kinds: what stands in them is prose as it is written, tags are not.
        ("<pre class=x>\n**サーバ** `鶏`\n\n`鶏` 中</pre> `まだ`\n`後`", ["<pre", "</pre>", "後"], ["**サーバ** `鶏`", "`鶏` 中", "`まだ`"]),
        ("<TEXTAREA>\n`鶏`\n</textarea>\n`後`", ["後"], ["`鶏`"]),
        ("<script>\n`鶏`\n\n`犬`</script>\n`後`", ["鶏", "犬", "後"], []),
        ("<!-- 鶏\n\n`犬` --> `中`\n`後`", ["鶏", "犬", "後"], ["`中`"]),
        ("<?php `鶏`\n\n?>`中`\n`後`", ["鶏", "後"], ["`中`"]),
        ("<!DOCTYPE `鶏`\n\n`犬`> 中\n`後`", ["後"], ["`鶏`", "`犬`", "中"]),
        ("<![CDATA[\n`鶏`\n]]> `中`\n`後`", ["鶏", "後"], ["`中`"]),
        ("<div>\n**サーバ** `x`\n</div>\n\n`後`", ["<div>", "</div>", "後"], ["**サーバ** `x`"]),
        ("</DIV> `鶏`\n[字](u)\n\n`後`", ["</DIV>", "後"], ["`鶏`", "[字](u)"]),
        ("<h1>`鶏`\n```\n犬\n```\n\n`後`", ["<h1>", "後"], ["`鶏`", "犬"]),
        ("<Card a='1'>\n`鶏`\n</Card>\n\n`後`", ["Card", "後"], ["`鶏`"]),
        ("</x-y >\t\n`鶏`\n\n`後`", ["x-y", "後"], ["`鶏`"]),
        # The last kind stands alone on its line and interrupts no paragraph; the others do.
        ("<Card> `鶏`", ["鶏"], []),
        ("本文\n<Card>\n`鶏`", ["鶏"], ["本文"]),
        ("本文\n<div>\n`鶏`", [], ["本文", "`鶏`"]),
        ("|a|b|\n|-|-|\n|`鶏`|c|\n<div>\n`犬`", ["鶏"], ["`犬`"]),
        # Inside lists and quotes, and where those end.
        ("- <div>\n  `鶏`\n\n  `中`\n- `後`", ["中", "後"], ["`鶏`"]),
        ("- <div>\n  `鶏`\n`後`", ["後"], ["`鶏`"]),
        ("> <div>\n> `鶏`\n`後`", ["後"], ["`鶏`"]),
        ("> 本文\n<div>\n`鶏`", [], ["`鶏`", "本文"]),
        ("1. > <!--\n   > `鶏`\n   > --> `中`\n   > `後`", ["鶏", "後"], ["`中`"]),
        ("    <div>\n`後`", ["div", "後"], []),
        ("   <div>\n`鶏`", [], ["`鶏`"]),
        ("<divx>`鶏`", ["鶏"], []),
        ("<div>\n# 鶏\n\n# 後", [], ["# 鶏"]),
        ("<div>\n[a]: /eufy\n</div>\n\n[a]", [], ["[a]: /eufy", "[a]"]),
    ],
)
def test_html_blocks(text, hidden, shown):
    test_what_is_prose(text, hidden, shown)


def test_html_blocks_have_no_headings():
    assert m.parse("<div>\n# 鶏\n一\n===\n\n# 後\n").headings == [(5, 6, "後")]


def brute_tag_end(s, at):
    """End of a tag whose name ends at ``at``, by the rule itself."""
    depth, quote = 0, ""
    for k in range(at, len(s)):
        c = s[k]
        if quote:
            if c == quote and (k - len(s[:k].rstrip("\\"))) % 2 == 0:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "{}":
            depth = max(0, depth + (1 if c == "{" else -1))
        elif c == ">" and not depth:
            return k + 1
    return -1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>{}\"'`\\a/ ", max_size=40))
def test_tag_ends_are_those_of_one_scan_each(text):
    ends = tags.TagEnds(text, lines=False)
    assert [ends.end(k) for k in range(len(text) + 1)] == [brute_tag_end(text, k) for k in range(len(text) + 1)]


@pytest.mark.parametrize("piece", ["<a ", "<A {", "<a '", "<!--", "<script>", "<script></script ", "`a``b", "[", "[a](", "[a](b 'c", "a* *b ", "**a*", "\\`", "<a\n", "<a \"\n> b=", "- ", ">", "[x]: y\n"])
def test_hostile_texts_end(piece):
    """Time grows with the text: ten times as long, far less than a hundred times the time; a megabyte in seconds."""
    took = []
    for size in (60_000, 600_000):
        text = (piece * (size // len(piece) + 1))[:size]
        start = time.process_time()
        m.parse(text)
        article.strip_components(text)
        took.append(time.process_time() - start)
    assert took[1] < 10 and took[1] < 25 * max(took[0], 0.02)


@pytest.mark.parametrize(
    "text, ranges",
    [
        ('<div "a>b">', [(0, 11)]),
        ("<a=b>", [(0, 5)]),
        ("<b <c>", [(0, 6)]),
        ('<a t="x\\">y">z', [(0, 13)]),
        ("<a t={`>`}>z", [(0, 11)]),
        ("<a\nb>", []),
        ("<a\nb=1>", [(0, 7)]),
        ("<a\n  b>", [(0, 7)]),
        ("> <a\n> b=1\n> />", [(2, 15)]),
        ("<a\n\nb=1>", []),
        ("<1>", []),
        ("<a#>", []),
        ("<>x</>", [(0, 2), (3, 6)]),
        ("<script>a</script >b", [(0, 19)]),
        ("<script>a", [(0, 8)]),
        ("<style>a</styles>b", [(0, 7), (8, 17)]),
    ],
)
def test_tags(text, ranges):
    assert m.tag_ranges(text, []) == ranges


@pytest.mark.parametrize(
    "text, ranges",
    [
        ("abchttps://x.jp/a", [(3, 17)]),
        ("https:// x", [(0, 8)]),
        ("www. x", [(0, 3)]),
        ("https://x.jp/a).", [(0, 14)]),
        ("https://x.jp/(a).", [(0, 16)]),
        ("https://x.jp/a・b、c", [(0, 16)]),
        ("HTTP://x?!?", [(0, 8)]),
        ("https://x.jp/?q=www.y", [(0, 21)]),
    ],
)
def test_urls(text, ranges):
    assert m.url_ranges(text) == ranges


def test_headings_and_tables():
    p = m.parse("# 一 #\n\n二\n==\n\n> ## 三\n\n```\n# no\n```\n\n| a | b |\n|---|---|\n| c | d |\n\n---\n")
    assert [(a, b, t) for a, b, t in p.headings] == [(0, 1, "一"), (2, 4, "二"), (5, 6, "三")]
    assert p.tables == [(11, 14)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab`*_[]()<>{}!#-~|\\\n \t\"'=/:あ。https", max_size=80))
def test_ranges_are_sound(text):
    p = m.parse(text)
    assert len(p.masked) == len(text)
    assert [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(p.masked) if c == "\n"]
    assert all(0 <= a < b <= len(text) for a, b in p.ranges)
    assert all(x[1] < y[0] for x, y in zip(p.ranges, p.ranges[1:]))
    for row in m.line_rows(text, p):
        columns = row["columns"]
        if columns is not None:
            assert columns == sorted(set(columns)) and "".join(row["line"][c] for c in columns) == row["visible"]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=8))
def test_merge(ranges):
    out = m.merge_ranges(ranges)
    assert {k for a, b in out for k in range(a, b)} == {k for a, b in ranges for k in range(a, b)}
    assert all(x[1] < y[0] for x, y in zip(out, out[1:]))


def brute_tags(s):
    """Tags of a page by a scan of its own for each opening, written from the rules: names, quotes, braces, line ends, comments, script and style."""

    def one(start):
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")):
            if s.startswith(opening, start):
                end = s.find(closing, start + len(opening))
                return (end + len(closing), "", False, True) if end >= 0 else None
        for fragment in ("<>", "</>"):
            if s.startswith(fragment, start):
                return start + len(fragment), "", fragment == "</>", False
        name = re.compile(r"</?([A-Za-z][\w.:-]*)(?=[\s/>={]|$)", re.A).match(s, start)
        if not name:
            return None
        depth, quote = 0, ""
        for k in range(name.end(), len(s)):
            c = s[k]
            if quote:
                slashes = 0
                while s[k - 1 - slashes] == "\\":
                    slashes += 1
                quote = "" if c == quote and slashes % 2 == 0 else quote
            elif c in "\"'`":
                quote = c
            elif c in "{}":
                depth = max(0, depth + (1 if c == "{" else -1))
            elif depth:
                continue
            elif c == "\n":
                rest = re.sub(r"^[ \t]{0,3}(?:>(?=[> \t])[ \t]?)+", "", s[k + 1 :])
                if not re.match(r"[ \t]+[^ \t\n]|/?>|\{|[A-Za-z_:][\w.:-]*\s*=", rest, re.A):
                    return None
            elif c == ">":
                line = s[s.rfind("\n", start, k) + 1 : k]
                if "\n" in s[start:k] and re.fullmatch(r"[ \t]{0,3}(?:>[ \t]?)*", line) and s[k + 1 : k + 2] in (" ", "\t", ">"):
                    continue
                return k + 1, name.group(1), s[start + 1] == "/", s[start:k].rstrip().endswith("/")
        return None

    out, at = [], 0
    while (at := s.find("<", at)) >= 0:
        tag = one(at)
        if not tag:
            at += 1
            continue
        end, name, closing, alone = tag
        if name.lower() in ("script", "style") and not closing and not alone:
            m = re.compile(rf"</\s*{name}(?=[\s>])", re.I).search(s, end)
            last = one(m.start()) if m else None
            end = last[0] if last and last[2] and last[1].lower() == name.lower() else end
        out.append((at, end))
        at = end
    return out


def test_tags_of_pages_are_those_of_a_plain_scanner():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    found = [m.tag_ranges(p, []) for p in pages]
    assert found == [brute_tags(p) for p in pages] and sum(map(len, found)) > 500


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="<>{}\"'`\\a/= \n!-?b", max_size=50))
def test_tags_are_those_of_a_plain_scanner(text):
    assert m.tag_ranges(text, []) == brute_tags(text)


def brute_urls(s):
    """URLs of a page, one place after the other, written from the rules."""
    out, at = [], 0
    pairs = {")": "(", "]": "[", "}": "{"}
    while at < len(s):
        m = re.match(r"https?://|www\.", s[at : at + 8], re.I)
        if not m:
            at += 1
            continue
        end, open_ = at + m.end(), []
        while end < len(s) and not s[end].isspace() and s[end] not in "<>\"'。、！？）」』】〉》":
            c = s[end]
            if c in "([{":
                open_.append(c)
            elif c in pairs and (not open_ or open_.pop() != pairs[c]):
                break
            end += 1
        cut = len(s[at:end].rstrip(".,;:!?。、！？"))
        if cut:
            out.append((at, at + cut))
        at = max(at + 1, at + cut)
    return out


def test_urls_of_pages_are_those_of_a_plain_scanner():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    found = [m.url_ranges(p) for p in pages]
    assert found == [brute_urls(p) for p in pages] and sum(map(len, found)) > 3


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["http://", "HTTPS://", "www.", "a", "(", ")", "[", "]", "{", "}", ".", "?", " ", "。", "<", "'", "・"]), max_size=14).map("".join))
def test_urls_are_those_of_a_plain_scanner(text):
    assert m.url_ranges(text) == brute_urls(text)


def test_links_tags_and_urls_cost_few_calls():
    """Calls of a parse by line: paragraphs, links, tags and URLs take no call for each of their words and characters."""
    import cProfile
    import pstats

    words = "aa bb cc dd ee ff gg hh ii jj kk ll " * 4
    text = "\n\n".join(f"{words}[{words}](./x) {words}<b x=\"{words}\">{words}</b> https://x.jp/{'y' * 200} {words}" for _ in range(50))
    profile = cProfile.Profile()
    profile.runcall(m.parse, text)
    assert pstats.Stats(profile).total_calls < 50 * 300
