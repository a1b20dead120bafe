"""Body text of a Markdown/MDX article: code, comments, components, expressions and furniture taken off."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hondana.functions.tags import TagEnds

# Fixed values of the extraction: fences, headings, list items, and lines that are no text.
FENCE = re.compile(r"\s*(`{3,}|~{3,})")
HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s+|$)")
LIST = re.compile(r"\s*(?:[-+*]|\d+[.)])\s+")
_MODULE = re.compile(r"\s*(?:import|export)\b")
_REFERENCE = re.compile(r"\s*\[[^]]+\]:\s*\S+")
_LINK_ONLY = re.compile(r"\s*(?:\[[^]]+\]\([^)]+\)|\[[^]]+\]\[[^]]*\]|<?https?://\S+>?)[。.]?\s*$")
_IMAGES = re.compile(r"!\[[^]]*\]\([^)]+\)|!\[[^]]*\]\[[^]]*\]")
#: Lines that open with one of these, or are one of those, are no text.
_OPENINGS = ("|", ">", "//", ":::", "（出典:", "（出典：", "出典:", "出典：")
_RULES = ("---", "***", "___")
#: Inline rewrites in order (fixed values of the extraction).
_REWRITES = tuple(
    (re.compile(rx), to)
    for rx, to in (
        (r"!\[[^]]*\]\([^)]+\)", ""),
        (r"!\[[^]]*\]\[[^]]*\]", ""),
        (r"(?<!!)\[([^]]+)\]\([^)]+\)", r"\1"),
        (r"\[([^]]+)\]\[[^]]*\]", r"\1"),
        (r"(`+)(.*?)\1", r"\2"),
        (r"(\*\*|__)(.+?)\1", r"\2"),
        (r"(?<!\*)\*([^*]+)\*(?!\*)", r"\1"),
        (r"(?<!_)_([^_]+)_(?!_)", r"\1"),
        (r"~~([^~]+)~~", r"\1"),
        (r"\[\^[^]]+\]", ""),
        (r"\\([\\`*{}\[\]()#+.!_-])", r"\1"),
    )
)
#: What a text must hold for each rewrite to find anything: most texts hold few of these.
_NEEDED = ("![", "![", "](", "][", "`", ("**", "__"), "*", "_", "~~", "[^", "\\")
#: The same rewrites for java.util.regex, before entities and white space.
JAVA_REWRITES = tuple((p.pattern.replace("[^]]", "[^\\]]"), to.replace("\\1", "$1").replace("\\2", "$2")) for p, to in _REWRITES)


def strip_fences(markdown: str) -> str:
    """Without front matter and fenced code; front matter or a fence that isn't closed takes the rest."""
    lines = markdown.lstrip("﻿").splitlines()
    if lines and lines[0].strip() == "---":
        ends = [k for k, line in enumerate(lines) if k and line.strip() == "---"]
        if not ends:
            return ""
        lines = lines[ends[0] + 1 :]
    kept, fence = [], ""
    for line in lines:
        m = FENCE.match(line)
        mark = m.group(1) if m else ""
        if fence:
            if mark.startswith(fence):
                fence = ""
        elif mark:
            fence = mark
        else:
            kept.append(line)
    return "\n".join(kept)


def strip_comments(text: str) -> str:
    return _without(_without(text, "{/*", "*/}"), "<!--", "-->")


def _without(text: str, opening: str, closing: str) -> str:
    """Without all from an opening to its closing; one that isn't closed takes the rest."""
    out, at = [], 0
    while (start := text.find(opening, at)) >= 0:
        out.append(text[at:start])
        end = text.find(closing, start + len(opening))
        at = end + len(closing) if end >= 0 else len(text)
    return "".join(out) + text[at:] if out else text


_NAME = re.compile(r"<(/?)([A-Za-z][\w.:-]*)?(?=[\s/>])")
#: The rest of a tag without escapes, braces, other quotes and further openings; others are resolved by ``TagEnds``.
_PLAIN_END = re.compile(r"[^\"'`{}<>\\]*+(?:\"[^\"<\\]*+\"[^\"'`{}<>\\]*+)*+>")


def strip_components(text: str) -> str:
    """Tags with all up to their own closing tag; closing, self-closing and unmatched ones alone. A bare < stays."""
    tags, at, ends = [], 0, None
    while m := _NAME.search(text, at):
        plain = _PLAIN_END.match(text, m.end())
        if plain:
            end = plain.end()
        else:
            ends = ends or TagEnds(text, lines=False)
            end = ends.end(m.end())
        if end >= 0:
            alone = not m.group(1) and text[m.start() : end - 1].rstrip().endswith("/")
            tags.append((m.start(), end, (m.group(2) or "").casefold(), bool(m.group(1)), alone))
        at = end if end >= 0 else m.start() + 1
    # Closing tags matched to openings of their name, innermost first, in one pass.
    open_: dict[str, list[int]] = {}
    close_of: dict[int, int] = {}
    for k, (_, _, name, closing, alone) in enumerate(tags):
        if closing:
            if open_.get(name):
                close_of[open_[name].pop()] = k
        elif not alone:
            open_.setdefault(name, []).append(k)
    out, at, k = [], 0, 0
    while k < len(tags):
        out.append(text[at : tags[k][0]])
        last = close_of.get(k, k)
        at, k = tags[last][1], last + 1
    return "".join(out) + text[at:]


_BRACES_AND_QUOTES = re.compile(r"[{}\"'`]")
_QUOTE_REST = {c: re.compile(rf"(?s)(?:[^\\{c}]|\\.)*+{c}") for c in "\"'`"}


def strip_expressions(text: str) -> str:
    """Balanced braces with what they hold, quotes read as such; one that isn't closed takes the rest."""
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        out.append(text[at:start])
        at, depth = start + 1, 1
        while depth:
            m = _BRACES_AND_QUOTES.search(text, at)
            if m and m.group() in _QUOTE_REST:
                m = _QUOTE_REST[m.group()].match(text, m.end())
            elif m:
                depth += 1 if m.group() == "{" else -1
            if not m:
                return "".join(out)
            at = m.end()
    return "".join(out) + text[at:]


def clean_inline(text: str) -> str:
    for (rx, to), needed in zip(_REWRITES, _NEEDED, strict=True):
        if needed in text if isinstance(needed, str) else any(x in text for x in needed):
            text = rx.sub(to, text)
    return " ".join(html.unescape(text).split())


def line_kind(line: str) -> str:
    """skip, block (a heading or list item of its own) or text."""
    s = line.strip()
    if not s or _MODULE.match(line) or s.startswith(_OPENINGS) or s in _RULES or _REFERENCE.match(line) or _LINK_ONLY.match(line) or ("![" in s and not _IMAGES.sub("", s).strip()):
        return "skip"
    return "block" if HEADING.match(line) or LIST.match(line) else "text"


def extract_article(markdown: str) -> str:
    """Blocks of body text with blank lines between; lines of a paragraph joined by spaces."""
    text = strip_expressions(strip_components(strip_comments(strip_fences(markdown))))
    blocks, held = [], []
    for line in [*text.splitlines(), ""]:
        kind = line_kind(line)
        if kind == "text":
            held.append(line.strip())
            continue
        blocks += [clean_inline(" ".join(held))] if held else []
        held = []
        if kind == "block":
            blocks.append(clean_inline(line.strip()))
    return "\n\n".join(b for b in blocks if b).strip()


# White space as java.util.regex has it; str.isspace takes the separators \x1c to \x1f too, of which only the last is no line end.
_BLANK = r"[^\S\x1f]"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_HEADING_MARK = re.compile(rf"{_BLANK}{{0,3}}#{{1,6}}(?:{_BLANK}+|$)")
_LIST_MARK = re.compile(rf"{_BLANK}*(?:[-+*]|\d+[.)]){_BLANK}+")
_SECTION_MARK = re.compile(rf"{_BLANK}{{0,3}}##(?!#)(?:{_BLANK}+|$)")
#: A sentence: one character at least, then up to and with the marks that end it.
_SENTENCE = re.compile(r".[^。！？!?]*+[。！？!?]*+")
_POLITE = tuple(x + y for x in ("です", "ます") for y in ("", *"。！？!?"))


def _may_be_marked(line: str) -> bool:
    c = line.lstrip()[:1]
    return c in ("#", "-", "+", "*") or c.isdecimal()


def _seen(text: str) -> int:
    """Characters other than white space and line ends."""
    return len("".join(text.split())) + text.count("\x1f")


def _mark_chars(line: str) -> int:
    """Of the marks of a heading and then a list item that a line begins with."""
    heading = _HEADING_MARK.match(line)
    end = heading.end() if heading else 0
    item = _LIST_MARK.match(line, end)
    return _seen(line[: item.end() if item else end])


def visible_chars(text: str) -> int:
    """Characters other than white space and the marks of headings and lists."""
    return _seen(text) - sum(_mark_chars(x) for x in text.splitlines() if _may_be_marked(x))


def sections(text: str) -> list[tuple[str, str]]:
    """Heading and text of the parts of a text at its second-level headings, blank ones left out."""
    lines = text.splitlines()
    cuts = [k for k, x in enumerate(lines) if "##" in x and _SECTION_MARK.match(x)]
    out = []
    for k, (first, after) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
        part = "\n".join(lines[first:after]).strip(WHITE)
        if part:
            out.append((_title(lines[first]) if k else "（前文）", part))
    return out


def _title(line: str) -> str:
    title = line[_SECTION_MARK.match(line).end() :].strip(WHITE)
    bare = title.rstrip("#")  # marks at the end go if white space stands before them
    return (bare.rstrip(WHITE) if bare and bare != title and bare[-1] in WHITE else title) or "（無題）"


def surface_features(text: str) -> tuple[float, ...]:
    """Visible characters, these a sentence, shares of sentences that end in a full stop, commas a sentence, share of list lines, headings, share of polite sentences."""
    chars, filled, lists, headings = _seen(text), 0, 0, 0
    sentences, size, stops, commas, polite = 0, 0, 0, 0, 0
    for line in text.splitlines():
        body = line.strip(WHITE)
        if not body:
            continue
        filled += 1
        if _may_be_marked(line):
            chars -= _mark_chars(line)
            item = _LIST_MARK.match(line)
            lists += bool(item)
            if _HEADING_MARK.match(line):
                headings += 1
                continue
            if item:
                body = line[item.end() :].strip(WHITE)
        size += _seen(body)
        commas += body.count("、")
        for s in _SENTENCE.findall(body):
            if not (s := s.strip(WHITE)):
                continue
            sentences += 1
            if _may_be_marked(s):
                size -= _mark_chars(s)
            stops += s[-1] == "。"
            polite += s.endswith(_POLITE)
    rate = lambda x, of: x / of if of else 0.0
    return float(chars), rate(size, sentences), rate(stops, sentences), rate(commas, sentences), rate(lists, filled), float(headings), rate(polite, sentences)


def comparison_key(text: str) -> str:
    """NFKC without white space."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))


#: Odd multiplier of the sums that stand for passages, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Below this product of lengths passages are matched character by character.
_SHORT = 4096


class _Passages:
    """Sums modulo 2^64 of all passages of a text: equal passages have equal ones."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        power = lambda x: np.r_[np.uint64(1), np.cumprod(np.full(len(codes), x, np.uint64))]
        self.sums, self.back = np.r_[np.uint64(0), np.cumsum(codes * power(_BASE)[:-1])], power(_INVERSE)

    def of(self, first: int, after: int, size: int) -> np.ndarray:
        """Of ``size`` characters from each place on that leaves them in the range."""
        last = after - size + 1
        return (self.sums[first + size : last + size] - self.sums[first:last]) * self.back[first:last]


def _matched(a: str, b: str, enough: float) -> int:
    """Characters in the matching blocks of SequenceMatcher: the longest common passage, the first of several, then what stands before and after it; -1 once fewer than ``enough`` can match.

    The longest passage comes by halving its size, by sums of all passages of a size, and is then compared itself.
    """
    x, y = _Passages(a), _Passages(b)
    total, room, todo = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        shorter = min(m - i, n - j)
        if shorter <= 0:
            continue
        if (m - i) * (n - j) <= _SHORT:
            got = sum(k.size for k in SequenceMatcher(None, a[i:m], b[j:n], autojunk=False).get_matching_blocks())
            total, room = total + got, room - shorter + got
        else:
            low, high = 0, shorter
            while low < high:
                size = (low + high + 1) // 2
                low, high = (size, high) if np.isin(x.of(i, m, size), y.of(j, n, size)).any() else (low, size - 1)
            if not low:
                room -= shorter
            else:
                there, here = y.of(j, n, low), x.of(i, m, low)
                p = int(np.argmax(np.isin(here, there)))
                q = j + int(np.argmax(there == here[p]))
                p += i
                if a[p : p + low] != b[q : q + low]:  # two passages with one sum
                    p, q, low = SequenceMatcher(None, a, b, autojunk=False).find_longest_match(i, m, j, n)
                total += low
                room -= shorter - low - min(p - i, q - j) - min(m - p - low, n - q - low)
                todo += [(i, p, j, q), (p + low, m, q + low, n)]
        if room < enough:
            return -1
    return total


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Share of matching characters, as SequenceMatcher has it; 0 where it is less than ``least``, which lengths, character counts or some of the blocks tell early."""
    if a == b:
        return 1.0
    both = len(a) + len(b)
    if 2 * min(len(a), len(b)) / both < least or 2 * (Counter(a) & Counter(b)).total() / both < least:
        return 0.0
    got = 2 * _matched(a, b, least * both / 2 - 1e-6) / both
    return got if got >= least else 0.0


def apply(df: DataFrame, function: Callable[[str], str], column: str, out: str) -> DataFrame:
    """``df`` with ``out`` = ``function`` of a text column (null stays null), in Arrow batches."""
    names = df.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # a worker holds few results, however many rows a batch has
                some = batch.slice(first, 64)
                new = pa.array([None if (t := x.as_py()) is None else function(t) for x in some.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, new], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` string")


def clean_inline_column(x):
    """:func:`clean_inline` as built-in expressions, for text without entities."""
    for rx, to in JAVA_REWRITES:
        x = F.regexp_replace(x, "(?U)(?d)" + rx, to)
    return F.regexp_replace(F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " ")
