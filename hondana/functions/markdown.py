"""Which characters of a Markdown/MDX text are not prose.

A line-by-line block parser keeps a stack of containers (quotes, list items) and one open leaf; the text of
paragraphs, headings and table cells goes to an inline pass that pairs brackets and emphasis marks. All places are
code points of the source, so masking keeps offsets. Front matter, fenced and indented code, code spans, images, link
destinations, automatic links, emphasis marks, reference definitions, HTML/JSX tags (not the text between them, but
for ``script`` and ``style``) and bare URLs count as not prose.

The seven kinds of HTML blocks are leaves of their own: what stands in them has no marks of Markdown, so only their tags are no prose. Entities stay as they
stand in the source, whose places are kept. Tags, brackets, emphasis and code spans are found in time linear in the text, also where they never close.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hondana.functions.tags import TagEnds

Range = tuple[int, int]

_FENCE = re.compile(r"(`{3,}|~{3,})([^\n]*)$")
_ATX = re.compile(r"#{1,6}(?=[ \t]|$)")
_SETEXT = re.compile(r"(?:=+|-+)[ \t]*$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"(?:[-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: A reference definition at the head of a paragraph: its label, destination and title may each start on a line of their own, label and title go over several.
_DEFINITION = re.compile(
    r"\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)"
    r"(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?=\n|$)",
    re.S,
)
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]+@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?)>")
_TAG_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.:\-]*")
#: The rest of a tag on one line without escapes, braces and further openings; others are resolved by ``TagEnds``.
_PLAIN_END = re.compile(r"[^\"'`{}<>\n\\]*+(?:\"[^\"<\n\\]*+\"[^\"'`{}<>\n\\]*+)*+>")
_SPACE = re.compile(r"\s*")
_NOT_LINE_END = re.compile(r"[^\r\n]+")
_SPECIAL = re.compile(r"[\\`<!\[\]*_]")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
_POINTED = re.compile(r"<(?:[^<>\n\\]|\\.)*>")
_TITLE_END = re.compile(r"\s*+(?:(?<=\s)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))\s*+)?\)")
# What opens and ends the kinds of HTML blocks of CommonMark. The last two end at a blank line; the last doesn't interrupt a paragraph.
_HTML_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|"
    "legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_HTML_OPEN_TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9:._-]*(?:\s*=\s*(?:[^\"'=<>`\x00-\x20]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>"
_HTML_BLOCKS = tuple(
    (re.compile(start, re.I), end and re.compile(end, re.I))
    for start, end in (
        (r"<(?:script|pre|style|textarea)(?=\s|>|$)", r"</(?:script|pre|style|textarea)>"),
        (r"<!--", r"-->"),
        (r"<\?", r"\?>"),
        (r"<![A-Z]", r">"),
        (r"<!\[CDATA\[", r"\]\]>"),
        (rf"</?(?:{_HTML_NAMES})(?=\s|/?>|$)", ""),
        (rf"(?:{_HTML_OPEN_TAG}|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$", ""),
    )
)
# What starts, stops and ends a URL.
_URL = re.compile(r"(?:https?://|www\.)", re.I)
_URL_STOPS = "<>\"'。、！？）」』】〉》"
_URL_RUN = re.compile(rf"[^\s{_URL_STOPS}()\[\]{{}}]*")
_URL_TAIL = ".,;:!?。、！？"
_PAIRS = {")": "(", "]": "[", "}": "{"}
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Parsed:
    ranges: list[Range] = field(default_factory=list)
    headings: list[tuple[int, int, str]] = field(default_factory=list)  # first line, line after, title
    tables: list[tuple[int, int]] = field(default_factory=list)
    inlines: list[Range] = field(default_factory=list)
    masked: str = ""


def merge_ranges(ranges: list[Range]) -> list[Range]:
    """Sorted ranges; overlapping and adjacent ones become one, empty ones go."""
    out: list[Range] = []
    for a, b in sorted(r for r in ranges if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _spaces(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def mask_ranges(text: str, ranges: list[Range]) -> str:
    """Characters of ``ranges`` as spaces; line ends stay."""
    parts, at = [], 0
    for a, b in ranges:
        hidden = text[a:b]
        parts += [text[at:a], _NOT_LINE_END.sub(_spaces, hidden) if "\n" in hidden or "\r" in hidden else " " * len(hidden)]
        at = b
    return "".join(parts) + text[at:]


def overlaps(start: int, end: int, ranges: list[Range]) -> bool:
    return any(start < b and a < end for a, b in ranges)


def line_starts(text: str) -> list[int]:
    return [0] + [m.end() for m in re.finditer("\n", text)]


def front_matter_end(lines: list[str]) -> int:
    """Number of lines of front matter at the top; 0 if there is none or it isn't closed."""
    if not lines or lines[0].lstrip("﻿").rstrip("\r") != "---":
        return 0
    for k, line in enumerate(lines[1:], 1):
        if line.rstrip("\r") in ("---", "..."):
            return k + 1
    return 0


def _indent(line: str, at: int) -> int:
    """Columns of white space from ``at``; a tab counts to the next multiple of four."""
    width = 0
    while (c := line[at : at + 1]) == " " or c == "\t":
        width += 1 if c == " " else 4 - width % 4
        at += 1
    return width


def _blank(line: str, at: int) -> bool:
    """Whether nothing but white space stands from ``at`` on."""
    return not "!" <= line[at : at + 1] <= "~" and _SPACE.match(line, at).end() == len(line)


def _past(line: str, at: int, width: int) -> int:
    """Place after at most ``width`` columns of white space."""
    got = 0
    while at < len(line) and got < width and line[at] in " \t":
        got += 1 if line[at] == " " else 4 - got % 4
        at += 1
    return at


class Blocks:
    """One pass over the lines of a text."""

    def __init__(self, text: str):
        self.text, self.lines, self.starts = text, text.split("\n"), line_starts(text)
        self.code: list[Range] = []
        self.definitions: list[Range] = []
        self.labels: set[str] = set()
        self.headings: list[tuple[int, int, str]] = []
        self.tables: list[tuple[int, int]] = []
        self.content: list[list[tuple[int, int]]] = []  # source ranges of the lines of each inline text
        self.stack: list[tuple[str, int]] = []
        self.leaf = ""
        self.para: list[tuple[int, int, int]] = []  # line, start, end in the source
        self.fence: tuple[str, int] = ("", 0)
        self.html_end: re.Pattern | str = ""  # what ends the HTML block; a blank line if empty
        self.table: list[int] = []
        top = front_matter_end(self.lines)
        if top:
            self._add_code(0, top)
        for k in range(top, len(self.lines)):
            self._line(k, self.lines[k].rstrip("\r"))
        self._close()

    def _span(self, first: int, after: int) -> Range:
        return self.starts[first], self.starts[after] if after < len(self.starts) else len(self.text)

    def _add_code(self, first: int, after: int) -> None:
        self.code.append(self._span(first, after))

    def _close(self) -> None:
        if self.leaf == "para":
            self._define()
            if self.para:
                self.content.append([(a, b) for _, a, b in self.para])
        elif self.leaf == "table":
            self.tables.append((self.table[0], self.table[-1] + 1))
        self.leaf, self.para, self.table = "", [], []

    def _define(self) -> None:
        """Take reference definitions off the paragraph's head."""
        if not self.para or self.text[self.para[0][1]] != "[":
            return
        body, at, used = "\n".join(self.text[a:b] for _, a, b in self.para), 0, 0
        while used < len(self.para) and body[at] == "[":
            m = _DEFINITION.match(body, at)
            if not m or not m.group(1).strip():
                break
            first, used, at = used, used + m.group(0).count("\n") + 1, m.end() + 1
            self.labels.add(" ".join(m.group(1).split()).casefold())
            self.definitions.append((self.para[first][1], self.para[used - 1][2]))
        self.para = self.para[used:]

    def _line(self, k: int, line: str) -> None:
        if not self.stack and self.leaf in ("", "para") and line[:1].isalpha():  # opens nothing but a paragraph
            self._append(k, line, 0)
            return
        at, depth = 0, 0
        for kind, width in self.stack:
            if kind == ">":
                p = _past(line, at, 3)
                if not line[p : p + 1] == ">":
                    break
                at = p + 1
                if line[at : at + 1] in (" ", "\t"):
                    at += 1
            elif _blank(line, at):
                pass
            elif _indent(line, at) >= width:
                at = _past(line, at, width)
            else:
                break
            depth += 1
        rest_blank = _blank(line, at)
        if depth < len(self.stack):
            if self.leaf == "para" and not rest_blank and not self._starts(line, at):
                self._append(k, line, at)  # lazy continuation
                return
            if self.leaf:
                self._close()
            del self.stack[depth:]
        if self.leaf == "fence":
            mark, size = self.fence
            m = _FENCE.match(line, _past(line, at, 3))
            self._add_code(k, k + 1)
            if m and m.group(1)[0] == mark and len(m.group(1)) >= size and not m.group(2).strip():
                self.leaf = ""
            return
        if self.leaf == "html":
            if self.html_end.search(line, at) if self.html_end else rest_blank:
                self.leaf = ""
            return
        while not rest_blank:
            indent = _indent(line, at)
            if indent > 3:
                break
            p = _past(line, at, 3)
            if line[p : p + 1] == ">":
                self._close_if("para", "table", "indented")
                self.stack.append((">", 0))
                at = p + 1
                if line[at : at + 1] in (" ", "\t"):
                    at += 1
            else:
                m = _ITEM.match(line, p)
                if not m or _BREAK.match(line, p):
                    break
                after = m.end()
                empty = _blank(line, after)
                if self.leaf == "para" and (empty or (m.group(1) and int(m.group(1)) != 1 and not self.stack)):
                    break
                self._close_if("para", "table", "indented")
                gap = _indent(line, after)
                inner = 1 if empty or gap > 4 else gap
                self.stack.append(("-", indent + after - p + inner))
                at = _past(line, after, inner)
            rest_blank = _blank(line, at)
        if rest_blank:
            if self.leaf in ("para", "table"):
                self._close()
            return
        indent, p = _indent(line, at), _past(line, at, 3)
        if indent > 3 and self.leaf != "para":
            self._close_if("table")
            self._add_code(k, k + 1)
            self.leaf = "indented"
            return
        self._close_if("indented")
        body = line[p:]
        if indent <= 3:
            html = self._html(line, p)
            if html is not None:
                self._close()
                self.leaf, self.html_end = "html", html
                if html and html.search(line, p):
                    self.leaf = ""
                return
            m = _FENCE.match(body)
            if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
                self._close()
                self.leaf, self.fence = "fence", (m.group(1)[0], len(m.group(1)))
                self._add_code(k, k + 1)
                return
            if self.leaf == "para" and _SETEXT.match(body):
                self._define()
                if self.para:
                    first = self.para[0][0]
                    title = "\n".join(self.text[a:b].strip() for _, a, b in self.para)
                    self.content.append([(a, b) for _, a, b in self.para])
                    self.headings.append((first, k + 1, title))
                    self.leaf, self.para = "", []
                    return
                self.leaf = ""
            m = _ATX.match(body)
            if m:
                self._close()
                a = self.starts[k] + p + m.end()
                text = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", line[p + m.end() :])
                a += len(text) - len(text.lstrip())
                text = text.strip()
                self.headings.append((k, k + 1, text))
                self.content.append([(a, a + len(text))])
                return
            if _BREAK.match(body):
                self._close()
                return
        if self.leaf == "table":
            self.table.append(k)
            self._cells(k, line, at)
            return
        if self.leaf == "para" and "|" in line + self.text[self.para[-1][1] : self.para[-1][2]] and _DELIMITERS.match(body):
            head, a, b = self.para[-1]
            if self._columns(self.text[a:b]) == self._columns(body):
                self.para.pop()
                if self.para:
                    self._close()
                self.leaf, self.table, self.para = "table", [head, k], []
                self._cells(head, self.text[a:b], 0, a)
                return
        self._append(k, line, at)

    def _html(self, line: str, at: int) -> re.Pattern | str | None:
        """What ends the HTML block that opens at ``at``; None if none does."""
        if line[at : at + 1] == "<":
            for k, (start, end) in enumerate(_HTML_BLOCKS):
                if start.match(line, at):
                    return None if k == 6 and self.leaf in ("para", "table") else end
        return None

    def _close_if(self, *kinds: str) -> None:
        if self.leaf in kinds:
            self._close()

    def _append(self, k: int, line: str, at: int) -> None:
        p = _SPACE.match(line, at).end()
        self.leaf = "para"
        self.para.append((k, self.starts[k] + p, self.starts[k] + len(line.rstrip())))

    def _starts(self, line: str, at: int) -> bool:
        """Whether a line opens a block that ends a paragraph."""
        if _indent(line, at) > 3:
            return False
        body = line[_past(line, at, 3) :]
        item = _ITEM.match(body)
        return bool(body.startswith(">") or self._html(body, 0) is not None or _ATX.match(body) or _FENCE.match(body) or _BREAK.match(body) or (item and body[item.end() :].strip()))

    @staticmethod
    def _columns(row: str) -> int:
        row = re.sub(r"\\.", "", row.strip())
        return row.removeprefix("|").removesuffix("|").count("|") + 1

    def _cells(self, k: int, line: str, at: int, start: int | None = None) -> None:
        base = self.starts[k] if start is None else start
        for m in re.finditer(r"(?:[^|\\]|\\.)+", line[at:]):
            cell = m.group(0)
            a = base + at + m.start() + len(cell) - len(cell.lstrip())
            if cell.strip():
                self.content.append([(a, a + len(cell.strip()))])


class Inline:
    """Marks of one inline text; ``ranges`` are places in ``s``."""

    def __init__(self, s: str, labels: set[str]):
        self.s, self.labels = s, labels
        self.ranges: list[Range] = []
        self.brackets: list[tuple[int, bool, int]] = []  # place, is image, number of runs before
        self.dead = 0  # how many of them, from the first, can't be links any more as one stands in them
        self.runs: list[list] = []  # character, place, size, opens, closes, size at first
        self.tags = Tags(s)
        self.destinations: Destinations | None = None
        self.ticks: dict[int, list[int]] | None = None
        self._scan()
        self._emphasis(0)

    def _scan(self) -> None:
        s, i = self.s, 0
        while m := _SPECIAL.search(s, i):
            i = m.start()
            c = s[i]
            if c == "\\":
                i += 2 if i + 1 < len(s) and s[i + 1] in _PUNCTUATION else 1
            elif c == "`":
                n = _size(s, i)
                end = self._ticks_end(i + n, n)
                if end:
                    self.ranges.append((i, end))
                i = end or i + n
            elif c == "<" and (m := _AUTOLINK.match(s, i)):
                self.ranges.append((i, m.end()))
                i = m.end()
            elif c == "<" and (tag := self.tags.scan(i)):
                i = tag[0]
            elif c == "!" and s[i + 1 : i + 2] == "[":
                self.brackets.append((i, True, len(self.runs)))
                i += 2
            elif c == "[":
                self.brackets.append((i, False, len(self.runs)))
                i += 1
            elif c == "]":
                i = self._bracket(i)
            elif c in "*_":
                n = _size(s, i)
                self._run(c, i, n)
                i += n
            else:
                i += 1

    def _ticks_end(self, at: int, n: int) -> int:
        """Place after the first run of ``n`` back-ticks from ``at`` on, 0 if there is none."""
        if self.ticks is None:
            self.ticks = defaultdict(list)
            for m in re.finditer("`+", self.s):
                self.ticks[m.end() - m.start()].append(m.start())
        runs = self.ticks.get(n, [])
        k = bisect_left(runs, at)
        return runs[k] + n if k < len(runs) else 0

    def _run(self, c: str, at: int, n: int) -> None:
        before, after = self.s[at - 1 : at] or " ", self.s[at + n : at + n + 1] or " "
        mark = lambda x: not x.isalnum() and not x.isspace()
        left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
        right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
        if c == "_":
            left, right = left and (not right or mark(before)), right and (not left or mark(after))
        self.runs.append([c, at, n, left, right, n])

    def _bracket(self, i: int) -> int:
        if not self.brackets:
            return i + 1
        start, image, runs = self.brackets.pop()
        active = image or len(self.brackets) >= self.dead
        self.dead = min(self.dead, len(self.brackets))
        end = self._link_end(i, start + (2 if image else 1)) if active else 0
        if not end:
            return i + 1
        if image:
            self.ranges.append((start, end))
            del self.runs[runs:]
        else:
            self.ranges += [(start, start + 1), (i, end)]
            self._emphasis(runs)
            self.dead = len(self.brackets)
        return end

    def _link_end(self, close: int, start: int) -> int:
        """Place after a link whose text goes from ``start`` to ``close``; 0 if it's none."""
        s, at = self.s, close + 1
        if s[at : at + 1] == "(":
            self.destinations = self.destinations or Destinations(s)
            end = self.destinations.end(at)
            if end:
                return end
        if not self.labels:
            return 0
        m = _LABEL.match(s, at)
        name = m.group(1) if m and m.group(1).strip() else s[start:close]
        if " ".join(name.split()).casefold() in self.labels:
            return m.end() if m else at
        return 0

    def _emphasis(self, first: int) -> None:
        """Pair runs from ``first`` on; every paired mark is a range."""
        open_: list[tuple[int, list]] = []
        failed: dict[tuple, int] = {}  # number of the last run that a closer of this kind was tried on in vain
        for k, closer in enumerate(self.runs[first:]):
            kind = (closer[0], closer[3], closer[5] % 3)
            while closer[4] and closer[2]:
                least, j = failed.get(kind, -1), len(open_) - 1
                while j >= 0 and open_[j][0] > least:
                    opener = open_[j][1]
                    odd = (opener[4] or closer[3]) and (opener[5] + closer[5]) % 3 == 0 and (opener[5] % 3 or closer[5] % 3)
                    if opener[0] == closer[0] and not odd:
                        break
                    j -= 1
                else:
                    failed[kind] = open_[-1][0] if open_ else least
                    break
                opener = open_[j][1]
                n = 2 if opener[2] > 1 and closer[2] > 1 else 1
                at = opener[1] + opener[2] - n
                self.ranges += [(at, at + n), (closer[1], closer[1] + n)]
                opener[2] -= n
                closer[1], closer[2] = closer[1] + n, closer[2] - n
                del open_[j + (opener[2] > 0) :]
            if closer[3] and closer[2]:
                open_.append((k, closer))
        del self.runs[first:]


def _size(s: str, at: int) -> int:
    """How often the character at ``at`` is repeated from there."""
    n, c = 1, s[at]
    while s[at + n : at + n + 1] == c:
        n += 1
    return n


class Destinations:
    """Ends of ``(destination "title")`` in a text, asked for from left to right: the brackets of a word are paired once, from the first place asked for on."""

    def __init__(self, s: str):
        self.s = s
        self.pair: dict[int, int] = {}  # an open bracket's own end in its word
        self.last = -1  # the open bracket that stays open in its word, with none that does after it
        self.first = self.after = 0  # from where to where brackets are paired
        self.stop = -1  # there, the first closing bracket that closes none

    def _pair(self, at: int) -> None:
        if self.first <= at < self.after:
            return
        self.pair, self.stop, open_ = {}, -1, []
        self.first, self.after = at, _word_end(self.s, at)
        for x in _BRACKETS.finditer(self.s, at, self.after):
            if x.group() == "(":
                open_.append(x.start())
            elif x.group() == ")":
                if open_:
                    self.pair[open_.pop()] = x.start()
                elif self.stop < 0:
                    self.stop = x.start()
        self.last = open_[-1] if open_ else -1

    def end(self, at: int) -> int:
        """Place after what opens at the bracket ``at``; 0 if it isn't closed."""
        s, i = self.s, at + 1
        while s[i : i + 1] and s[i] in " \t\n":
            i += 1
        if s[i : i + 1] == "<":
            m = _POINTED.match(s, i)
            if not m:
                return 0
            i = m.end()
        elif i == len(s) or s[i].isspace():
            pass
        elif i > at + 1:
            self._pair(i)
            if self.stop < 0 and self.last >= 0:
                return 0
            i = self.stop if self.stop >= 0 else self.after
        else:
            self._pair(at)
            if at in self.pair:
                i = self.pair[at]
            elif at == self.last:
                i = self.after
            else:
                return 0
        m = _TITLE_END.match(s, i)
        return m.end() if m else 0


_WHITE = re.compile(r"\s")
_BRACKETS = re.compile(r"\\[!-/:-@\[-`{-~]|[()]")


def _word_end(s: str, at: int) -> int:
    m = _WHITE.search(s, at)
    return m.start() if m else len(s)


class Tags:
    """The tags of a text. Openings whose ends are missing are remembered, so that none is looked for twice."""

    def __init__(self, s: str):
        self.s = s
        self.ends: TagEnds | None = None
        self.missing: set[str] = set()
        self.closings: dict[str, tuple[int, int]] = {}

    def scan(self, start: int) -> tuple[int, str, bool, bool] | None:
        """End, name, whether closing, whether self-closing of the HTML/JSX tag at ``start``; None if there is none.

        Quotes of any kind hide what they hold, braces what is no quote in them; a tag ends at the first > outside both that isn't the mark of a quote.
        """
        s = self.s
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")):
            if s.startswith(opening, start):
                end = -1 if closing in self.missing else s.find(closing, start + len(opening))
                if end < 0:
                    self.missing.add(closing)
                    return None
                return end + len(closing), "", False, True
        for fragment in ("<>", "</>"):
            if s.startswith(fragment, start):
                return start + len(fragment), "", fragment == "</>", False
        is_closing = s.startswith("/", start + 1)
        m = _TAG_NAME.match(s, start + 1 + is_closing)
        if not m:
            return None
        at = m.end()
        if at < len(s) and not (s[at].isspace() or s[at] in "/>={"):
            return None
        plain = _PLAIN_END.match(s, at)
        if plain:
            end = plain.end()
        else:
            self.ends = self.ends or TagEnds(s, lines=True)
            end = self.ends.end(at)
        return (end, m.group(0), is_closing, s[start : end - 1].rstrip().endswith("/")) if end >= 0 else None

    def closing(self, name: str, at: int) -> int:
        """Place of the first closing tag of ``name`` from ``at`` on; -1 if there is none."""
        searched, found = self.closings.get(name, (0, 0))
        if not (searched <= at <= found or found < 0):
            m = re.compile(rf"</\s*{name}(?=[\s>])", re.I).search(self.s, at)
            found = m.start() if m else -1
            self.closings[name] = (at, found)
        return found


def scan_tag(s: str, start: int, limit: int | None = None) -> tuple[int, str, bool, bool] | None:
    """:meth:`Tags.scan` of the text up to ``limit``."""
    return Tags(s[:limit]).scan(start)


def tag_ranges(text: str, protected: list[Range]) -> list[Range]:
    """Tags outside ``protected``; script and style up to and with their closing tag, if they have one."""
    out, at, tags = [], 0, Tags(text)
    firsts = [a for a, _ in protected]
    while (at := text.find("<", at)) >= 0:
        k = bisect_right(firsts, at) - 1
        if k >= 0 and at < protected[k][1]:
            at = protected[k][1]
            continue
        tag = tags.scan(at)
        if not tag:
            at += 1
            continue
        end, name, closing, alone = tag
        if name.lower() in ("script", "style") and not closing and not alone:
            place = tags.closing(name.lower(), end)
            last = tags.scan(place) if place >= 0 else None
            if last and last[2] and last[1].lower() == name.lower():
                end = last[0]
        out.append((at, end))
        at = end
    return out


def url_ranges(text: str, protected: list[Range] = ()) -> list[Range]:
    """Bare URLs, wherever one starts: to white space, quotes, Japanese marks or a bracket that isn't open in it, without marks at the end."""
    out = []
    for m in _URL.finditer(text):
        if (out and m.start() < out[-1][1]) or overlaps(m.start(), m.end(), protected):
            continue
        at, open_ = _URL_RUN.match(text, m.end()).end(), []
        while at < len(text) and text[at] in "()[]{}":
            if text[at] in "([{":
                open_.append(text[at])
            elif not open_ or open_[-1] != _PAIRS[text[at]]:
                break
            else:
                open_.pop()
            at = _URL_RUN.match(text, at + 1).end()
        while at > m.start() and text[at - 1] in _URL_TAIL:
            at -= 1
        if at > m.start():
            out.append((m.start(), at))
    return out


def parse(text: str) -> Parsed:
    """Everything the checks need of one text."""
    blocks = Blocks(text)
    inline: list[Range] = []
    for parts in blocks.content:
        s = "\n".join(text[a:b] for a, b in parts)
        if not _SPECIAL.search(s):
            continue
        firsts = [0]  # where each line of s starts
        for a, b in parts[:-1]:
            firsts.append(firsts[-1] + b - a + 1)
        for a, b in Inline(s, blocks.labels).ranges:
            # A range over several lines leaves out what stands between them, but for the line's end itself.
            k = bisect_right(firsts, a) - 1
            while a < b:
                size = parts[k][1] - parts[k][0]
                last = min(b, firsts[k] + size + 1)
                shift = parts[k][0] - firsts[k]
                inline.append((a + shift, last + shift))
                a, k = last, k + 1
    protected = merge_ranges(blocks.code + inline + blocks.definitions)
    marked = merge_ranges(protected + tag_ranges(text, protected))
    ranges = merge_ranges(marked + url_ranges(mask_ranges(text, marked)))
    return Parsed(ranges, sorted(blocks.headings), sorted(blocks.tables), merge_ranges(inline), mask_ranges(text, ranges))


def visible(line: str, start: int, ranges: list[Range]) -> tuple[str, list[int]]:
    """The characters of a line outside ``ranges`` and their 0-based columns."""
    out, columns, at = [], [], 0
    for a, b in [*ranges, (start + len(line),) * 2]:
        a = min(a - start, len(line))
        if a > at:
            out.append(line[at:a])
            columns += range(at, a)
        at = max(at, b - start)
    return "".join(out), columns


def pieces(line: str, start: int, ranges: list[Range]) -> list[int]:
    """What :func:`visible` gives, in few numbers: of each piece outside ``ranges`` its place among the visible characters and its column, 0-based, then how many characters are visible."""
    out, at, seen = [], 0, 0
    for a, b in [*ranges, (start + len(line),) * 2]:
        a = min(a - start, len(line))
        if a > at:
            out += seen, at
            seen += a - at
        at = max(at, b - start)
    return [*out, seen]


def visible_of(line: Column, shown: Column) -> Column:
    """The visible characters of a line from its :func:`pieces` (null: all)."""
    piece = lambda x, k: F.when(k % 2 == 0, F.substr(line, F.get(shown, k + 1) + 1, F.get(shown, k + 2) - x))
    return F.when(shown.isNull(), line).otherwise(F.array_join(F.transform(shown, piece), ""))


def column_of(shown: Column, place: Column) -> Column:
    """The column in the line of a place among its visible characters, both 1-based: later pieces are further from theirs."""
    return F.when(shown.isNull(), place).otherwise(place + F.array_max(F.transform(shown, lambda x, k: F.when((k % 2 == 0) & (x < place), F.get(shown, k + 1) - x))))


_LINE = {"n": pa.int32(), "line": pa.string(), "masked": pa.string(), "visible": pa.string(), "columns": pa.list_(pa.int32()), "title": pa.string(), "heading_end": pa.int32(), "nominal": pa.bool_(), "shown": pa.list_(pa.int32())}
_LINE_SPARK = {"n": "int", "line": "string", "masked": "string", "visible": "string", "columns": "array<int>", "title": "string", "heading_end": "int", "nominal": "boolean", "shown": "array<int>"}
#: All but ``shown``, which holds visible and columns in less room.
FIELDS = tuple(x for x in _LINE if x != "shown")
LINES = f"array<struct<{','.join(f'{name}:{kind}' for name, kind in _LINE_SPARK.items() if name in FIELDS)}>>"
_SPARK = {"masked": "string", "ranges": "array<struct<start:int,end:int>>", "inlines": "array<struct<start:int,end:int>>", "lines": LINES}


def line_rows(text: str, p: Parsed, seen: bool = True, cut: bool = False) -> list[dict]:
    """Every line with what the line checks ask for; headings whose masked line is blank do not count. ``seen``: with visible and columns; ``cut``: with shown."""
    lines, masked, starts = text.split("\n"), p.masked.split("\n"), line_starts(text)
    headings = [h for h in p.headings if masked[h[0]].strip()]
    title = {a: t for a, _, t in headings}
    ends = {b - 1 for _, b, _ in headings}
    nominal = {k for a, b, _ in headings for k in range(a, b)} | {k for a, b in p.tables for k in range(a, b)}
    rows = []
    at = 0
    for k, (line, start) in enumerate(zip(lines, starts)):
        row = {"n": k + 1, "line": line, "masked": masked[k], "title": title.get(k), "heading_end": int(k in ends), "nominal": k in nominal}
        rows.append(row)
        if not (seen or cut):
            continue
        while at < len(p.ranges) and p.ranges[at][1] <= start:
            at += 1
        near = at
        own = []
        while near < len(p.ranges) and p.ranges[near][0] < start + len(line):
            own.append(p.ranges[near])
            near += 1
        if seen:
            row["visible"], row["columns"] = visible(line, start, own) if own else (line, None)
        if cut:
            row["shown"] = pieces(line, start, own) if own else None
    return rows


def range_lists(rows: list[list[Range]]) -> pa.ListArray:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    sides = [pa.array([x[k] for r in rows for x in r], pa.int32()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(sides, ["start", "end"]))


def _line_lists(rows: list[list[dict]], fields: Sequence[str]) -> pa.ListArray:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    parts = [pa.array([x[name] for r in rows for x in r], _LINE[name]) for name in fields]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, list(fields)))


#: How each column comes from texts and what their parses hold.
_MADE: dict[str, Callable[[list[str], list[Parsed]], pa.Array]] = {
    "masked": lambda texts, got: pa.array([p.masked for p in got], pa.string()),
    "ranges": lambda texts, got: range_lists([p.ranges for p in got]),
    "inlines": lambda texts, got: range_lists([p.inlines for p in got]),
}


def parsed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), columns: tuple[str, ...] = ("text", "masked", "ranges", "inlines", "lines"), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``keep`` and of text, masked, ranges, inlines, lines (with ``fields``) the asked ``columns`` of every row: one pass of Arrow batches, one parse a document, no shuffle."""
    names, made = list(keep), [c for c in columns if c != "text"]
    with_text = ["text"] * ("text" in columns)
    seen, cut = bool({"visible", "columns"} & set(fields)), "shown" in fields
    making = _MADE | {"lines": lambda texts, got: _line_lists([line_rows(t, p, seen, cut) for t, p in zip(texts, got)], fields)}
    kinds = _SPARK | {"lines": f"array<struct<{','.join(f'{name}:{_LINE_SPARK[name]}' for name in fields)}>>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts = [x.as_py() or "" for x in some.column(len(names))]
                got = [parse(t) for t in texts]
                own = [pa.array(texts, pa.string())] * len(with_text)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], *own, *[making[c](texts, got) for c in made]], [*names, *with_text, *made])

    source = docs.select(*names, docs["text"].cast("string").alias("text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text" or with_text] + [f"{c} {kinds[c]}" for c in made]
    return source.mapInArrow(run, ", ".join(schema))
