"""Where tags of a text end, whatever place they start at, in time linear in the text.

What follows a tag's name is a chain of states that doesn't depend on where the tag began: quotes hide all up to the next such quote, braces hide what
is no quote, and outside both a ``>`` ends the tag. So the marks are read once from the left (are quotes escaped, is a ``>`` the mark of a quoted
line, does the next line go on with a tag) and resolved once from the right: for each, where a tag that is outside quotes and braces there ends, and
where the open brace is closed. A ``<`` that starts no tag then costs one look-up.
"""

from __future__ import annotations

import re
from bisect import bisect_left

_MARKS = re.compile(r"\\+|[\"'`{}>]")
_MARKS_AND_LINES = re.compile(r"\\+|[\"'`{}>\n]")
# How a line goes on with a tag (behind the marks of quotes), where a quote's mark stands.
_QUOTED = re.compile(r"[ \t]{0,3}(?:>(?=[> \t])[ \t]?)+")
_CONTINUES = re.compile(r"[ \t]+[^ \t\n]|/?>|\{|[A-Za-z_:][A-Za-z0-9_.:-]*\s*=")
_QUOTE_MARKS = re.compile(r"[ \t]{0,3}(?:>[ \t]?)*")


class TagEnds:
    """Ends of tags in ``text``; with ``lines``, a line end is part of a tag only if the next line goes on with it, and marks of quotes end none."""

    def __init__(self, text: str, lines: bool):
        self.places: list[int] = []
        kinds: list[str] = []
        counts: list[bool] = []  # whether a quote can close, a line goes on, a > can end a tag
        escaped, head, marks = -1, 0, -1
        for m in (_MARKS_AND_LINES if lines else _MARKS).finditer(text):
            c, at = m.group(), m.start()
            if c[0] == "\\":
                escaped = m.end() if len(c) % 2 else -1
                continue
            if c in "\"'`":
                count = at != escaped
            elif c == "\n":
                quoted = _QUOTED.match(text, at + 1)
                count = bool(_CONTINUES.match(text, quoted.end() if quoted else at + 1))
                head, marks = at + 1, -1
            elif c == ">" and lines and head:
                if marks < 0:
                    marks = _QUOTE_MARKS.match(text, head).end()
                count = not (at < marks and text[at + 1 : at + 2] in (" ", "\t", ">"))
            else:
                count = True
            self.places.append(at)
            kinds.append(c)
            counts.append(count)
        none = len(kinds)
        self.ends, closed = [-1] * (none + 1), [none] * (none + 1)
        next_quote = {"'": none, '"': none, "`": none}
        for k in range(none - 1, -1, -1):
            c, after = kinds[k], k + 1
            if c in next_quote:
                after = min(next_quote[c] + 1, none)
                if counts[k]:
                    next_quote[c] = k
            if c == "}":
                closed[k] = after
            elif c == "{":
                after = closed[after]
                closed[k] = closed[after]
            else:
                closed[k] = closed[after]
            self.ends[k] = self.ends[after]
            if c == ">" and counts[k]:
                self.ends[k] = self.places[k] + 1
            elif c == "\n" and not counts[k]:
                self.ends[k] = -1

    def end(self, at: int) -> int:
        """Place after the > that ends a tag whose name ends at ``at``; -1 if none does."""
        return self.ends[bisect_left(self.places, at)]
