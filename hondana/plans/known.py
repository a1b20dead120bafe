"""Views over ``documents`` whose marks stand at known places, as Spark columns and as SQL.

Every line of a text gives its letters, ``c``, and these without spaces, ``u``; by number a line is then put in one of eight forms.
The forms are told once, as parts: literals, c or u, each prose or not, so that texts, ranges and masked lines come from one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hondana.functions.matching import bound
from hondana.plans.sql import q
from hondana.sources.documents import documents

#: Parts (text, kind): kind 0 prose, 1 inline mark, 2 tag, 3 URL.
Part = tuple[str, int]
FORMS: tuple[tuple[Part, ...], ...] = (
    (("c", 0), (" サーバ ", 0), ("`", 1), ("c", 1), ("`", 1), (" eufy", 0)),
    (('<b data-x="', 2), ("c", 2), ('">', 2), ("c", 0), ("</b>", 2), (" eufy", 0)),
    (("c", 0), (" ", 0), ("https://x.jp/", 3), ("u", 3), (" を見る", 0)),
    (("[", 1), ("c", 0), ("](./", 1), ("u", 1), (' "t")', 1), (" github", 0)),
    (("c", 0), (" eufyとEC2にA/B", 0)),
    (("**", 1), ("c", 0), ("**", 1), (" github", 0)),
    (("<https://x.jp/", 1), ("u", 1), (">", 1), (" 鶏と養鶏", 0)),
    (("![", 1), ("c", 1), ("](i.png)", 1), (" Javascript", 0)),
)
#: Forms for extraction: what is in a document, and what comes of it ("": nothing).
ARTICLE_FORMS = (
    ("{c} `{c}`", "{c} {c}"), ("## {c}", "## {c}"), ("- {c}", "- {c}"), ("> {c}", ""), ("[{c}](u) {c}", "{c} {c}"), ("import {c}", ""), ("<!-- {c} -->{c}", "{c}"), ("<Foo a=\"{c}\">{c}</Foo>{c}", "{c}"),
)


def _lettered(spark: SparkSession, sf_dir: str, form, spelt: bool = True) -> DataFrame:
    """doc_id, parts: ``form`` (c, u, k) of every line of a text in order; u is c if not ``spelt``."""

    def one(x: Column, n: Column) -> Column:
        k = (F.col("doc_id") + n + 1) % 8
        filled = lambda letters: F.when(letters == "", F.lit("x")).otherwise(letters)
        made = lambda c: bound(F.replace(c, F.lit(" "), F.lit("")), lambda u: form(c, u, k)) if spelt else form(c, c, k)
        return bound(F.trim(F.regexp_replace(x, "[^A-Za-z]+", " ")), lambda letters: bound(filled(letters), made))

    docs = documents(spark, sf_dir).where("text is not null")
    return docs.select("doc_id", F.transform(F.split("text", "\n", -1), one).alias("parts"))


def _chosen(k: Column, values: list[Column]) -> Column:
    """The value of number ``k``; the others are not made."""
    cases = F.when(k == 0, values[0])
    for n, value in enumerate(values[1:], 1):
        cases = cases.when(k == n, value)
    return cases


def known_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: lines in their forms with blank lines between, so that each is a paragraph."""

    def form(c: Column, u: Column, k: Column) -> Column:
        return _chosen(k, [F.concat(*[c if x == "c" else u if x == "u" else F.lit(x) for x, _ in parts]) for parts in FORMS])

    return _lettered(spark, sf_dir, form).select("doc_id", F.array_join("parts", "\n\n").alias("text"))


def article_like_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text for extraction, blank lines between."""

    def form(c: Column, u: Column, k: Column) -> Column:
        return _chosen(k, [F.replace(F.lit(given), F.lit("{c}"), c) for given, _ in ARTICLE_FORMS])

    return _lettered(spark, sf_dir, form, spelt=False).select("doc_id", F.array_join("parts", "\n\n").alias("text"))


_LINES = """
lettered AS (
  SELECT doc_id, n, (doc_id + n) % 8 AS k, CASE WHEN c = '' THEN 'x' ELSE c END AS c
  FROM (SELECT doc_id, n, trim(regexp_replace(line, '[^A-Za-z]+', ' ', 'g')) AS c
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))),
spelt AS (SELECT *, replace(c, ' ', '') AS u FROM lettered)"""


def _sql(part: Part, masked: bool) -> str:
    text, kind = part
    value = text if text in ("c", "u") else q(text)
    return f"repeat(' ', length({value}))" if masked and kind else value


def _case(values: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


#: known(doc_id, n, line, masked, start): the lines with content, by their number and place in the text.
KNOWN = f"""{_LINES},
formed AS (
  SELECT doc_id, n AS m, k, c, u, {_case([" || ".join(_sql(p, False) for p in parts) for parts in FORMS])} AS line, {_case([" || ".join(_sql(p, True) for p in parts) for parts in FORMS])} AS masked FROM spelt),
known AS (
  SELECT doc_id, 2 * m - 1 AS n, k, c, u, line, masked, CAST(coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM formed)"""
#: prose(doc_id, n, line): the masked lines, for the scans of the rules.
KNOWN_PROSE = KNOWN + ",\nprose AS (SELECT doc_id, n, masked AS line FROM known)"


def known_ranges(kinds: tuple[int, ...]) -> str:
    """SELECT of doc_id, start, end of all runs of parts of ``kinds``, adjacent parts as one."""
    rows = []
    for k, parts in enumerate(FORMS):
        at, first = "begin", None
        for text, kind in [*parts, ("", 0)]:
            if kind in kinds and first is None:
                first = at
            elif kind not in kinds and first is not None:
                rows.append(f'SELECT doc_id, CAST({first} AS INTEGER) AS start, CAST({at} AS INTEGER) AS "end" FROM known WHERE k = {k}')
                first = None
            at += f" + length({text if text in ('c', 'u') else q(text)})"
    return "\nUNION ALL\n".join(rows)


#: blocks(doc_id, m, given, block): what extraction is given and makes of each line.
ARTICLE_LIKE = f"""{_LINES},
blocks AS (SELECT doc_id, n AS m, k, {_case([f"replace({q(a)}, '{{c}}', c)" for a, _ in ARTICLE_FORMS])} AS given, {_case([f"replace({q(b)}, '{{c}}', c)" for _, b in ARTICLE_FORMS])} AS block FROM spelt)"""
