"""The library's parsers as SQL functions.

    register(spark)
    SELECT d.doc_id, r.* FROM docs d, LATERAL markdown_ranges(d.text) r
    SELECT d.doc_id, h.* FROM docs d, LATERAL markdown_headings(d.text) h WHERE h.title LIKE '%Spark%'
    SELECT doc_id, mask_markdown(text) AS masked, article_text(text) AS body FROM docs
    SELECT d.doc_id, t.* FROM docs d, LATERAL term_places(d.text, array('比較', 'eufy'), 'longest') t

Table functions give a row for each thing found in their text and may be joined laterally to any table; Spark spreads the rows they are given. Scalar functions take and give Arrow batches. All give what the DataFrame forms give
(``markdown.parsed``, ``article.extract_article``, ``dictionary.term_matches``). Null texts have no rows, and null results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from hondana.functions import article, dictionary, markdown


class MarkdownRanges:
    """start, end (half-open, in characters) of all that is not prose."""

    def eval(self, text: str | None) -> Iterator[tuple[int, int]]:
        yield from markdown.parse(text).ranges if text is not None else ()


class MarkdownHeadings:
    """first_line (from 1), lines and title of every heading."""

    def eval(self, text: str | None) -> Iterator[tuple[int, int, str]]:
        for first, after, title in markdown.parse(text).headings if text is not None else ():
            yield first + 1, after - first, title


class TermPlaces:
    """col (from 1), matched, term of every match of an array of terms; ``mode`` as ``dictionary.term_matches`` has it. The automaton is built once for as long as the terms stay the same."""

    def __init__(self):
        self.terms: list[str] | None = None

    @staticmethod
    def analyze(text: AnalyzeArgument, terms: AnalyzeArgument, mode: AnalyzeArgument) -> AnalyzeResult:
        if mode.isConstantExpression and mode.value not in dictionary.MODES:
            raise ValueError(f"mode must be one of {dictionary.MODES}")
        return AnalyzeResult(StructType().add("col", IntegerType()).add("matched", StringType()).add("term", StringType()))

    def eval(self, text: str | None, terms: list[str] | None, mode: str) -> Iterator[tuple[int, str, str]]:
        if text is None or not terms:
            return
        if terms != self.terms:
            self.terms, self.spelt = terms, {}
            for term in dict.fromkeys(t for t in terms if t):
                self.spelt.setdefault(dictionary.one_case(term), []).append(term)
            self.words = list(self.spelt)
            self.automaton = dictionary.Automaton(self.words)
        found = [(start, len(self.words[n]), term) for start, n in self.automaton.matches(dictionary.one_case(text)) for term in self.spelt[self.words[n]]]
        for start, size, term in dictionary.resolved(found, mode):
            yield start + 1, text[start : start + size], term


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL in this session."""
    spark.udtf.register("markdown_ranges", udtf(MarkdownRanges, returnType="start: int, end: int"))
    spark.udtf.register("markdown_headings", udtf(MarkdownHeadings, returnType="first_line: int, lines: int, title: string"))
    spark.udtf.register("term_places", udtf(TermPlaces))
    texts = lambda f: lambda x: pd.Series([None if t is None else f(t) for t in x], dtype=object)
    spark.udf.register("mask_markdown", pandas_udf(texts(lambda t: markdown.parse(t).masked), "string"))
    spark.udf.register("article_text", pandas_udf(texts(article.extract_article), "string"))
