"""Profiles, dispatch and results: which checks run, their union in order, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hondana.functions.markdown import column_of, parsed, visible_of
from hondana.functions.matching import find_all, pattern, strip
from hondana.operators import external, frontmatter, intervals, notation, secrets, structure, style
from hondana.schema import CATEGORIES, CHECKS, ISSUE_COLUMNS, line_issues
from hondana.sources.documents import lines as split_lines

PROFILES: dict[str, tuple[str, ...]] = {
    "qiita": ("secrets", "notation", "ai_writing"),
    "blog": ("secrets", "notation", "ai_writing", "blog_style", "blog_structure"),
    "vault": ("secrets", "frontmatter"),
}
CATEGORY_LABELS = dict(zip(CATEGORIES, ("機密情報の検出", "表記ブレの検出", "AI 文体の検出", "blog 文体ルールの検出", "blog 構成ルールの検出", "Vault ルールの検出")))
PUBLISH_PROFILE = "qiita"


def checks_of(profile: str) -> tuple[str, ...]:
    if profile not in PROFILES:
        raise ValueError(f"不明なプロファイルです: {profile}")
    return PROFILES[profile]


def with_checks(rows: DataFrame) -> DataFrame:
    """``rows`` with a row for each check of their ``profile``: place (in order of emission) and name. A profile that isn't one is an error; null has no checks."""
    of = F.create_map(*[x for p, checks in PROFILES.items() for x in (F.lit(p), F.array(*map(F.lit, checks)))])
    unknown = F.raise_error(F.concat(F.lit("不明なプロファイルです: "), F.col("profile"))).cast("array<string>")
    checks = F.when(F.col("profile").isNotNull(), F.coalesce(F.try_element_at(of, F.col("profile")), unknown))
    return rows.select("*", F.posexplode(checks).alias("place", "name"))


def style_issues(lines: DataFrame, trees: DataFrame) -> list[DataFrame]:
    """The style checks of parsed documents and their lines that are no probes of a line."""
    extra = tuple(c for c in ("file",) if c in lines.columns)
    # A mark that is visible stands in the masked line as well; of a generator's row the visible line is made once.
    marked = lines.where("not nominal").where(reduce(or_, [F.contains("masked", F.lit(m)) for m in style.MARKS]))
    seen = marked.withColumn("visible", F.explode(F.array(visible_of(F.col("line"), F.col("shown")))))
    ended = style.endings(style.sentences(seen, "visible", ("doc_id", "n", "shown", *extra)))
    # ``at`` counts in the visible line from the sentence's column on.
    ended = ended.withColumn("col", column_of(F.col("shown"), F.col("col") + F.col("at")))
    return [style.check_open_kanji(lines), style.check_style_mixing(ended), style.check_opening_mazu_of(trees)]


#: Turns documents into (doc_id, json and perhaps failure).
Linter = Callable[[DataFrame], DataFrame]
_kept: ContextVar[list[DataFrame] | None] = ContextVar("kept", default=None)
#: Of the last call outside of any block, in this thread.
_last: ContextVar[DataFrame | None] = ContextVar("last", default=None)


@contextmanager
def keeping() -> Iterator[None]:
    """In this block :func:`lint` keeps the parsed documents of all its calls, and drops them at the end; issues that are still to be computed then parse anew.

    Blocks of different threads, and nested ones, keep what is their own.
    """
    token = _kept.set([])
    try:
        yield
    finally:
        for tree in _kept.get():
            tree.unpersist()
        _kept.reset(token)


def release() -> None:
    """Drop the parsed documents of the last call outside of a :func:`keeping` block."""
    tree = _last.get()
    if tree is not None:
        tree.unpersist()
        _last.set(None)


def _keep(tree: DataFrame) -> DataFrame:
    """Several branches read it: kept, so that each document is parsed once. A lost part is parsed again.

    On disk only. It is several times the input, so in memory it would take all the room that Spark has for blocks, beside what tasks hold while they write and read it.
    """
    tree = tree.persist(StorageLevel.DISK_ONLY)
    if _kept.get() is not None:
        _kept.get().append(tree)
    else:
        release()  # one at a time
        _last.set(tree)
    return tree


def lint(
    docs: DataFrame, profile: str = "blog", linters: Mapping[str, Linter] | None = None, vocabulary: DataFrame | None = None, dictionary: dict[str, str] | DataFrame | None = None, checks: tuple[str, ...] | None = None,
) -> DataFrame:
    """All issues of ``docs`` (doc_id, text and, if known, file and path) under a profile; see ``hondana.schema.ISSUES``.

    Only branches of the profile's checks are built. The Markdown pass runs once per document, for blog checks only; its
    result is kept to the end of a :func:`keeping` block, outside of one until the next call or :func:`release`. ``linters`` gives the external linter of each profile, with its configuration, where one is to run.
    ``dictionary`` holds translations that aren't official, as a table (term, preferred, place) of any length or a small dict.
    The vault profile needs ``path`` (relative to the vault) and the tag ``vocabulary``.
    """
    wanted = checks_of(profile) if checks is None else checks
    extra = tuple(c for c in ("file",) if c in docs.columns)
    parts: list[tuple[str, DataFrame]] = []
    out = None
    blog = profile == "blog"
    if "notation" in wanted and not blog:
        # Secrets are found on the same lines, in the same pass.
        known = notation.outside_fences(notation.lines_with_context(docs, ("doc_id", *extra)))
        out = line_issues(known, [secrets.family()] * ("secrets" in wanted) + [notation.legacy_family()], True)
    elif "secrets" in wanted and not blog:
        parts.append(("secrets", secrets.check_secrets(split_lines(docs.select("doc_id", *extra, "text"), ("doc_id", *extra)))))
    if blog and {"notation", "blog_style", "blog_structure"} & set(wanted):
        styled, structured = "blog_style" in wanted, "blog_structure" in wanted
        # What is kept is what the wanted checks read, and no more.
        fields = ("n", "line", "masked", *["shown", "nominal", "heading_end"] * styled, *["title"] * structured)
        tree = _keep(parsed(docs, ("doc_id", *extra), ("lines",), fields))
        lines = tree.select("doc_id", *extra, F.explode("lines").alias("l")).select("doc_id", *extra, "l.*")
        tree = tree.withColumn("masked", F.array_join(F.col("lines.masked"), "\n"))
        families = [secrets.family()] * ("secrets" in wanted)
        if "notation" in wanted:
            families += [notation.blog_family(), notation.slash_family(), notation.spacing_family()]
        if styled:
            families.append(style.comma_family())
        if families:
            out = line_issues(lines, families, True)
    elif blog and "secrets" in wanted:
        parts.append(("secrets", secrets.check_secrets(split_lines(docs.select("doc_id", *extra, "text"), ("doc_id", *extra)))))
    if "notation" in wanted and blog:
        if dictionary is None and notation.UNOFFICIAL_TRANSLATIONS or isinstance(dictionary, dict) and dictionary:
            dictionary = notation.dictionary_table(docs.sparkSession, dictionary)
        if isinstance(dictionary, DataFrame):
            fixed = sum(len(r.variants) for r in notation.rules_of("blog"))
            parts.append(("notation", notation.check_translations(lines, dictionary, fixed)))
    if "ai_writing" in wanted:
        parts.append(("ai_writing", external.check_ai_writing(docs, (linters or {}).get(profile))))
    if "blog_style" in wanted:
        parts += [("blog_style", df) for df in style_issues(lines, tree)]
    if "blog_structure" in wanted:
        parts += [("blog_structure", structure.check_citations_of(tree)), ("blog_structure", structure.check_first_mentions(tree))]
    if "frontmatter" in wanted:
        if vocabulary is None or "path" not in docs.columns:
            raise ValueError("vault プロファイルには path とタグ語彙が必要です")
        parts.append(("frontmatter", frontmatter.check_frontmatter(docs, vocabulary)))
    for check, df in parts:
        numbered = df.withColumn("seq", F.lit(CHECKS.index(check) * 1_000_000_000_000).cast("long") + F.col("seq")).select(*ISSUE_COLUMNS)
        out = numbered if out is None else out.unionByName(numbered)
    return out


def ranked(issues: DataFrame) -> DataFrame:
    """With ``rank``: place of an issue in its document, by line, column, then order of emission."""
    w = Window.partitionBy("doc_id").orderBy("line_number", "column", "seq", "rule_name", "matched_text")
    return issues.withColumn("rank", F.row_number().over(w))


def in_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy("doc_id", "line_number", "column", "seq", "rule_name", "matched_text")


def has_secret(issues: DataFrame) -> DataFrame:
    """doc_id, has_secret of documents with issues."""
    return issues.groupBy("doc_id").agg(F.bool_or(F.col("category") == "secret").alias("has_secret"))


def title_of(text: Column) -> Column:
    """The first first-level heading's text, else empty; code is not left out."""
    first = F.try_element_at(find_all(text, "(?m)(?U)(?d)^#[^\\S\\n]+[^\\s][^\\n]*$"), F.lit(1))["matched"]
    return F.coalesce(strip(F.substring(first, 2, 2_000_000_000)), F.lit(""))


def publish_gate(docs: DataFrame, tags: Column, title: Column | None = None, public: Column | None = None) -> DataFrame:
    """doc_id, decision, title, tags, private, warnings of every document, as a publisher would be told.

    ``decision``: blocked (a secret), no title, no tags or ready; notation only counts as warnings.
    """
    issues = lint(docs, PUBLISH_PROFILE, checks=("secrets", "notation"))
    counts = issues.groupBy("doc_id").agg(F.count(F.when(F.col("category") == "secret", 1)).alias("secrets"), F.count(F.when(F.col("category") == "notation", 1)).alias("warnings"))
    chosen = title_of(F.col("text")) if title is None else F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(title_of(F.col("text")))
    named = docs.select("doc_id", F.coalesce(chosen, F.lit("")).alias("title"), F.filter(F.transform(F.split(tags, ","), strip), lambda t: t != "").alias("tags"), (F.lit(True) if public is None else ~public).alias("private"))
    joined = named.join(counts, "doc_id", "left").na.fill(0, ["secrets", "warnings"])
    decision = F.when(F.col("secrets") > 0, "blocked").when(F.col("title") == "", "no title").when(F.coalesce(F.size("tags"), F.lit(0)) < 1, "no tags").otherwise("ready")
    return joined.select("doc_id", decision.alias("decision"), "title", "tags", "private", "warnings")


def report_rows(issues: DataFrame) -> DataFrame:
    """doc_id, place, text of every issue as reports print it, ordered by category and place within a document."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    w = Window.partitionBy("doc_id").orderBy(order, "line_number", "column", "seq", "rule_name", "matched_text")
    kind = F.when(F.col("needs_review"), "確認").otherwise("提案")
    head = F.concat(F.lit("L"), F.col("line_number").cast("string"), F.lit(":"), F.col("column").cast("string"), F.lit("  ["), kind, F.lit("] ["), F.col("rule_name"), F.lit("] "), F.col("message"))
    arrow = F.when(F.coalesce(F.col("suggestion"), F.lit("")) != "", F.concat(F.lit(" → "), F.col("suggestion"))).otherwise("")
    return issues.select("doc_id", F.row_number().over(w).alias("place"), "category", F.concat(head, arrow).alias("text"))


def with_source(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """``issues`` with ``source_line``, the line of the text they are on; null for places that are no line.

    Issues go to the texts of their documents, and the line is taken there, so no other line of the corpus moves.
    """
    texts = docs.select(F.col("doc_id").alias("_doc"), F.split("text", "\n", -1).alias("_lines"))
    line = F.when(F.col("line_number") > 0, F.try_element_at("_lines", F.when(F.col("line_number") > 0, F.col("line_number")).otherwise(1)))
    return issues.join(texts, F.col("doc_id") == F.col("_doc"), "left").withColumn("source_line", line).drop("_doc", "_lines")


def with_headings(issues: DataFrame, headings: DataFrame) -> DataFrame:
    """``issues`` with the last of ``headings`` (doc_id, n, line) at or before their line: heading and heading_line, null before the first."""
    found = intervals.as_of(issues, headings, place="line_number", start="n", name="_heading")
    return found.select(*issues.columns, F.col("_heading.line").alias("heading"), F.col("_heading.n").alias("heading_line"))


def category_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("doc_id").alias("documents"))


def exit_status(issues: DataFrame) -> int:
    """0 if there is no issue at all, skip issues included."""
    return 1 if issues.take(1) else 0
