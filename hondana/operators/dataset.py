"""Evaluation records from two versions of articles: sections, filters, features, thresholds, constraints, report figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hondana.functions import article
from hondana.functions.matching import strip

LEAST_CHARS = 200
UNCHANGED = 0.98
WARNING_ACCURACY = 0.80
FEATURES = ("chars", "mean_sentence_chars", "period_ending_rate", "commas_per_sentence", "list_line_rate", "heading_count", "desu_masu_rate")
RECORD = (
    "id string, article string, split string, variant string, label string, granularity string, heading string, section_index int, "
    "commit string, source_path string, text string, chars int"
)


def visible_chars(text: Column) -> Column:
    """Characters other than white space and the marks of headings and lists."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else article.visible_chars(t) for t in map(_text, texts)], pa.int32())

    return F.arrow_udf(run, "int")(text.cast("string"))


def _text(x: pa.StringScalar) -> str | None:
    """A text whose bytes may be no UTF-8."""
    return str(x.as_buffer(), "utf-8", "replace") if x.is_valid else None


def sections(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, heading, section_index, text, chars: the parts of a text at its second-level headings, blank ones left out.

    Each document is cut in its row, and its sections' characters are counted there: no line leaves the row, no shuffle.
    """
    names = [*keep, "heading", "section_index", "text", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                found = [(row, k, heading, part) for row, t in enumerate(map(_text, some.column(len(keep)))) if t is not None for k, (heading, part) in enumerate(article.sections(t))]
                at, index, headings, parts = zip(*found) if found else ((),) * 4
                kept = some.select(range(len(keep))).take(pa.array(at, pa.int64()))
                chars = pa.array(map(article.visible_chars, parts), pa.int32())
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(headings, pa.string()), pa.array(index, pa.int32()), pa.array(parts, pa.string()), chars], names)

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(run, ", ".join([*_kinds(source, keep), "heading string, section_index int, text string, chars int"]))


def _kinds(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


#: Sizes of grams, the longest that a length allows, and below which ratio they allow too little.
GRAMS = (16, 12, 8, 6, 4, 3, 2, 1)
LEAST_BY_GRAMS = 0.8
#: Grams that a task gathers before it passes them on.
HELD = 200_000
#: Texts of an article and a step of length, on the side with fewer of them, that are still compared with all of the other side by their counts of characters.
CROWD = 1024
#: Odd multiplier of the rolling sum that stands for a gram.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def edits(size: int, least: float) -> int:
    """How many characters at most stand alone, in a text of this length and any other, where their ratio is ``least``."""
    return int((1 - least) * 2 * size / least + 1e-9)


def gram_lengths(least: float) -> list[tuple[int, int]]:
    """(length, gram): from which length on a text is cut to grams of which size, so that it always has more of them than there are edits."""
    out = []
    for q in GRAMS:
        spare = 1 / q - 2 * (1 - least) / least  # grams more than edits, a character
        if spare > 0.005:
            lack = [n for n in range(1, int(2 / spare) + 2) if n // q <= edits(n, least)]
            out.append((max(lack, default=0) + 1, q))
    return out


def _rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """A sum for the ``q`` characters from each place on; equal grams have equal ones."""
    out = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    for k in range(q):
        out = out * _BASE + codes[k : k + len(out)]
    return out.view(np.int64)


def similar_texts(a: DataFrame, b: DataFrame, least: float = UNCHANGED, crowd: int | None = None) -> DataFrame:
    """article, a_id, b_id, ratio of all pairs of different texts of an article (article, id, key, size, bins: distinct) with a ratio of ``least`` or more.

    A ratio bounds how much the lengths differ, so texts meet within an article in logarithmic steps of length, by lengths and counts of characters alone; a cell (article and step) in which
    both sides have more than ``crowd`` texts goes by :func:`_by_grams` instead. So pairs grow with the rows whatever an article's size, and grams are made of crowded cells alone.
    """
    crowd = CROWD if crowd is None else crowd
    step, around = _steps(least)
    a_at = a.select("article", F.col("id").alias("a_id"), F.col("size").alias("la"), F.col("bins").alias("a_bins"), F.explode(around(F.col("size"))).alias("step"))
    b_at = b.withColumn("step", step(F.col("size")))
    count = lambda df, name: df.groupBy("article", "step").agg(F.count(F.lit(1)).alias(name))
    full = count(a_at, "na").join(count(b_at, "nb"), ["article", "step"]).where(F.least("na", "nb") > crowd).select("article", "step")
    few = b_at.join(full, ["article", "step"], "left_anti").select("article", "step", F.col("id").alias("b_id"), F.col("size").alias("lb"), F.col("bins").alias("b_bins"))
    la, lb = F.col("la"), F.col("lb")
    near = a_at.join(few, ["article", "step"]).where((F.col("a_id") != F.col("b_id")) & (2 * F.least(la, lb) >= F.lit(least) * (la + lb) - 1e-9) & (2 * _common() >= F.lit(least) * (la + lb) - 1e-9))
    of_full = a_at.join(full, ["article", "step"], "left_semi").select("article", F.col("a_id").alias("id")).distinct()
    crowded = _by_grams(a.join(of_full, ["article", "id"], "left_semi"), b_at.join(full, ["article", "step"], "left_semi"), least)
    pairs = near.select("article", "a_id", "b_id").unionByName(crowded)
    side = lambda df, s: df.select("article", F.col("id").alias(f"{s}_id"), F.col("key").alias(f"{s}_key"))
    return _measured(pairs.join(side(a, "a"), ["article", "a_id"]).join(side(b, "b"), ["article", "b_id"]), least)


def _common() -> Column:
    """How many characters two texts have in common at most, by their counts."""
    return F.aggregate(F.zip_with("a_bins", "b_bins", lambda m, n: F.least(m, n)), F.lit(0), lambda t, n: t + n)


def _steps(least: float):
    """The logarithmic step of a length, and the steps that a length which allows the ratio can be in; a little wider than the bound, for what the logarithm rounds."""
    factor = max(2 / max(least, 1e-6) - 1, 1.0001) * 1.000001
    step = lambda size: F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(float(factor)))).cast("long")
    return step, lambda size: F.array(*[step(size) + k for k in (-1, 0, 1)])


def _by_grams(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """article, a_id, b_id of pairs of different texts of an article that lengths, counts of characters and grams allow ``least``.

    Characters that match nothing are single edits, ``edits`` of them at most. A text cut to more grams than that has one that stands unbroken in the other text, no
    further off than the edits. So of the grams of ``a`` as many as there may be edits and one more are looked for, those rarest in ``b``, among all of ``b``; the join is by article and gram, so neither a long
    article nor a common passage makes a group of all its sections.
    """
    cuts = gram_lengths(least)
    kind = a.schema["article"].dataType.simpleString()

    def grams(every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = lambda n: next(k for k, (length, _) in enumerate(cuts) if n >= length)
            for batch in batches:
                rows, qs, sums, places, held = [], [], [], [], 0

                def out():
                    some = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], ["article", "id", "size"]).take(pa.array(np.concatenate(rows)))
                    return pa.RecordBatch.from_arrays([*some.columns, *[pa.array(np.concatenate(x).astype(np.int32)) for x in (qs, places)], pa.array(np.concatenate(sums))], ["article", "id", "size", "q", "place", "gram"])

                for row, key in enumerate(batch.column(2)):
                    codes = np.frombuffer((key.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                    if not len(codes):
                        continue
                    # Texts of ``a`` that may be alike are this much shorter or longer.
                    lengths = (len(codes) * (2 - least) / least + 1, max(1, int(len(codes) * least / (2 - least)) - 1)) if every else (len(codes),) * 2
                    for k in range(of(lengths[0]), of(lengths[1]) + 1):
                        q = cuts[k][1]
                        found = _rolling(codes, q)
                        step = 1 if every else q
                        for first in range(0, len(found), step * HELD):  # a long text's grams go in pieces too
                            at = np.arange(first, min(first + step * HELD, len(found)), step)
                            rows.append(np.full(len(at), row))
                            qs.append(np.full(len(at), q))
                            sums.append(found[at])
                            places.append(at)
                            held += len(at)
                            if held >= HELD:
                                yield out()
                                rows, qs, sums, places, held = [], [], [], [], 0
                if rows:
                    yield out()

        return run

    cut = lambda df, every: df.select("article", "id", "key", "size").mapInArrow(grams(every), f"article {kind}, id string, size int, q int, place int, gram long")
    there = cut(b, True)
    often = there.groupBy("article", "q", "gram").agg(F.count(F.lit(1)).alias("times"))
    mine = cut(a, False).join(often, ["article", "q", "gram"], "left")
    rarest = F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram", "place")))
    most = F.floor(F.lit((1 - least) * 2 / least) * F.col("size") + 1e-9).cast("int") + 1
    chosen = mine.groupBy("article", "id", "size", "q").agg(rarest.alias("all")).select("article", F.col("id").alias("a_id"), F.col("size").alias("la"), "q", F.explode(F.slice("all", F.lit(1), most)).alias("g"))
    chosen = chosen.where("g.times > 0").select("article", "a_id", "la", "q", "g.gram", F.col("g.place").alias("pa"))
    met = chosen.join(there.select("article", F.col("id").alias("b_id"), F.col("size").alias("lb"), "q", "gram", F.col("place").alias("pb")), ["article", "q", "gram"])
    la, lb = F.col("la"), F.col("lb")
    fits = (2 * F.least(la, lb) >= F.lit(least) * (la + lb) - 1e-9) & (F.abs(F.col("pa") - F.col("pb")) <= F.lit(1 - least) * (la + lb) + 1e-9) & (F.col("a_id") != F.col("b_id"))
    pairs = met.where(fits).select("article", "a_id", "b_id").distinct()
    side = lambda df, s: df.select("article", F.col("id").alias(f"{s}_id"), F.col("size").alias(f"l{s}"), F.col("bins").alias(f"{s}_bins"))
    known = pairs.join(side(a, "a"), ["article", "a_id"]).join(side(b, "b"), ["article", "b_id"])
    return known.where(2 * _common() >= F.lit(least) * (la + lb) - 1e-9).select("article", "a_id", "b_id")


def _all_texts(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """As :func:`similar_texts`, for ratios too low for grams: texts meet where lengths and counts of characters allow the ratio, in logarithmic steps of length."""
    factor = max(2 / max(least, 1e-6) - 1, 1.0001)
    step = lambda size: F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(float(factor)))).cast("long")
    side = lambda df, s: df.select("article", F.col("id").alias(f"{s}_id"), F.col("key").alias(f"{s}_key"), F.col("size").alias(f"l{s}"), F.col("bins").alias(f"{s}_bins"), step(F.col("size")).alias("step"))
    near = side(a, "a").withColumn("step", F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)]))).join(side(b, "b"), ["article", "step"]).where("a_id != b_id")
    both, la, lb = F.aggregate(F.zip_with("a_bins", "b_bins", lambda m, n: F.least(m, n)), F.lit(0), lambda t, n: t + n), F.col("la"), F.col("lb")
    return _measured(near.where((2 * F.least(la, lb) >= least * (la + lb) - 1e-9) & (2 * both >= least * (la + lb) - 1e-9)), least)


def _measured(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([article.ratio(x.as_py(), y.as_py(), least) for x, y in zip(batch.column(3), batch.column(4))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], got], ["article", "a_id", "b_id", "ratio"])

    kind = pairs.schema["article"].dataType.simpleString()
    rows = pairs.select("article", "a_id", "b_id", "a_key", "b_key").mapInArrow(run, f"article {kind}, a_id string, b_id string, ratio double")
    return rows.where(F.col("ratio") >= least)


def _counted(sections_: DataFrame) -> DataFrame:
    """article, section_index, id (a digest of what is compared), key (that itself), its size and bins: how many of its characters fall in each of 32 by code point."""
    names = ["article", "section_index", "key", "size", "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                keys = [article.comparison_key(x.as_py() or "") for x in some.column(2)]
                bins = [np.bincount(np.frombuffer(k.encode("utf-32-le", "surrogatepass"), "<u4") % 32, minlength=32).tolist() for k in keys]
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(keys, pa.string()), pa.array(map(len, keys), pa.int32()), pa.array(bins, pa.list_(pa.int32()))], names)

    kind = sections_.schema["article"].dataType.simpleString()
    rows = sections_.select("article", F.col("section_index").cast("int"), F.col("text").cast("string")).mapInArrow(run, f"article {kind}, section_index int, key string, size int, bins array<int>")
    return rows.withColumn("id", F.sha2("key", 256))


def _alike(drafts: DataFrame, published: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """article, a_id, b_id, ratio of the texts of both sides that are alike or equal, and each side's sections with their text's id."""
    if not 0 <= least <= 1:
        raise ValueError("節の類似度は 0 以上 1 以下で指定してください")
    a, b = _counted(drafts), _counted(published)
    texts = [df.select("article", "id", "key", "size", "bins").dropDuplicates(["article", "id"]) for df in (a, b)]
    near = similar_texts(*texts, least) if least >= LEAST_BY_GRAMS else _all_texts(*texts, least)
    equal = texts[0].select("article", "id").join(texts[1].select("article", "id"), ["article", "id"]).select("article", F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(1.0).alias("ratio"))
    return near.unionByName(equal), a.select("article", "section_index", F.col("id").alias("a_id")), b.select("article", "section_index", F.col("id").alias("b_id"))


def similar_sections(drafts: DataFrame, published: DataFrame, least: float = UNCHANGED) -> DataFrame:
    """article, draft_index, published_index, ratio of pairs of one article whose texts are ``least`` alike.

    Texts are compared, each once, and stand for the sections that have them; see :func:`similar_texts`. Sections of a null article pair with none; empty texts equal each other.
    """
    pairs, a, b = _alike(drafts, published, least)
    both = pairs.join(a.withColumnRenamed("section_index", "draft_index"), ["article", "a_id"]).join(b.withColumnRenamed("section_index", "published_index"), ["article", "b_id"])
    return both.select("article", "draft_index", "published_index", "ratio")


def unchanged_sections(drafts: DataFrame, published: DataFrame, least: float = UNCHANGED) -> tuple[DataFrame, DataFrame]:
    """article, section_index of the drafts and of the published sections that are alike; copies are never paired with each other."""
    pairs, a, b = _alike(drafts, published, least)
    return a.join(pairs, ["article", "a_id"], "left_semi").select("article", "section_index"), b.join(pairs, ["article", "b_id"], "left_semi").select("article", "section_index")


def filtered_sections(drafts: DataFrame, published: DataFrame, least_chars: int = LEAST_CHARS, unchanged: float = UNCHANGED) -> tuple[DataFrame, DataFrame]:
    """Both versions' sections without short ones and without those nearly alike in both (both sides go)."""
    if least_chars < 0:
        raise ValueError("節の最小文字数は 0 以上で指定してください")
    long_drafts, long_published = drafts.where(F.col("chars") >= least_chars), published.where(F.col("chars") >= least_chars)
    gone_drafts, gone_published = unchanged_sections(long_drafts, long_published, unchanged)
    return long_drafts.join(gone_drafts, ["article", "section_index"], "left_anti"), long_published.join(gone_published, ["article", "section_index"], "left_anti")


def exclusions(drafts: DataFrame, published: DataFrame, least_chars: int = LEAST_CHARS, unchanged: float = UNCHANGED) -> DataFrame:
    """One row: short_draft, short_published, unchanged_draft, unchanged_published."""
    long_drafts, long_published = drafts.where(F.col("chars") >= least_chars), published.where(F.col("chars") >= least_chars)
    gone_drafts, gone_published = unchanged_sections(long_drafts, long_published, unchanged)
    short = lambda df, name: df.agg(F.count(F.when(F.col("chars") < least_chars, 1)).alias(name))
    return (
        short(drafts, "short_draft").join(short(published, "short_published"))
        .join(gone_drafts.agg(F.count_distinct("article", "section_index").alias("unchanged_draft"))).join(gone_published.agg(F.count_distinct("article", "section_index").alias("unchanged_published")))
    )


def surface_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the seven features of each text, all found in one pass over its lines; of a null text numbers are null and rates 0."""
    missing = tuple(None if f in ("chars", "heading_count") else 0.0 for f in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [missing if t is None else article.surface_features(t) for t in map(_text, batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array([x[k] for x in found], pa.float64()) for k in range(len(FEATURES))]], [*keep, *FEATURES])

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(run, ", ".join([*_kinds(source, keep), *[f"{f} double" for f in FEATURES]]))


def best_threshold(rows: DataFrame, value: str, label: str = "label", positive: str = "ai", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, accuracy, threshold, ai_when: the single cut that tells labels apart best; ties go to the lowest cut, <= before >.

    Values are grouped first, so the window runs over distinct values, not rows.
    """
    counts = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.when(F.col(label) == positive, 1)).alias("hit"), F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*by).orderBy("v")
    every = Window.partitionBy(*by)
    run = up.rowsBetween(Window.unboundedPreceding, 0)
    known = counts.select(*by, "v", F.sum("hit").over(run).alias("low_hit"), F.sum("n").over(run).alias("low_n"), F.sum("hit").over(every).alias("hits"), F.sum("n").over(every).alias("total"), F.lead("v").over(up).alias("next"), F.lag("v").over(up).alias("before"))
    # Cuts: one below all values, then after each value half way to the next, and the last value itself.
    after = F.struct(F.coalesce((F.col("v") + F.col("next")) / 2, F.col("v")).alias("threshold"), F.col("low_hit").alias("low_hit"), F.col("low_n").alias("low_n"))
    under = F.struct((F.col("v") - 1.0).alias("threshold"), F.lit(0).cast("long").alias("low_hit"), F.lit(0).cast("long").alias("low_n"))
    cuts = known.select(*by, "hits", "total", F.explode(F.when(F.col("before").isNull(), F.array(under, after)).otherwise(F.array(after))).alias("c")).select(*by, "hits", "total", "c.*")
    right = F.col("low_hit") + (F.col("total") - F.col("low_n")) - (F.col("hits") - F.col("low_hit"))
    scored = cuts.select(*by, "threshold", F.explode(F.array(F.struct(F.lit("<=").alias("ai_when"), right.alias("right"), F.lit(0).alias("o")), F.struct(F.lit(">").alias("ai_when"), (F.col("total") - right).alias("right"), F.lit(1).alias("o")))).alias("d"), "total")
    best = scored.groupBy(*by).agg(F.max_by(F.struct("threshold", "d.ai_when", "d.right", "total"), F.struct(F.col("d.right"), -F.col("threshold"), -F.col("d.o"))).alias("b"))
    return best.select(*by, (F.col("b.right") / F.col("b.total")).alias("accuracy"), F.col("b.threshold").alias("threshold"), F.col("b.ai_when").alias("ai_when"))


def assemble(articles: DataFrame, kept: DataFrame) -> DataFrame:
    """Records (see RECORD) of whole articles and of their sections; ``articles``: article, split, variant, label, commit, source_path, text.

    Sections that bring these columns themselves, as :func:`sections` keeps them, are taken as they are; others get them from their article by a join.
    """
    base = articles.withColumn("granularity", F.lit("article")).withColumn("heading", F.lit(None).cast("string")).withColumn("section_index", F.lit(None).cast("int"))
    base = base.withColumn("id", F.concat_ws(":", "article", "variant", F.lit("article"))).withColumn("chars", visible_chars(F.col("text")))
    info = articles.drop("text")
    parts = kept if set(info.columns) <= set(kept.columns) else kept.join(info, ["article", "variant"])
    parts = parts.withColumn("granularity", F.lit("section")).withColumn("id", F.concat_ws(":", "article", "variant", F.lit("section"), F.col("section_index").cast("string")))
    names = [x.split()[0] for x in RECORD.split(", ")]
    return base.select(*names).unionByName(parts.select(*names))


#: What is wrong with a record by itself.
_OF_RECORD = (
    ("empty text", "text is null or trim(text) = ''"),
    ("article with heading", "granularity = 'article' and (heading is not null or section_index is not null)"),
    ("section without heading", "granularity = 'section' and (heading is null or heading = '' or section_index is null or section_index < 0)"),
    ("label", "not coalesce((variant = 'draft' and label = 'ai') or (variant = 'published' and label = 'human'), false)"),
    ("granularity", "not coalesce(granularity in ('article', 'section'), false)"),
    ("unknown split", "not coalesce(split in ('train', 'test'), false)"),
    ("empty id", "id is null or id = ''"),
)


def violations(records: DataFrame) -> DataFrame:
    """check, key of every broken constraint: none for sound records.

    One scan and one grouped aggregate: a record goes to the group of its id, of its article, of all records and of every check that it fails by itself; whether values differ is told by their
    least and greatest, so groups of any size are added up before they move. A table without records fails for want of sections.
    """
    # Texts are read before records go to their groups, once each.
    failed = F.filter(F.array(*[F.when(F.expr(rule), F.lit(check)) for check, rule in _OF_RECORD], F.when(~F.col("chars").eqNullSafe(F.col("_chars")), F.lit("chars"))), lambda x: x.isNotNull())
    records = records.withColumn("_chars", visible_chars(F.col("text"))).select(
        "id", "article", "split", "variant", "granularity", failed.alias("failed"), F.when(F.col("granularity") == "article", F.sha2(strip(F.col("text")), 256)).alias("digest")
    )
    to = lambda check, key: F.struct(check.alias("check"), key.cast("string").alias("key"))
    goes_to = F.concat(F.array(to(F.lit("id"), F.col("id")), to(F.lit("article"), F.col("article")), to(F.lit("all"), F.lit(""))), F.transform("failed", lambda x: to(x, F.col("id"))))
    whole, part = F.col("granularity") == "article", F.col("granularity") == "section"
    facts = records.select(
        F.explode(goes_to).alias("g"), F.col("split").alias("split"), F.when(whole, F.col("variant")).alias("whole"), F.when(part, F.col("variant")).alias("part"), F.col("digest").alias("text"),
        F.coalesce(whole, F.lit(False)).alias("is_whole"), F.coalesce(part, F.lit(False)).alias("is_part"),
    ).select("g.*", "split", "whole", "part", "text", "is_whole", "is_part")
    one = records.sparkSession.range(1).select(*[F.lit(x).cast(t).alias(n) for n, x, t in (("check", "all", "string"), ("key", "", "string"), ("split", None, "string"), ("whole", None, "string"), ("part", None, "string"), ("text", None, "string"), ("is_whole", False, "boolean"), ("is_part", False, "boolean"))])
    per = facts.unionByName(one).groupBy("check", "key").agg(
        F.count(F.lit(1)).alias("n"), (F.min("split") != F.max("split")).alias("splits"), F.count_if(F.col("whole") == "draft").alias("drafts"), F.count_if(F.col("whole") == "published").alias("publisheds"),
        (F.min("part") == F.max("part")).alias("one_part"), (F.min("text") == F.max("text")).alias("one_text"), F.count_if("is_whole").alias("wholes"), F.count_if("is_part").alias("parts"),
    )
    of_article = F.array(F.when(F.col("splits"), "split"), F.when(F.expr("drafts != 1 or publisheds != 1"), "variants"), F.when(F.col("one_part"), "sections of one variant"), F.when(F.expr("wholes = 2 and one_text"), "identical texts"))
    names = (
        F.when(F.col("check") == "id", F.array(F.when(F.col("n") > 1, "duplicate id"))).when(F.col("check") == "all", F.array(F.when(F.col("parts") == 0, "no sections"))).when(F.col("check") == "article", of_article)
        .otherwise(F.array_repeat(F.col("check"), F.col("n").cast("int")))
    )
    found = per.select("key", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("check"))
    return found.select("check", F.when(F.col("check") == "no sections", F.lit("0")).otherwise(F.col("key")).alias("key"))


def report_counts(records: DataFrame) -> DataFrame:
    """granularity, label, split, records with totals over splits, labels and all (null)."""
    return records.rollup("granularity", "label", "split").agg(F.count(F.lit(1)).alias("records"))


def majority_baseline(records: DataFrame, by: str = "granularity") -> DataFrame:
    """``by``, accuracy of always guessing the commoner label, weight of one record."""
    counts = records.groupBy(by, "label").count()
    return counts.groupBy(by).agg((F.max("count") / F.sum("count")).alias("accuracy"), (1 / F.sum("count")).alias("weight"))


def feature_means(features: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    return features.groupBy(*by).agg(*[F.avg(f).alias(f) for f in FEATURES])


def split_overlap(articles: DataFrame, key: str = "article") -> DataFrame:
    """Keys in more than one split."""
    train, test = articles.where("split = 'train'").select(key), articles.where("split = 'test'").select(key)
    return train.intersect(test)


def source_violations(given: DataFrame, table: DataFrame) -> DataFrame:
    """check, key of every way in which the sources ``given`` (article, split, commit, source_path) aren't those of ``table``; none if they are."""
    names = ("split", "commit", "source_path")
    repeats = given.groupBy("article").count().where("count > 1")
    want = table.select(F.col("article").alias("of"), *[F.col(n).alias(f"_{n}") for n in names])
    met = given.select("article", *names).distinct().join(want, F.col("article") == F.col("of"), "left")
    named = lambda df, check: df.select(F.lit(check).alias("check"), F.col("article").alias("key"))
    same = F.col("commit").eqNullSafe(F.col("_commit")) & F.col("source_path").eqNullSafe(F.col("_source_path"))
    return (
        named(repeats, "repeated article").unionByName(named(met.where("of is null"), "unknown article"))
        .unionByName(named(table.join(given.select("article").distinct(), "article", "left_anti"), "missing article"))
        .unionByName(named(met.where("of is not null and not (split <=> _split)"), "split unlike the table"))
        .unionByName(named(met.where(F.col("of").isNotNull() & ~same), "version unlike the table"))
    )


def write_dataset(records: DataFrame, path: str, info: dict[str, str] | None = None) -> None:
    """The records as JSON lines below ``path``/records, in order of article, variant, granularity and section, and what is told of them in ``path``/info.

    Nulls are written, texts as they are; Spark writes as many files as there are ranges, so no size is too large.
    """
    order = ("article", "variant", "granularity", "section_index", "id")
    names = [x.split()[0] for x in RECORD.split(", ")]
    records.select(*names).orderBy(*order).write.option("ignoreNullFields", False).json(f"{path}/records")
    told = {"records": str(records.count()), **(info or {})}
    records.sparkSession.createDataFrame([tuple(told.values())], ", ".join(f"`{k}` string" for k in told)).coalesce(1).write.json(f"{path}/info")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The records of :func:`write_dataset`."""
    return spark.read.schema(RECORD).json(f"{path}/records")


def _table(head: tuple[str, ...], rows: list[tuple]) -> list[str]:
    return ["", *["| " + " | ".join(map(str, r)) + " |" for r in [head, ("---",) * len(head), *rows]]]


def markdown_report(records: DataFrame, excluded: DataFrame | None = None, generated_at: str = "", warning: float = WARNING_ACCURACY) -> str:
    """A Markdown report: counts, left-out sections (see :func:`exclusions`), baselines, feature means, best thresholds and warnings. Only aggregates reach the driver."""
    lines = ["# データセット", *(["", f"生成日時: {generated_at}"] if generated_at else []), "", "## 件数"]
    counts = sorted(report_counts(records).collect(), key=lambda r: tuple(x or "~" for x in r[:3]))
    lines += _table(("粒度", "ラベル", "分割", "件数"), [(r[0] or "計", r[1] or "計", r[2] or "計", r[3]) for r in counts])
    if excluded is not None:
        e = excluded.first()
        lines += ["", "## 除外した節", *_table(("理由", "下書き", "公開", "計"), [
            (f"{LEAST_CHARS} 文字未満", e.short_draft, e.short_published, e.short_draft + e.short_published),
            (f"類似度 {UNCHANGED:.2f} 以上", e.unchanged_draft, e.unchanged_published, e.unchanged_draft + e.unchanged_published),
        ])]
    features = surface_features(records, ("granularity", "label"))
    base = {r[0]: r for r in majority_baseline(records).collect()}
    sums = {(r.granularity, r.label): r for r in feature_means(features, ("granularity", "label")).collect()}
    best = {(r.granularity, name): r for name in FEATURES for r in best_threshold(features, name, by=("granularity",)).collect()}
    warned = []
    for kind in sorted(base):
        lines += ["", f"## {kind}", "", f"多数派の正解率 {base[kind].accuracy:.3f}、1 件の重み {base[kind].weight:.3f}"]
        rows = []
        for name in FEATURES:
            ai, human, cut = sums.get((kind, "ai")), sums.get((kind, "human")), best.get((kind, name))
            if ai is None or human is None:
                rows.append((name, "-", "-", "-", "-"))
                continue
            rows.append((name, f"{ai[name]:.3f}", f"{human[name]:.3f}", f"{cut.accuracy:.3f}", f"{cut.ai_when} {cut.threshold:.4g}"))
            if cut.accuracy >= warning:
                warned.append(f"- {kind} の {name} だけで正解率 {cut.accuracy:.3f} に届きます。この特徴は評価の妨げになります。")
        lines += _table(("特徴", "ai 平均", "human 平均", "最良の正解率", "ai とする条件"), rows)
    return "\n".join([*lines, "", "## 警告", "", *(warned or ["ありません。"])]) + "\n"
