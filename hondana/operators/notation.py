"""Notation rules: terms that should be written one way.

The publishing profile ("qiita") matches raw lines and skips code by counting back-ticks; the blog profile
matches lines whose non-prose is masked, without rules on long vowels and cloud names, and adds review rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hondana.functions.dictionary import term_matches
from hondana.functions.matching import Probe, bound, char_at, folded, folded_text, needle, pattern, rule_matches, running_sums
from hondana.schema import Family, issue, line_issues


@dataclass(frozen=True)
class Variant:
    """``body`` is a literal; ``before``/``after``: what may not stand beside it, ``later``: what may not follow anywhere in the line."""

    body: str
    before: str = ""
    after: str = ""
    later: str = ""

    @property
    def rx(self) -> str:
        # What may not stand before is asked for once the body is found, not at every character.
        behind = f"(?<!{self.before}{self.body})" if self.before else ""
        ahead = "|".join(x for x in (self.after, f".*{self.later}" if self.later else "") if x)
        return self.body + behind + (f"(?!{ahead})" if ahead else "")


@dataclass(frozen=True)
class Rule:
    preferred: str
    variants: tuple[Variant, ...]
    note: str = ""
    case_sensitive: bool = False
    context: tuple[str, ...] = ()
    name: str = ""
    review: bool = False
    no_kanji_beside: bool = False
    blog: bool = True

    @property
    def rule_name(self) -> str:
        return self.name or f"表記ブレ: {self.preferred}"


_LONG = "長音記号をつけるのが一般的です"
_FULL = "AWSサービス名はフル表記を推奨"


def _long(preferred: str) -> Rule:
    return Rule(preferred, (Variant(preferred[:-1], after="ー"),), _LONG, blog=False)


def _cloud(preferred: str) -> Rule:
    return Rule(preferred, (Variant(preferred.split()[1].lower(), "[A-Za-z]", "[A-Za-z]"),), _FULL, blog=False)


def _spelt(preferred: str, *variants: str, after: str = "[A-Za-z]", case_sensitive: bool = False) -> Rule:
    return Rule(preferred, tuple(Variant(v, "[A-Za-z]", after) for v in variants), f"正式表記は {preferred} です", case_sensitive)


def _term(preferred: str, *variants: str) -> Rule:
    return Rule(preferred, tuple(map(Variant, variants)), f"「{preferred}」が一般的です")


#: The terms, their accepted forms and notes.
RULES = (
    *map(_long, ("サーバー", "ユーザー", "コンピューター", "プロバイダー", "パラメーター", "コンテナー", "レジスター", "ブラウザー", "マネージャー", "ドライバー")),
    Rule(
        "AWS Lambda", (Variant("lambda", "\\w", "\\w|[(:.]"), Variant("Lambda", "\\w", "\\w|[(:.]", "関数")), _FULL,
        context=("aws", "関数", "function", "serverless", "サーバーレス"), blog=False,
    ),
    *map(_cloud, ("Amazon EC2", "Amazon S3", "Amazon RDS", "Amazon DynamoDB", "Amazon CloudWatch", "AWS CloudFormation", "AWS IAM", "Amazon VPC", "Amazon ECS", "Amazon EKS")),
    Rule("GitHub", (Variant("Github", "[A-Za-z]", "[A-Za-z]"), Variant("github", "[A-Za-z]", "[A-Za-z.]")), "正式表記は GitHub です"),
    _spelt("JavaScript", "Javascript", "javascript"),
    _spelt("TypeScript", "Typescript", "typescript"),
    _spelt("Node.js", "NodeJS", "Nodejs", "nodejs"),
    _spelt("Docker", "docker", after="[A-Za-z./-]", case_sensitive=True),
    _spelt("Kubernetes", "kubernetes", case_sensitive=True),
    _spelt("Terraform", "terraform", case_sensitive=True),
    _term("ウェブ", "ウエブ"),
    _term("ファイアウォール", "ファイヤーウォール", "ファイアーウォール", "ファイヤウォール"),
    _term("インターフェース", "インターフェイス", "インタフェース", "インタフェイス"),
    _term("メソッド", "メッソド"),
    _term("デプロイ", "ディプロイ"),
)
BRAND = Rule("Eufy", (Variant("eufy", "[A-Za-z0-9]", "[A-Za-z0-9]"),), case_sensitive=True, name="brand-capitalization", review=True)
CHICKEN = Rule("ニワトリ", (Variant("にわとり"), Variant("鶏")), name="chicken-notation", review=True, no_kanji_beside=True)
#: Terms whose translation is not the official one -> official term. Ships empty; callers fill it or pass their own.
UNOFFICIAL_TRANSLATIONS: dict[str, str] = {}

# What counts as Japanese, terms beside slashes, and where letters meet Japanese.
JAPANESE = "ぁ-んァ-ヶ一-鿿々〆ヶー"
KANJI = "[一-鿿々〆ヶ]"
_SLASH_TERM = f"[A-Za-z0-9{JAPANESE}+#-]+?"
SLASH = f"(?<![A-Za-z0-9{JAPANESE}/]){_SLASH_TERM}(?:/{_SLASH_TERM})+(?=\\s|[。、！？）」』】]|$|を|に|へ|が|は|と|で|の|も|から|まで)"
BOUNDARY = f"(?<=[A-Za-z0-9])(?=[{JAPANESE}])|(?<=[{JAPANESE}])(?=[A-Za-z0-9])"


#: Matches where :data:`BOUNDARY` does, and looks around at no place.
MEETING = f"[A-Za-z0-9][{JAPANESE}]|[{JAPANESE}][A-Za-z0-9]"


def translation_rules(dictionary: dict[str, str] | None = None) -> tuple[Rule, ...]:
    """Review rules of a dictionary, read when called: what :func:`check_translations` finds, told one by one."""
    given = UNOFFICIAL_TRANSLATIONS if dictionary is None else dictionary
    return tuple(Rule(to, (Variant(re.escape(term)),), name="unofficial-translation", review=True, no_kanji_beside=True) for term, to in given.items())


def rules_of(profile: str) -> tuple[Rule, ...]:
    """The fixed rules of a profile; the dictionary of translations is no set of rules but a table, see :func:`check_translations`."""
    return (*[r for r in RULES if r.blog], BRAND, CHICKEN) if profile == "blog" else RULES


def review_message(rule: Rule, matched: Column) -> Column:
    quoted = F.concat(F.lit("「"), matched, F.lit("」"))
    if rule.name == "brand-capitalization":
        return F.concat(quoted, F.lit(f"は製品名なら「{rule.preferred}」、ライブラリ名・アカウント名・URLならそのままです。文脈に合う表記か確認してください。"))
    if rule.name == "chicken-notation":
        return F.concat(quoted, F.lit("をひらがな・漢字・カタカナのどれで書くかは文脈で決まります。表記を確認してください。"))
    return F.concat(quoted, F.lit(f"が「{rule.preferred}」を指すかは文脈で決まります。意図した用語か確認してください。"))


def with_fence_parity(lines: DataFrame) -> DataFrame:
    """Adds ``in_fence``: an odd number of lines before this one open with three back-ticks."""
    fence = F.regexp_replace("line", "(?U)^\\s+", "").startswith("```").cast("int")
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("in_fence", F.coalesce(F.sum(fence).over(before), F.lit(0)) % 2 == 1)


def with_context(lines: DataFrame) -> DataFrame:
    """Adds ``around``: the line with two before and two after, lower-cased."""
    near = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-2, 2)
    return lines.withColumn("around", F.lower(F.array_join(F.collect_list("line").over(near), "\n")))


def lines_with_context(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The lines of whole texts (``keep``, n, line) with in_fence and around, made within each row, so that no line moves.

    ``around`` is null on lines that hold no term of a rule with a context.
    """
    terms = sorted({folded_text(v.body) for r in rules if r.context for v in r.variants})

    def placed(parts: Column) -> Column:
        fences = F.transform(parts, lambda x: F.regexp_replace(x, "(?U)^\\s+", "").startswith("```").cast("int"))

        def row(x: Column, k: Column, before: Column) -> Column:
            first = F.greatest(k - 1, F.lit(1))
            near = F.lower(F.array_join(F.slice(parts, first, k + 4 - first), "\n"))
            held = bound(folded(x), lambda y: reduce(or_, [F.contains(y, F.lit(term)) for term in terms], F.lit(False)))
            return F.struct((k + 1).alias("n"), x.alias("line"), (before[k] % 2 == 1).alias("in_fence"), F.when(held, near).alias("around"))

        return bound(running_sums(fences), lambda before: F.transform(parts, lambda x, k: row(x, k, before)))

    at = F.explode(bound(F.split("text", "\n", -1), placed)).alias("at")
    return docs.where("text is not null").select(*keep, at).select(*keep, "at.*")


def in_inline_code(line: Column, col: Column) -> Column:
    """An odd number of back-ticks before the column."""
    before = F.substr(line, F.lit(1), col - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("`"), F.lit("")))) % 2 == 1


def kanji_beside(line: Column, col: Column, matched: Column) -> Column:
    return char_at(line, col - 1).rlike(KANJI) | char_at(line, col + F.length(matched)).rlike(KANJI)


def _probes(rules: tuple[Rule, ...], on: str, within: str | None = None) -> tuple[Probe, ...]:
    """Every variant of ``rules`` in their order."""
    return tuple(Probe(pattern(v.rx, not rule.case_sensitive), needle(v.body), on, within) for rule in rules for v in rule.variants)


def _rule(rules: tuple[Rule, ...], variant: Column) -> Column:
    """The number of the rule that a variant is of."""
    return F.element_at(F.array(*[F.lit(r) for r, rule in enumerate(rules) for _ in rule.variants]), variant + 1)


def _hits(lines: DataFrame, rules: tuple[Rule, ...], on: str) -> DataFrame:
    """Every match of every variant, with rule and variant numbers."""
    return rule_matches(lines, list(_probes(rules, on))).withColumn("rule", _rule(rules, F.col("variant")))


def _of(rules: tuple[Rule, ...], value) -> Column:
    return F.element_at(F.array(*[F.lit(value(r)) for r in rules]), F.col("rule") + 1)


def legacy_family(rules: tuple[Rule, ...] = RULES) -> Family:
    """The publishing profile's rules in lines with ``in_fence`` and, for rules with a context, ``around``."""

    def made(k: Column) -> dict[str, Column]:
        rule = _rule(rules, k)
        kept = ~in_inline_code(F.col("line"), F.col("col"))
        for r in (r for r, given in enumerate(rules) if given.context):
            kept = kept & ((rule != r) | reduce(or_, [F.contains(F.col("around"), F.lit(word)) for word in rules[r].context]))
        return _made(rules, k, kept)

    return Family("notation", "notation", _probes(rules, "line", "_outside"), made)


def outside_fences(lines: DataFrame) -> DataFrame:
    """``lines`` (with in_fence) as the family of the publishing profile asks for them."""
    return lines.withColumn("_outside", ~F.col("in_fence"))


def check_notation_legacy(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Issues of the publishing profile. Every variant that matches gives an issue, so one place may give several."""
    known = lines if "in_fence" in lines.columns else with_fence_parity(lines)
    if any(r.context for r in rules) and "around" not in lines.columns:
        known = with_context(known)
    return line_issues(outside_fences(known), [legacy_family(rules)])


def _made(rules: tuple[Rule, ...], variant: Column, kept: Column) -> dict[str, Column]:
    rule = _rule(rules, variant)
    of = lambda value: F.element_at(F.array(*[F.lit(value(r)) for r in rules]), rule + 1)
    preferred = of(lambda r: r.preferred)
    message = F.concat(F.lit("「"), F.col("matched"), F.lit("」→「"), preferred, F.lit("」に統一を推奨。"), of(lambda r: r.note))
    for k, given in enumerate(rules):
        if given.review:
            message = F.when(rule == k, review_message(given, F.col("matched"))).otherwise(message)
    return {"rule": of(lambda r: r.rule_name), "message": message, "suggestion": preferred, "review": of(lambda r: r.review), "seq": variant * 1_000_000 + F.col("n"), "kept": kept & (F.col("matched") != preferred)}


def blog_family(rules: tuple[Rule, ...] | None = None) -> Family:
    """Terms of the blog profile in masked lines."""
    rules = rules_of("blog") if rules is None else rules

    def made(k: Column) -> dict[str, Column]:
        alone = F.element_at(F.array(*[F.lit(r.no_kanji_beside) for r in rules]), _rule(rules, k) + 1)
        return _made(rules, k, ~(alone & kanji_beside(F.col("line"), F.col("col"), F.col("matched"))))

    return Family("notation", "notation", _probes(rules, "masked"), made)


def check_notation_blog(lines: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Term issues of the blog profile in ``lines`` (doc_id, n, line, masked)."""
    return line_issues(lines, [blog_family(rules)])


def dictionary_table(spark: SparkSession, dictionary: dict[str, str] | None = None) -> DataFrame:
    """term, preferred, place of a dictionary, the shipped one unless given, read when called."""
    given = UNOFFICIAL_TRANSLATIONS if dictionary is None else dictionary
    return spark.createDataFrame([(term, to, k) for k, (term, to) in enumerate(given.items())], "term string, preferred string, place long")


def check_translations(lines: DataFrame, dictionary: DataFrame, first: int = 0) -> DataFrame:
    """Issues for review at every term of ``dictionary`` (term, preferred, place in its order) in ``lines`` (doc_id, n, line, masked).

    One automaton finds all terms, in any case, so a dictionary of any size is one pass; ``first`` is the place of its first term among all rules. A term is looked up once for its matches, by a join.
    Matches beside a kanji, and those that already read as preferred, are none.
    """
    extra = tuple(c for c in ("file",) if c in lines.columns)
    hits = term_matches(lines.select("doc_id", "n", "line", *extra, "masked"), dictionary, "masked")
    hits = hits.join(dictionary.select("term", "preferred", "place"), "term").where((F.col("matched") != F.col("preferred")) & ~kanji_beside(F.col("line"), F.col("col"), F.col("matched")))
    message = F.concat(F.lit("「"), F.col("matched"), F.lit("」が「"), F.col("preferred"), F.lit("」を指すかは文脈で決まります。意図した用語か確認してください。"))
    return issue(hits, "notation", "unofficial-translation", message, None, True, seq=(F.lit(first) + F.col("place")) * 1_000_000 + F.col("n"))


def slash_family() -> Family:
    """Slashes between terms in masked lines, for review."""

    def made(k: Column) -> dict[str, Column]:
        there = F.substr("line", "col", F.length("matched"))
        message = F.concat(F.lit("「"), there, F.lit("」のスラッシュが並列、固有表記、パスのどれに当たるかは文脈で決まります。表記を確認してください。"))
        return {"rule": F.lit("slash-coordination"), "message": message, "review": F.lit(True), "matched": there, "seq": F.lit(900_000_000_000) + F.col("n")}

    return Family("notation", "notation", (Probe(pattern(SLASH), ("/",), "masked"),), made)


def check_slash(lines: DataFrame) -> DataFrame:
    """Slashes between terms, for review."""
    return line_issues(lines, [slash_family()])


def spacing_family() -> Family:
    """Places where letters or digits meet Japanese in masked lines."""

    def made(k: Column) -> dict[str, Column]:
        a, b = F.substr("line", F.col("col") - 1, F.lit(1)), F.substr("line", "col", F.lit(1))
        spaced = F.concat(a, F.lit(" "), b)
        return {"rule": F.lit("alnum-japanese-spacing"), "message": F.lit("英数字と日本語の間に半角スペースを入れてください。"), "suggestion": spaced, "col": F.col("col") - 1, "matched": F.concat(a, b), "seq": F.lit(950_000_000_000) + F.col("n")}

    return Family("notation", "notation", (Probe(pattern(BOUNDARY), (), "masked", test=MEETING),), made)


def check_spacing(lines: DataFrame) -> DataFrame:
    """Places where letters or digits meet Japanese; the column is that of the character before the place."""
    return line_issues(lines, [spacing_family()])
