"""SQL of the views and of the scans that stand in for look-around, for comparison with the DataFrame forms.

The other engine's regular expressions know no look-around. So a scan tries a pattern at every place of a line
and tests the characters beside the match by themselves.
"""

from __future__ import annotations

from hondana.operators.notation import KANJI, RULES, Rule, Variant
from hondana.operators.secrets import SECRETS, SUGGESTION
from hondana.sources.article_view import NON_PROSE, POOL

WORD = "[\\p{L}\\p{M}\\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


POOL_ROWS = ", ".join(f"({k}, {q(p)})" for k, p in enumerate(POOL))
#: raw(doc_id, n, line) of documents; view(doc_id, n, pid, line): the article view; prose: without probes that aren't prose.
VIEW = f"""
pool(pid, p) AS (VALUES {POOL_ROWS}),
raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents),
view AS (
  SELECT doc_id, n, pool.pid,
         CASE WHEN n % 6 = 1 THEN '## ' || substr(line, 1, 20) WHEN pool.pid IN (20, 23) THEN p ELSE replace(line, '. ', 'です。') || p END AS line
  FROM raw JOIN pool ON pool.pid = (doc_id * 7 + n) % 24),
prose AS (SELECT * FROM view WHERE pid NOT IN {NON_PROSE})"""
#: secret_view: the article view whose first lines also carry what the pool lacks.
SECRET_VIEW = (
    VIEW
    + """,
secret_view AS (
  SELECT doc_id, n, CASE WHEN n = 1 THEN line || ' ' || CASE doc_id % 8
    WHEN 0 THEN 'AWS_SECRET_ACCESS_KEY=' || substr(md5(CAST(doc_id AS VARCHAR)) || md5('x' || doc_id), 1, 40)
    WHEN 1 THEN 'AWS_SESSION_TOKEN=' || md5(CAST(doc_id AS VARCHAR)) || md5('x' || doc_id)
    WHEN 2 THEN 'ghp_' || substr(md5(CAST(doc_id AS VARCHAR)) || md5('x' || doc_id), 1, 36)
    WHEN 3 THEN 'xoxb-' || md5(CAST(doc_id AS VARCHAR))
    WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY-----'
    WHEN 5 THEN 'ghp_' || md5(CAST(doc_id AS VARCHAR))
    WHEN 6 THEN '-----END RSA PRIVATE KEY----- AWS_SECRET_ACCESS_KEY=' || md5(CAST(doc_id AS VARCHAR))
    ELSE 'xoxo-' || md5(CAST(doc_id AS VARCHAR)) END ELSE line END AS line
  FROM view)"""
)


def scan(source: str, body: str, before: str = "", after: str = "", keep: str = "doc_id, n, line", on: str = "line") -> str:
    """keep, col, matched of every place of ``on`` where ``body`` matches with nothing forbidden beside it."""
    tests = [f"regexp_matches({on}, {q(body)})", f"regexp_matches(substr({on}, pos), {q(f'^(?:{body})')})"]
    if before:
        tests.append(f"NOT (pos > 1 AND regexp_matches(substr({on}, pos - 1, 1), {q(before)}))")
    inner = f"SELECT {keep}, {on} AS _on, CAST(pos AS INTEGER) AS col, regexp_extract(substr({on}, pos), {q(f'^(?:{body})')}) AS matched FROM (SELECT *, unnest(range(1, length({on}) + 1)) AS pos FROM {source} WHERE {tests[0]}) WHERE {' AND '.join(tests[1:])}"
    if after:
        return f"SELECT {keep}, col, matched FROM ({inner}) WHERE NOT regexp_matches(substr(_on, col + length(matched)), {q(f'^(?:{after})')})"
    return f"SELECT {keep}, col, matched FROM ({inner})"


def issue_columns(category: str, rule: str, message: str, suggestion: str, review: str = "false", seq: str = "0") -> str:
    return (
        f"doc_id, '' AS file, CAST(n AS INTEGER) AS line_number, CAST(col AS INTEGER) AS \"column\", matched AS matched_text, {q(category)} AS category, {rule} AS rule_name, "
        f"{message} AS message, CASE WHEN {review} THEN NULL ELSE {suggestion} END AS suggestion, {review} AS needs_review, CAST({seq} AS BIGINT) AS seq"
    )


def secret_hits(source: str = "secret_view", rules=SECRETS) -> str:
    parts = []
    for k, r in enumerate(rules):
        body = r.body
        parts.append(f"SELECT doc_id, n, {k} AS rule, {q(r.name)} AS name, col, substr(matched, 1, 4) || '****' AS matched FROM ({scan(source, body, r.before, r.after)})")
    return "\nUNION ALL\n".join(parts)


def secret_issues(source: str = "secret_view", rules=SECRETS) -> str:
    columns = issue_columns("secret", "name", "name || 'と思われる文字列が含まれています。'", q(SUGGESTION), seq="rule * 1000000 + n")
    return f"SELECT {columns} FROM ({secret_hits(source, rules)})"


def _class(text: str) -> str:
    return text.replace("\\w", WORD)


def variant_scan(source: str, variant: Variant, ignore_case: bool, keep: str = "doc_id, n, line", on: str = "line") -> str:
    body = ("(?i)" if ignore_case else "") + variant.body
    after = "|".join(x for x in (_class(variant.after), f".*{variant.later}" if variant.later else "") if x)
    if ignore_case and after:
        after = "(?i)" + after
    return scan(source, f"(?i:{variant.body})" if ignore_case else body, (("(?i)" if ignore_case else "") + _class(variant.before)) if variant.before else "", after, keep, on)


def rule_hits(source: str, rules: tuple[Rule, ...], keep: str = "doc_id, n, line", on: str = "line") -> str:
    """Matches of all variants with what the rule says."""
    parts, k = [], 0
    for r, rule in enumerate(rules):
        for variant in rule.variants:
            parts.append(
                f"SELECT *, {r} AS rule, {k} AS variant, {q(rule.preferred)} AS preferred, {q(rule.rule_name)} AS rule_name, {q(rule.note)} AS note, {str(rule.review).lower()} AS review, "
                f"{str(rule.no_kanji_beside).lower()} AS no_kanji FROM ({variant_scan(source, variant, not rule.case_sensitive, keep, on)})"
            )
            k += 1
    return "\nUNION ALL\n".join(parts)


FENCES = """
fences AS (
  SELECT *, coalesce(sum(CASE WHEN starts_with(regexp_replace(line, '^\\s+', ''), '```') THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence,
         lower(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS around
  FROM {source}), open_lines AS (SELECT * FROM fences WHERE NOT in_fence)"""
IN_CODE = "(length(substr(line, 1, col - 1)) - length(replace(substr(line, 1, col - 1), '`', ''))) % 2 = 1"


def legacy_hits(rules: tuple[Rule, ...] = RULES) -> str:
    """Over open_lines of FENCES."""
    context = " AND ".join(f"(rule != {k} OR " + " OR ".join(f"contains(around, {q(w)})" for w in r.context) + ")" for k, r in enumerate(rules) if r.context)
    return f"SELECT * FROM ({rule_hits('open_lines', rules, 'doc_id, n, line, around')}) WHERE NOT ({IN_CODE}) AND matched != preferred" + (f" AND {context}" if context else "")


def legacy_issues(rules: tuple[Rule, ...] = RULES) -> str:
    columns = issue_columns("notation", "rule_name", "'「' || matched || '」→「' || preferred || '」に統一を推奨。' || note", "preferred", "review", "variant * 1000000 + n")
    return f"SELECT {columns} FROM ({legacy_hits(rules)})"


KANJI_BESIDE = f"(regexp_matches(CASE WHEN col > 1 THEN substr(line, col - 1, 1) ELSE '' END, '{KANJI}') OR regexp_matches(substr(line, col + length(matched), 1), '{KANJI}'))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes)


#: issues: what the publishing profile finds in secret_view, with the order of checks in seq.
PUBLISHED = with_(
    SECRET_VIEW, FENCES.format(source="secret_view"),
    f"""
issues AS (
  SELECT * FROM ({secret_issues()})
  UNION ALL SELECT * REPLACE (seq + 1000000000000 AS seq) FROM ({legacy_issues()})
  UNION ALL SELECT doc_id, '', 0, 0, '', 'ai_writing', 'チェックをスキップ', '外部リンターが見つからないため AI 文体チェックをスキップしました', '', false, 2000000000000
    FROM documents WHERE text IS NOT NULL)""",
)
