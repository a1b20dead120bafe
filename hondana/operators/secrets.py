"""Secret rules: one literal pattern each, matched on raw lines, code included.

The reference catalogue names the classes only; patterns and messages are our own. Matched text is cut to
four characters, so that reports do not repeat what they warn of.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hondana.functions.matching import Probe, pattern
from hondana.schema import Family, line_issues

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Secret:
    """``body`` is free of look-around; ``before`` and ``after`` are what may not stand next to a match; a line without any of ``needles`` has none."""

    key: str
    name: str
    body: str
    before: str = ""
    after: str = ""
    needles: tuple[str, ...] = ()

    @property
    def rx(self) -> str:
        return pattern((f"(?<!{self.before})" if self.before else "") + self.body + (f"(?!{self.after})" if self.after else ""))


SECRETS = (
    Secret("secret_aws_access_key", "AWS アクセスキー ID", "AKIA[0-9A-Z]{16}", "[A-Za-z0-9]", "[A-Za-z0-9]", needles=("akia",)),
    Secret("secret_aws_secret_key", "AWS シークレットアクセスキー", "(?i:aws_?secret_?(?:access_?)?key)[\"']?[ \\t]*[=:][ \\t]*[\"']?[A-Za-z0-9/+=]{40}", "", "[A-Za-z0-9/+=]", needles=("aws",)),
    Secret("secret_aws_session", "AWS セッショントークン", "(?i:aws_?session_?token)[\"']?[ \\t]*[=:][ \\t]*[\"']?[A-Za-z0-9/+=]{20,}", needles=("aws",)),
    Secret("secret_aws_account", "AWS アカウント ID", "[0-9]{12}", "[0-9]", "[0-9]"),
    Secret("secret_generic_token", "API キー・トークン", "(?i:api[_-]?key|token|secret)[\"']?[ \\t]*[=:][ \\t]*[\"']?[^ \\t\\r\"']{8,}", "[A-Za-z0-9_]", needles=("key", "token", "secret")),
    Secret("secret_github", "GitHub トークン", "gh[posr]_[A-Za-z0-9]{36,}", "[A-Za-z0-9]", needles=("gh",)),
    Secret("secret_slack", "Slack トークン", "xox[bps]-[A-Za-z0-9-]{10,}", "[A-Za-z0-9]", needles=("xox",)),
    Secret("secret_private_key", "秘密鍵", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needles=("private key",)),
    Secret("secret_password", "パスワード", "(?i:password|passwd)[\"']?[ \\t]*[=:][ \\t]*[\"']?[^ \\t\\r\"']{4,}", "[A-Za-z0-9_]", needles=("passw",)),
    Secret("secret_ipv4", "IP アドレス", f"(?:{_OCTET}\\.){{3}}{_OCTET}", "[0-9.]", "[0-9]", needles=(".",)),
    Secret("secret_connection_string", "データベース接続文字列", "[A-Za-z][A-Za-z0-9+]{1,20}://[^ \\t\\r:/@]+:[^ \\t\\r/@]+@[^ \\t\\r/]+", "[A-Za-z0-9+]", needles=("://",)),
)
SUGGESTION = "削除するか伏せ字にしてください"


def family(rules: tuple[Secret, ...] = SECRETS) -> Family:
    """The rules as probes of raw lines, code included."""

    def made(k: Column) -> dict[str, Column]:
        name = F.element_at(F.array(*[F.lit(r.name) for r in rules]), k + 1)
        cut = F.concat(F.substring("matched", 1, 4), F.lit("****"))
        return {"rule": name, "message": F.concat(name, F.lit("と思われる文字列が含まれています。")), "suggestion": F.lit(SUGGESTION), "matched": cut, "seq": k * 1_000_000 + F.col("n")}

    return Family("secrets", "secret", tuple(Probe(r.rx, r.needles) for r in rules), made)


def check_secrets(lines: DataFrame, rules: tuple[Secret, ...] = SECRETS) -> DataFrame:
    """Issues of category secret in ``lines`` (doc_id, n, line): one pass for all rules."""
    return line_issues(lines, [family(rules)])
