"""Issues that are new or gone with each version of a document, as a stream.

State is kept by document: the digests of the last version's issues. A new version gives a row for each issue that it adds (``new``) and for each it no longer
has (``gone``), so an unchanged issue is told once however often its document is edited, and also after a restart from the checkpoint. An issue is the same in two versions if rule and
line are, the first such with the first, the second with the second; lines above it may come and go. A document that no version of arrives for ``idle`` has its issues told as gone
and its state dropped.

Issues are found within the row (an array), before the shuffle by document, so only digests and short rows move and a document's versions of one micro-batch come in the order of ``version``.

Edge cases: null and empty texts have no issues, which makes the earlier ones gone; versions older than the last one seen are ignored; a null doc_id is a document of its own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hondana.functions.matching import find_all
from hondana.operators.secrets import SECRETS, Secret

CHANGES = "doc_id long, version long, change string, rule string, line_number int, line string"
_STATE = "version long, digests array<string>, rules array<string>, lines array<string>"


def secrets_of(text: Column, rules: tuple[Secret, ...] = SECRETS) -> Column:
    """array<struct<rule,n,line>>: the secret issues of a text, in place; a line is told by its digest, so that no secret stays in the state."""

    def of_line(line: Column, n: Column) -> Column:
        told = lambda r: F.struct(F.lit(r.name).alias("rule"), (n + 1).alias("n"), F.sha2(line, 256).alias("line"))
        return F.concat(*[F.array_repeat(told(r), F.size(find_all(line, r.rx))) for r in rules])

    return F.coalesce(F.flatten(F.transform(F.split(text, "\n", -1), of_line)), F.array().cast("array<struct<rule:string,n:int,line:string>>"))


def _numbered(issues: list[tuple[str, int, str]]) -> dict[str, tuple[str, int, str]]:
    """Issues by a digest of rule, line and how many alike stand before."""
    seen: Counter = Counter()
    out = {}
    for rule, n, line in issues:
        out[hashlib.sha256(f"{rule}\0{line}\0{seen[rule, line]}".encode("utf-8", "surrogatepass")).hexdigest()] = (rule, n, line)
        seen[rule, line] += 1
    return out


def changes(docs: DataFrame, issues: Column | None = None, idle: str | None = None) -> DataFrame:
    """A stream of :data:`CHANGES` from a stream of ``docs`` (doc_id, version, text); ``issues``: array of (rule, n, line), those for secrets unless given.

    ``idle`` is a time such as ``30 days``; without it documents are kept for ever.
    """
    found = secrets_of(F.col("text")) if issues is None else issues
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("long").alias("version"), found.alias("issues"))
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        doc_id = key[0]
        last, known = (None, {}) if not state.exists else (lambda s: (s[0], {d: (r, 0, x) for d, r, x in zip(s[1], s[2], s[3])}))(state.get)
        out: list[tuple] = []
        if state.hasTimedOut:
            out = [(doc_id, last, "gone", r, None, x) for r, _, x in known.values()]
            state.remove()
        else:
            versions = sorted(((int(v), [(i["rule"], int(i["n"]), i["line"]) for i in some]) for frame in frames for v, some in zip(frame["version"], frame["issues"])), key=lambda x: x[0])
            for version, some in versions:
                if last is not None and version <= last:
                    continue
                mine = _numbered(some)
                out += [(doc_id, version, "gone", r, None, x) for d, (r, _, x) in known.items() if d not in mine]
                out += [(doc_id, version, "new", r, n, x) for d, (r, n, x) in mine.items() if d not in known]
                last, known = version, mine
            state.update((last, list(known), [r for r, _, _ in known.values()], [x for _, _, x in known.values()]))
            if wait is not None:
                state.setTimeoutDuration(wait)
        frame = pd.DataFrame(out, columns=["doc_id", "version", "change", "rule", "line_number", "line"])
        yield frame.astype({"doc_id": "Int64", "version": "Int64", "line_number": "Int32"})

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("doc_id").applyInPandasWithState(step, CHANGES, _STATE, "append", timeout)
