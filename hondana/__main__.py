"""Command line: ``python -m hondana check PATH [--profile P] [--vault-root DIR]`` and ``gate PATH --tags a,b [--title T] [--public]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hondana.plans import lint
from hondana.sources import documents


def _numbered(files):
    return files.withColumn("doc_id", F.xxhash64("path")).withColumn("file", F.col("path"))


def check(spark: SparkSession, path: str, profile: str, vault_root: str | None) -> int:
    """Print issues by file and category; 0 if there are none."""
    if profile == "vault":
        root = vault_root or path
        docs, words = _numbered(documents.read_vault(spark, root)), documents.read_vocabulary(spark, root)
        issues = lint.lint(docs, profile, vocabulary=words)
    else:
        docs = _numbered(documents.read_files(spark, path))
        issues = lint.lint(docs, profile)
    issues = issues.persist()
    names = docs.select("doc_id", "path")
    last = None
    for r in lint.report_rows(issues).join(names, "doc_id").orderBy("path", "place").toLocalIterator():
        if (r.path, r.category) != last:
            print(f"\n{r.path}  {lint.CATEGORY_LABELS[r.category]}")
            last = (r.path, r.category)
        print(f"  {r.text}")
    total = issues.count()
    issues.unpersist()
    lint.release()
    print(f"\n合計: {total} 件")
    return 1 if total else 0


def gate(spark: SparkSession, path: str, title: str | None, tags: str, public: bool) -> int:
    """Print the decision for every document; 0 if all are ready."""
    rows = lint.publish_gate(_numbered(documents.read_files(spark, path)), F.lit(tags), F.lit(title) if title else None, F.lit(public))
    ready = True
    for r in rows.toLocalIterator():
        print(f"{r.decision}: {r.title} tags={r.tags} private={r.private} warnings={r.warnings}")
        ready = ready and r.decision == "ready"
    return 0 if ready else 1


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hondana")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("check")
    c.add_argument("path")
    c.add_argument("--profile", choices=sorted(lint.PROFILES), default="blog")
    c.add_argument("--vault-root")
    g = commands.add_parser("gate")
    g.add_argument("path")
    g.add_argument("--title")
    g.add_argument("--tags", default="")
    g.add_argument("--public", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("hondana").getOrCreate()
    if given.command == "check":
        return check(spark, given.path, given.profile, given.vault_root)
    return gate(spark, given.path, given.title, given.tags, given.public)


if __name__ == "__main__":
    sys.exit(main())
