"""Versions of files as rows: a Python data source that reads ``commit:path`` blobs of a repository on the executors.

    spark.dataSource.register(VersionedBlobs)
    spark.read.format("versioned_blobs").option("repository", repo).option("blobs", json).load().where("path like 'docs/%'")

``blobs`` is a JSON list of [commit, path]. Filters on commit and path leave blobs out before any is read (with ``spark.sql.python.filterPushdown.enabled``); the rest goes to partitions of
``per_partition`` (500), each of which asks one ``git cat-file --batch`` for all its blobs. As a stream (``branch``, ``suffix``), every commit that the branch gains gives the files it adds or
changes; a file that a commit deletes has a row with a null text. The executors must see the repository. An unknown blob, or one that isn't UTF-8, is a ValueError; no blobs give no rows.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

PER_PARTITION = 500
TIMEOUT = 60


def read_git(repository: str, blobs: Iterable[tuple[str, str]]) -> Iterator[str]:
    """The texts of some blobs in their order, by one process."""
    with subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as git:
        for commit, path in blobs:
            name = f"{commit}:{path}"
            if "\n" in name:
                raise ValueError(f"cannot read {name!r}")
            git.stdin.write(name.encode("utf-8", "surrogateescape") + b"\n")
            git.stdin.flush()
            head = git.stdout.readline().rsplit(None, 2)
            if len(head) != 3 or head[1] != b"blob":
                git.kill()
                raise ValueError(f"cannot read {name}")
            size = int(head[2])
            body = git.stdout.read(size + 1)[:size]
            try:
                yield body.decode("utf-8")
            except UnicodeDecodeError as error:
                git.kill()
                raise ValueError(f"{name} isn't UTF-8") from error
        git.stdin.close()


def _git(repository: str, *command: str) -> list[str]:
    got = subprocess.run(["git", "-C", repository, *command], capture_output=True, timeout=TIMEOUT)
    if got.returncode:
        raise ValueError(f"git {command[0]} fails in {repository}")
    return [x for x in got.stdout.decode("utf-8", "surrogateescape").split("\0" if "-z" in command else "\n") if x]


class VersionedBlobs(DataSource):
    """commit, path, text of every blob asked for."""

    #: For tests: reads one blob (repository, commit, path) instead of git.
    reader_function: Callable[[str, str, str], str] | None = None

    @classmethod
    def name(cls) -> str:
        return "versioned_blobs"

    def schema(self) -> str:
        return "commit string, path string, text string"

    def reader(self, schema) -> BlobReader:
        return BlobReader(self.options, type(self).reader_function)

    def streamReader(self, schema) -> CommitReader:  # noqa: N802
        return CommitReader(self.options)


class Blobs(InputPartition):
    """The blobs of a partition, as ``value``."""


_TESTS: dict[type, Callable[[str, object], bool]] = {
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda x, v: v in x,
}


class BlobReader(DataSourceReader):
    def __init__(self, options: dict[str, str], read_one: Callable | None):
        self.repository, self.read_one = options.get("repository", "."), read_one
        self.blobs = [tuple(b) for b in json.loads(options.get("blobs", "[]"))]
        self.size = int(options.get("per_partition", PER_PARTITION))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what tests commit or path alone; the rest is Spark's."""
        for f in filters:
            test, place = _TESTS.get(type(f)), {("commit",): 0, ("path",): 1}.get(getattr(f, "attribute", None))
            if test is None or place is None:
                yield f
            else:
                self.blobs = [b for b in self.blobs if test(b[place], f.value)]

    def partitions(self) -> list[InputPartition]:
        return [Blobs(self.blobs[k : k + self.size]) for k in range(0, len(self.blobs), self.size)]

    def read(self, partition: Blobs) -> Iterator[tuple[str, str, str]]:
        blobs = partition.value
        texts = (self.read_one(self.repository, *b) for b in blobs) if self.read_one else read_git(self.repository, blobs)
        for (commit, path), text in zip(blobs, texts):
            yield commit, path, text


class CommitReader(DataSourceStreamReader):
    """Commits of a branch in order, the oldest first; an offset is how many there are up to it, and the last one's name."""

    def __init__(self, options: dict[str, str]):
        self.repository, self.branch, self.suffix = options.get("repository", "."), options.get("branch", "HEAD"), options.get("suffix", "")
        self.size = int(options.get("per_partition", PER_PARTITION))

    def _commits(self) -> list[str]:
        return _git(self.repository, "rev-list", "--reverse", "--first-parent", self.branch)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commits": 0, "last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        commits = self._commits()
        return {"commits": len(commits), "last": commits[-1] if commits else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        commits = self._commits()
        if start["commits"] and (start["commits"] > len(commits) or commits[start["commits"] - 1] != start["last"]):
            raise ValueError(f"{self.branch} has been rewritten: {start['last']} is no longer its commit {start['commits']}")
        blobs = []
        for commit in commits[start["commits"] : end["commits"]]:
            told = _git(self.repository, "diff-tree", "-r", "-m", "--first-parent", "--root", "--no-commit-id", "--no-renames", "--name-status", "-z", commit)
            blobs += [(commit, path, kind != "D") for kind, path in zip(told[::2], told[1::2]) if path.endswith(self.suffix)]
        return [Blobs(blobs[k : k + self.size]) for k in range(0, len(blobs), self.size)]

    def read(self, partition: Blobs) -> Iterator[tuple[str, str, str | None]]:
        texts = read_git(self.repository, [(commit, path) for commit, path, there in partition.value if there])
        for commit, path, there in partition.value:
            yield commit, path, next(texts) if there else None

    def commit(self, end: dict) -> None:
        pass
