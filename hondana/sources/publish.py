"""Publishing as a sink: gated requests go to a transport that the caller gives; what came back is an audit table.

The transport is called on the executors, once per document that is ready: ``send(method, endpoint, payload, token,
timeout) -> (status, body)``. Token and tags are checked before any call, and no error text holds the token. A journal keyed by document and content is
read before and written after each call, so that a request goes out once although tasks are retried.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ENDPOINT = "https://qiita.com/api/v2/items"
TIMEOUT = 30
#: Error texts (fixed values).
NO_TOKEN = "QIITA_TOKEN が設定されていません"
NO_TAGS = "タグを最低1つ指定してください"
TIMED_OUT = "Qiita API への接続がタイムアウトしました"
UNREACHABLE = "Qiita API への接続に失敗しました"
RESULT = "doc_id long, ok boolean, status_code int, url string, item_id string, error_message string"

#: Ours: a task ended between sending and telling.
UNSETTLED = "前回の送信結果が確認できないため送信しません"

Send = Callable[[str, str, dict, str, int], tuple[int, str]]
#: Looks an item up by the key of its content: (url, item_id), or None if there is none.
Find = Callable[[str], tuple[str, str] | None]


def load_token(environment: dict | None = None, home: Path | None = None) -> str | None:
    """The token of the environment, else of ``~/.secrets/qiita.env``."""
    given = (os.environ if environment is None else environment).get("QIITA_TOKEN", "").strip()
    if given:
        return given
    file = (home or Path.home()) / ".secrets" / "qiita.env"
    if file.is_file():
        for line in file.read_text(encoding="utf-8").splitlines():
            key, found, value = line.strip().removeprefix("export ").partition("=")
            if found and key.strip() == "QIITA_TOKEN" and value.strip().strip("\"'"):
                return value.strip().strip("\"'")
    return None


def publish_one(send: Send, token: str | None, title: str, body: str, tags: list[str], private: bool = True, tweet: bool = False, item_id: str | None = None) -> dict:
    """Create an item, or update ``item_id``; the result as a row without doc_id."""
    result = {"ok": False, "status_code": 0, "url": "", "item_id": "", "error_message": ""}
    if not token:
        return result | {"error_message": NO_TOKEN}
    if not tags:
        return result | {"error_message": NO_TAGS}
    payload = {"title": title, "body": body, "tags": [{"name": t, "versions": []} for t in tags], "private": private, "tweet": tweet}
    method, endpoint, good = ("PATCH", f"{ENDPOINT}/{item_id}", 200) if item_id else ("POST", ENDPOINT, 201)
    try:
        status, text = send(method, endpoint, payload, token, TIMEOUT)
    except TimeoutError:
        return result | {"error_message": TIMED_OUT}
    except OSError:
        return result | {"error_message": UNREACHABLE}
    try:
        data = json.loads(text)
    except ValueError:
        data = {}
    data = data if isinstance(data, dict) else {}
    if status == good:
        return result | {"ok": True, "status_code": status, "url": data.get("url") or "", "item_id": data.get("id") or ""}
    return result | {"status_code": status, "error_message": str(data.get("message") or f"HTTP {status}").replace(token, "***")}


class Journal:
    """What was begun and what came of it, by content, as files of a folder that all executors share (POSIX, so that a claim is made once).

    A key is claimed before anything is sent, and settled after. A claim that isn't settled means that a task ended in between.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, kind: str, key: str) -> str:
        path = f"{self.folder}/{kind}/{key[:2]}"
        os.makedirs(path, exist_ok=True)
        return f"{path}/{key}.json"

    def settled(self, key: str) -> dict | None:
        try:
            with open(self._path("settled", key), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def claim(self, key: str) -> bool:
        """Whether the key is this caller's from now on."""
        try:
            os.close(os.open(self._path("claims", key), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            return False

    def age(self, key: str) -> float:
        """Seconds since the key was claimed."""
        try:
            return time.time() - os.stat(self._path("claims", key)).st_mtime
        except FileNotFoundError:
            return 0.0

    def take_over(self, key: str) -> None:
        os.utime(self._path("claims", key))

    def release(self, key: str) -> None:
        os.unlink(self._path("claims", key))

    def settle(self, key: str, result: dict) -> dict:
        path = self._path("settled", key)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(result, f, ensure_ascii=False)
        os.replace(part, path)
        return result


def content_key(doc_id: int | None, title: str, body: str, tags: list[str], private: bool) -> str:
    """What makes two requests the same: the document and all that is sent of it."""
    return hashlib.sha256(json.dumps([doc_id, title, body, tags, private], ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


def publish_once(journal: Journal, send: Send, find: Find | None, token: str | None, row: dict, patience: float = 2 * TIMEOUT) -> dict:
    """The result for a row (doc_id, title, text, tags, private), sent at most once however often it is asked for.

    What is settled is told again. What is claimed but not settled may have been sent: ``find`` is asked, and what it finds is the result. If it finds nothing ``patience`` seconds after the claim, the
    row is sent; before that, or without ``find``, the result is an error that says so. An answer that refuses the item gives the claim up, so a later run may send it again; no answer keeps it.
    """
    key = content_key(row["doc_id"], row["title"], row["text"], row["tags"], row["private"])
    known = journal.settled(key)
    if known is not None:
        return known
    open_ = {"doc_id": row["doc_id"], "ok": False, "status_code": 0, "url": "", "item_id": "", "error_message": UNSETTLED}
    if not token or not row["tags"]:
        return open_ | publish_one(send, token, row["title"], row["text"], row["tags"], row["private"])
    if not journal.claim(key):
        found = find(key) if find else None
        if found is not None:
            return journal.settle(key, open_ | {"ok": True, "status_code": 201, "url": found[0], "item_id": found[1], "error_message": ""})
        if find is None or journal.age(key) < patience:
            return journal.settled(key) or open_
        journal.take_over(key)
    result = {"doc_id": row["doc_id"]} | publish_one(send, token, row["title"], row["text"], row["tags"], row["private"])
    if result["ok"]:
        return journal.settle(key, result)
    if result["status_code"]:
        journal.release(key)
    return result


def publish(ready: DataFrame, send: Send, token: str | None, journal: str, find: Find | None = None, patience: float = 2 * TIMEOUT) -> DataFrame:
    """One result per row of ``ready`` (doc_id, title, text, tags, private), in Arrow batches. Retried tasks, speculation and further actions send nothing twice: see :func:`publish_once`."""
    kind = pa.schema([("doc_id", pa.int64()), ("ok", pa.bool_()), ("status_code", pa.int32()), ("url", pa.string()), ("item_id", pa.string()), ("error_message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [publish_once(Journal(journal), send, find, token, r, patience) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return ready.select("doc_id", "title", "text", "tags", "private").mapInArrow(run, RESULT)


def read_journal(spark: SparkSession, journal: str) -> DataFrame:
    """The settled results, one a request, as a table."""
    return spark.read.schema(RESULT).option("recursiveFileLookup", True).json(f"{journal}/settled")


@dataclass
class Sent(WriterCommitMessage):
    ok: int
    failed: int


class PublishWriter(DataSourceWriter):
    """Sends the rows of a partition through the journal; a run's counts are told in ``runs`` when it ends, whether it was committed or not."""

    def __init__(self, options: dict[str, str]):
        self.journal = options["journal"]
        self.transport = options["transport"]
        self.find = options.get("find")
        self.patience = float(options.get("patience", 2 * TIMEOUT))
        self.token = options.get("token") or load_token()
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Sent:
        send, find, token = _named(self.transport), self.find and _named(self.find), self.token
        counts = {True: 0, False: 0}
        for r in rows:
            counts[publish_once(Journal(self.journal), send, find, token, r.asDict(), self.patience)["ok"]] += 1
        return Sent(counts[True], counts[False])

    def _told(self, how: str, messages: list[Sent | None]) -> None:
        os.makedirs(f"{self.journal}/runs", exist_ok=True)
        known = [m for m in messages if m is not None]
        with open(f"{self.journal}/runs/{self.run}.json", "w", encoding="utf-8") as f:
            json.dump({"run": self.run, "state": how, "ok": sum(m.ok for m in known), "failed": sum(m.failed for m in known)}, f)

    def commit(self, messages: list[Sent | None]) -> None:
        self._told("committed", messages)

    def abort(self, messages: list[Sent | None]) -> None:
        """What was sent stays settled in the journal; the next run goes on from there."""
        self._told("aborted", messages)


class PublishSource(DataSource):
    """``ready.write.format("article_publish").option("journal", folder).option("transport", "module:function").mode("append").save()``; ``find``, ``patience`` as :func:`publish_once` has them.

    ``token`` is an option that Spark redacts in plans; without it :func:`load_token` looks for one.
    """

    @classmethod
    def name(cls) -> str:
        return "article_publish"

    def writer(self, schema: StructType, overwrite: bool) -> PublishWriter:
        missing = {"doc_id", "title", "text", "tags", "private"} - set(schema.names)
        if missing or overwrite:
            raise ValueError(f"columns are missing: {sorted(missing)}" if missing else "published items can't be overwritten: append")
        return PublishWriter(dict(self.options))


def _named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)
