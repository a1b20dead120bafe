"""Intermediate tables in the folder that all executors share.

The folder is the session's checkpoint folder, as set with ``setCheckpointDir`` or named by
``spark.checkpoint.dir``. Where neither is set, a temporary folder of this process serves on one machine (master ``local``); on a
cluster that is an error, as executors elsewhere could not read it. Tables are Parquet, so a lost executor costs a re-read and no
recomputation. They live until :func:`release`, or the end of the process. A table belongs to the :func:`owner` in whose
block it was made, and only what belongs to that one goes with ``release(name)``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: list[tuple[SparkSession, str, str | None]] = []
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def root(spark: SparkSession) -> str:
    """The shared folder."""
    global _own
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="scratch-")
    return _own


@contextmanager
def owner(name: str) -> Iterator[None]:
    """Tables made in this block belong to ``name``."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted by :func:`release`."""
    path = f"{root(spark)}/hondana-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rpartition("/")[0], _owner.get()))
    return path


def write(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new scratch table and read it again: the lineage ends there."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(name: str | None = None) -> None:
    """Delete the scratch tables of the owner ``name``, or all; what was derived from them must be written by now."""
    for entry in [x for x in _made if name is None or x[2] == name]:
        spark, path, _ = entry
        _made.remove(entry)
        try:
            delete(spark, path)
        except Exception:  # the session has ended: nothing left that could delete
            if spark.sparkContext._jsc is not None:
                raise


def drop(df: DataFrame) -> None:
    """Delete the scratch table that ``df`` reads, once nothing needs it."""
    for file in df.inputFiles()[:1]:
        path = file[: file.rindex("/hondana-") + len("/hondana-") + 32]
        for entry in [x for x in _made if path.endswith(x[1].rpartition("/")[2])]:
            _made.remove(entry)
            delete(entry[0], entry[1])


@atexit.register
def _at_exit() -> None:
    import shutil

    try:
        release()
    except Exception:  # the session is going down with the process
        pass
    if _own:
        shutil.rmtree(_own, ignore_errors=True)
