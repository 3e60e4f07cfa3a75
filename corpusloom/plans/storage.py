"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folder for sessions that run on one machine and name no checkpoint folder.
LOCAL = "/tmp/corpusloom-shared"
#: Lets Spark remove the shuffle files of a query as soon as the query is done.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that are still there, in the order of writing, each with the function that deletes it; and by the rows read from them.
_tables: dict[str, Callable[[], object]] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder. A session on several machines must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again; what the writing shuffled is given back at once.

    The table lives until `drop`, the end of the enclosing `temporary`, or the end of the program."""
    spark = df.sparkSession
    path, before = shared_folder(spark), spark.conf.get(CLEAN, "false")
    _tables[path] = _deleter(spark, path)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*rows: DataFrame) -> None:
    """Deletes the tables that cut_lineage wrote for these rows; nothing may read them any more."""
    for df in rows:
        _delete(_paths.get(df))


@contextmanager
def temporary(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes what is written inside when the block ends, but for the tables of rows that are appended to its list."""
    held, before = list(kept), set(_tables)
    try:
        yield held
    finally:
        stay = {_paths.get(df) for df in held}
        for path in [p for p in _tables if p not in before and p not in stay]:
            _delete(path)


def _deleter(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return lambda: there.getFileSystem(conf).delete(there, True)


def _delete(path: str | None) -> None:
    if path in _tables:
        _tables.pop(path)()


@atexit.register
def _delete_all() -> None:
    for path in list(_tables):
        try:
            _delete(path)
        except (Py4JError, OSError):  # the session's machine has gone
            return
