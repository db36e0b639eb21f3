"""Tables written between stages, in the folder that driver and executors share, and how long they live."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session has none, as in tests, a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/strandloom-{os.getuid()}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of that name in the session's own scope."""
    return f"{session_scope(spark).path}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Scope:
    """Owner of stage tables. Left without an error, it deletes them; left by an error, it keeps them.

    A scope of a name has a place of that name: run again after a failure, it takes the tables
    that were written whole and computes the rest. A scope without a name starts anew.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark, self.named = spark, name is not None
        self.path = f"{shared_root(spark)}/stages/{name or uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def stored(self, d: DataFrame, step: str) -> DataFrame:
        """d, written and read again: later stages start from files, whatever becomes of the executors."""
        path = f"{self.path}/{step}" if self.named else f"{self.path}/{step}-{uuid.uuid4().hex}"
        if not (self.named and exists(self.spark, f"{path}/_SUCCESS")):
            d.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(d.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, d: DataFrame) -> None:
        """Delete a table of this scope that nothing reads any more."""
        for t, path in self.tables:
            if t is d:
                remove(self.spark, path)
        self.tables = [x for x in self.tables if x[0] is not d]

    def close(self) -> None:
        remove(self.spark, self.path)
        self.tables = []

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()


_SESSIONS: dict[str, Scope] = {}


def session_scope(spark: SparkSession) -> Scope:
    """The scope of results that are read after their function has returned; it ends with the application."""
    key = spark.sparkContext.applicationId
    if key not in _SESSIONS:
        _SESSIONS[key] = Scope(spark)
    return _SESSIONS[key]


@atexit.register
def _end() -> None:
    for scope in _SESSIONS.values():
        if scope.spark.sparkContext._jsc is not None and scope.spark.sparkContext._jsc.sc().isStopped() is False:
            with contextlib.suppress(Exception):  # the session may end meanwhile
                scope.close()


def stored(d: DataFrame, name: str, scope: Scope | None = None) -> DataFrame:
    """Scope.stored of the given scope, else of the session's."""
    return (scope or session_scope(d.sparkSession)).stored(d, name)
