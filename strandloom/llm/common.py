"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; everything else is part of a word.
WORD_SEP_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a local session without one, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"strandloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the plans that run inside, which keeps Python workers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def prefer_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batch size for texts: results that are not computed yet will use it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def trimmed(run):
    """An Arrow function whose worker gives its free memory back when a task ends; idle workers stay alive."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def returned(run):
    """A function of a group whose worker gives memory back after each group, when what the function held is free."""

    @functools.wraps(run)
    def wrapped(*group):
        out = run(*group)
        give_back()
        return out

    return wrapped


def give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of names that no table has, and those names by the old ones: what is added then clashes with none."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def old_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(own).alias(c) for c, own in names.items()])


def words_of(text) -> "F.Column":
    """Words of a text as an array (null text: null)."""
    return F.array_remove(F.split(text, WORD_SEP_CLASS + "+", -1), "")


def n_words(text) -> "F.Column":
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def text_buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array; null rows are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices_by_bytes(offsets: np.ndarray, limit: int):
    """Row ranges [a, b) of about `limit` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) on a uint64 array."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
