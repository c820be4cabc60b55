"""Helpers shared by the operators: shared storage, Arrow batches, small broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a frame may have and still be broadcast; beyond it a shuffled join is planned.
BROADCAST_ROWS = 1 << 20
BATCH_ROWS = 1000
#: Tasks that a core gets at most where a frame is written as one file a task.
WAVES = 8
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset."""
    sc = spark.sparkContext
    set_to = sc.getConf().get("spark.checkpoint.dir")
    if set_to is None:
        set_to = sc.getCheckpointDir()
    if set_to is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="factmill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/factmill-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str, **options) -> DataFrame:
    """As cut(), through a Parquet table (compressed, column-pruned on reading), with these options of the writer."""
    path = scratch(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, waves: int = WAVES) -> DataFrame:
    """df in so many partitions for each core at most, without a shuffle.

    On a local disk Hadoop starts a process for each file that it makes (chmod), and until that has begun it is a second executor to
    who measures, with all memory of the first. So files should not grow in number with the input.
    """
    return df.coalesce(waves * df.sparkSession.sparkContext.defaultParallelism)


def small_side(df: DataFrame) -> DataFrame:
    """A broadcast hint if df is a stored frame of at most BROADCAST_ROWS narrow rows, else df as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """Slices of a batch with at most max_bytes of the column's text each, or one row; no row is left out."""
    arr = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(arr), 0)).astype(np.int64)
    done = np.cumsum(size)
    lo, n, base = 0, len(size), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(done, base + max_bytes, side="right")))
        yield batch.slice(lo, hi - lo)
        base, lo = int(done[hi - 1]), hi


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as long as df has a column that Spark would take for the same one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def plainly_named(df: DataFrame) -> DataFrame:
    """df with other names for columns whose names are no plain words: Spark's Arrow functions look columns up by unquoted names."""
    odd = [c for c in df.columns if not re.fullmatch("[A-Za-z0-9_]+", c)]
    new = dict(zip(odd, fresh(df, *[f"column{i}" for i in range(len(odd))]), strict=True))
    return df.toDF(*[new.get(c, c) for c in df.columns]) if odd else df


def quoted(names: list[str]) -> list[Column]:
    """Columns of these names, whatever characters they have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, over all rows."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0)


def release() -> None:
    """Gives freed memory back: allocators keep it otherwise, and a worker process lives on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _tidied(f, batches):
    try:
        yield from f(batches)
    finally:
        release()


def tidy(f):
    """f over batches, with release() at the task's end.

    Batches of this session get BATCH_ROWS rows unless it sets a number itself: by Spark's default, 10,000 long texts would
    stand in memory at once, in the executor and in Python.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_ROWS)
    return partial(_tidied, f)
