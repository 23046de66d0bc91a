"""The folder that driver and executors share, and tables written to it.

A long plan is cut by writing a table there and reading it back, so a lost executor costs no recomputation.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many are sent to every task; a row here is a few numbers, so 200,000 stay under 20 MB.
BROADCAST_ROWS = 200_000
#: And texts in them may have this many bytes together.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder; a session in one process may do without either."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store: without one it lies in the session's default file system, which need not be a disk."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def fresh_path(spark: SparkSession, what: str) -> str:
    return qualified(spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")


#: Files of a table of few rows.
FEW_FILES, FEW_ROWS = 48, 1_000_000
_scratch: list[list[str]] = []


def stored(df: DataFrame, what: str, rows: int | None = None, keep: bool = False) -> DataFrame:
    """df written once to the shared folder and read back.

    rows: a bound for narrow rows, where one is known; few rows become few files. keep: it outlasts the scratch() around it.
    """
    path = fresh_path(df.sparkSession, what)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)  # what an inner one keeps goes with the one around it
    if rows is not None and rows <= FEW_ROWS:
        df = df.coalesce(FEW_FILES)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside, but for those to keep, are deleted at the end: by then what is needed has been stored."""
    _scratch.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _scratch.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def small(df: DataFrame, rows: int | None = None, text: tuple[str, ...] = ()) -> DataFrame:
    """df marked for broadcasting if its counted rows allow it; else as it is, for a shuffle join.

    text: columns whose bytes count, too, where rows may be long.
    """
    if text:
        size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in text), F.lit(0).cast("long"))
        seen = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        return F.broadcast(df) if seen["n"] <= BROADCAST_ROWS and seen["bytes"] <= BROADCAST_BYTES else df
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs started inside send Python batches of at most `most` bytes, for rows that are large by themselves."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Bytes and rows of a batch that is sent to Python, where the session names no others.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Python batches are small: of whole texts, the usual number of rows is many megabytes."""
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def fresh_name(wanted: str, *taken: list[str]) -> str:
    """A column name that none of the lists holds, whatever its case."""
    used = {c.lower() for names in taken for c in names}
    while wanted.lower() in used:
        wanted += "_"
    return wanted
