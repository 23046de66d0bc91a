"""Work that begins when other work has left its marker: queueing of new partitions, and a launch that happens once."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.streaming.tail import drain

AUDIT = "part string, status string, version string"


def audits(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """The audit markers of a folder as a stream; every file is read once."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(path)


def queue_new(stream: DataFrame, keys: list[str], packed: DataFrame, queue: str) -> None:
    """Appends to the table at `queue` each partition whose marker has come, that has data, and that is not packed or queued.

    packed: keys of the partitions that need no work, read anew for every batch. A batch that runs twice writes its own
    folder again, and looks for earlier entries in the other batches' folders only, so it queues the same partitions again
    and none twice. Markers that are written again, and several in one batch, count once.
    """
    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "batch bigint"])
    spark.createDataFrame([], schema).drop("batch").write.mode("ignore").parquet(f"{queue}/batch=-1")  # so that there is something to read

    def put(batch: DataFrame, no: int) -> DataFrame:
        ready = batch.filter(~F.col("status").eqNullSafe("missing_source")).select(*keys).distinct()
        queued = spark.read.schema(schema).parquet(queue).filter(F.col("batch") != no)
        return ready.join(packed.select(*keys), keys, "left_anti").join(queued, keys, "left_anti")

    drain(stream, queue, "append", put)


def queued(spark: SparkSession, queue: str) -> DataFrame:
    """keys and batch of everything queued so far."""
    return spark.read.parquet(queue)


def claim(spark: SparkSession, marker: str, who: str) -> bool:
    """Makes the file `marker` hold `who` unless it is there; True for the one that made it, also when asked again.

    The content is written aside and then linked or renamed to its place, which fails where the file exists; a marker is
    therefore never there without its content.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(marker)
    fs = path.getFileSystem(conf)
    path = fs.makeQualified(path)
    aside = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}-{uuid.uuid4().hex}")
    fs.mkdirs(path.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(who.encode()))
    out.close()
    try:
        if path.toUri().getScheme() == "file":  # a local rename would replace the file
            os.link(aside.toUri().getPath(), path.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(aside, path, none)
        return True
    except Exception as e:
        if not fs.exists(path):
            raise e
        held = fs.open(path)
        text = jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(held)
        held.close()
        return bytes(text).decode() == who
    finally:
        fs.delete(aside, False)


def launch_once(stream: DataFrame, keys: list[str], expected: DataFrame, folder: str, marker: str, out: str, who: str) -> None:
    """When every expected partition has its marker, claims the launch; of several streams that watch, one gets it.

    folder: where the stream's markers lie; all of them are looked at with every batch. Appends one row for each batch to the
    table at `out`: who, state ('waiting', 'launched' or 'refused'), present. A batch that runs again says the same.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, no: int) -> DataFrame:
        there = spark.read.schema(stream.schema).option("recursiveFileLookup", True).json(folder).filter(F.col("status") != "missing_source").select(*keys).distinct()
        present = expected.join(there, keys, "left_semi").count()
        ready = expected.join(there, keys, "left_anti").isEmpty()
        state = "waiting" if not ready else "launched" if claim(spark, marker, f"{who}:{no}") else "refused"
        return spark.createDataFrame([(who, state, present)], "who string, state string, present bigint")

    drain(stream, out, "append", put)
