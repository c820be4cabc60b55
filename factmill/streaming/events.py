"""Streams of events: windows with late data, dedup, sessions and a stateful pass. Each function takes batch and streaming frames alike."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.storage import shared_dir

LATE = "1 hour"


def read(spark: SparkSession, folder: str, glob: str = "events.parquet", streaming: bool = True) -> DataFrame:
    """Event files of a folder as a stream, in the batch's schema; ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{glob}").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder) if streaming else spark.read.parquet(f"{folder}/{glob}")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def rates(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """start, event_type, n, total for tumbling (or sliding) windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """user_id, start, stop, n: runs of a user's events with no longer pause than the gap."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def once(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first row of each key within the time that rows may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def _opened(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    opened = state.get[0] if state.exists else 0
    closed = 0
    own = pd.concat(batches)  # a key's rows of a micro-batch come in pieces that are not sorted
    for kind in own.sort_values(["ts", "event_id"])["event_type"]:
        if kind == "signup":
            opened += 1
        elif kind == "purchase" and opened:
            opened, closed = opened - 1, closed + 1
    state.update((opened,))
    yield pd.DataFrame({"user_id": [key[0]], "open": [opened], "closed": [closed]})


def open_without_close(events: DataFrame) -> DataFrame:
    """user_id, open (not closed so far), closed (in this batch): a state for each user that outlives batches."""
    return events.groupBy("user_id").applyInPandasWithState(_opened, "user_id long, open long, closed long", "open long", "update", "NoTimeout")


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over what is there and returns its rows with `epoch`, the micro-batch.

    Batches are written to the folder that driver and executors share, each under its epoch, so that a batch that is repeated
    replaces itself; the checkpoint stands there, too.
    """
    folder = f"{shared_dir(df.sparkSession)}/factmill-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not q.recentProgress:
        return df.sparkSession.createDataFrame([], df.schema).withColumn("epoch", F.lit(0))
    return df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("epoch", IntegerType())])).parquet(f"{folder}/rows")


def for_each_batch(df: DataFrame, write, checkpoint: str):
    """write(batch, epoch) for each micro-batch; a batch that is repeated comes with the same epoch."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """file, modified, text of source files as they arrive; the per-file passes take it like a scan."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
