"""Structured Streaming: windows with watermarks, deduplication, maintained aggregates and leaderboards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators.aggregate import merge_states, state
from strataq.plans.lineage import shared_folder


def read_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream; the schema comes from the files at hand."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{table}*.parquet").parquet(folder)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggs: list[Column], late: str = "1 hour") -> DataFrame:
    return _flat(_timed(df, ts).withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(*aggs), keys)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], aggs: list[Column], late: str = "1 hour") -> DataFrame:
    return _flat(_timed(df, ts).withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(*aggs), keys)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column], late: str = "1 hour") -> DataFrame:
    return _flat(_timed(df, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggs), keys)


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Event times without a zone are taken in the session's zone; window bounds are given back without one."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end"), *keys, *[c for c in df.columns if c != "window" and c not in keys])


def deduplicate(df: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    return _timed(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its output (a parquet sink, or for complete and update mode the last state)."""
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{out}/data")
    last: list[DataFrame] = []

    def keep(batch: DataFrame, epoch: int) -> None:
        path = f"{out}/batch-{epoch}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [batch.sparkSession.read.schema(batch.schema).parquet(path)]

    q = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return last[0]


def maintain(df: DataFrame, keys: list[str], col: str, path: str, checkpoint: str):
    """A maintained aggregate: every micro-batch merges its state into the table at `path` (two folders, swapped by epoch)."""
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = state(batch, keys, col)
        if epoch > 0:
            new = merge_states(spark.read.parquet(f"{path}/{epoch - 1}"), new, keys=keys)
        new.write.mode("overwrite").parquet(f"{path}/{epoch}")

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
