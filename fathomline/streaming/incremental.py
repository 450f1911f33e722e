"""Incremental variants with Structured Streaming; progress is kept under the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path, written
from ..sources.sinks import read_newest, upsert


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n) with a watermark; works on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Hands all data that is there now to ``each``, batch by batch, and ends; with the same ``checkpoint`` a later call goes on from there."""
    spark = stream.sparkSession
    where = checkpoint or shared_path(spark, "stream")
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", where).foreachBatch(each).start().awaitTermination()


def drain(spark: SparkSession, folder: str, name: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over all Parquet files of one name now, and returns its last complete result."""
    source = spark.read.parquet(f"{folder}/{name}.parquet")
    held: list[DataFrame] = []
    stream = transform(spark.readStream.schema(source.schema).parquet(f"{folder}/{name}.parquet*"))

    def keep(batch: DataFrame, _: int) -> None:
        held[:] = [written(batch)]

    run_available(stream, keep, "complete")
    return held[0] if held else transform(source.limit(0))


def upsert_latest(current: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of every key over a table and a batch: the body of a foreachBatch merge."""
    both = current.unionByName(batch)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.struct(*order)).alias("r")).select("r.*")


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str | None = None) -> DataFrame:
    """Merges a stream into a table of the newest row of every key, batch by batch, and returns the table.

    A batch that is run again after a failure leaves the table as it is: merging is idempotent. A batch costs its own
    rows and, now and then, a merge of segments no longer than what came since.
    """
    spark = stream.sparkSession
    run_available(stream, lambda batch, _: upsert(spark, path, batch, key, order) and None, checkpoint=checkpoint)
    found = read_newest(spark, path)
    return stream_rows(stream) if found is None else found


def stream_rows(stream: DataFrame) -> DataFrame:
    """No rows, with the columns of a stream."""
    return stream.sparkSession.createDataFrame([], stream.schema)


def append_learnings(spark: SparkSession, folder: str, path: str, schema: str, checkpoint: str | None = None) -> DataFrame:
    """Appends the records of new JSON-lines files of a folder to a Parquet table; records that don't parse are left out."""
    stream = spark.readStream.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(folder)

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.where("_broken is null").drop("_broken").withColumn("batch", F.lit(number).cast("long"))
        # A batch that is run again replaces its own part.
        rows.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(path)

    run_available(stream, each, checkpoint=checkpoint)
    return spark.read.schema(schema + ", batch long").parquet(path)
