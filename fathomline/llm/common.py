"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Folders that ``materialise`` has made in this process and not dropped.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under ``spark.checkpoint.dir``, which all executors see.

    Where that setting is absent and all runs in one process (tests), a temporary folder of this
    machine is put into it, so later calls reuse it; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/fathomline-{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet (zstd) into the shared folder and read it back.

    Cuts the lineage at a place that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    MADE.append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of DataFrames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_made(spark: SparkSession, paths: set[str]) -> None:
    """Delete these of the folders that ``materialise`` has made."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths & set(MADE):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        MADE.remove(path)
    release(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt to all of them, as a file may be a single row group."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty: offsets has one more entry than rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """Regroup batches so that a slice holds about ``most_bytes`` of text; one longer row stays whole."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        part = pa.Table.from_batches([batch])
        lengths = pc.fill_null(pc.binary_length(part[column]), 0).to_numpy()
        begin, total = 0, np.cumsum(lengths)
        while begin < len(part):
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + most_bytes - size, "right")))
            held.append(part.slice(begin, end - begin))
            size += int(total[end - 1] - base)
            begin = end
            if size >= most_bytes or begin < len(part):
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def to_batches(schema: pa.Schema, columns: dict) -> Iterator[pa.RecordBatch]:
    arrays = [columns[f.name] if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(columns[f.name], f.type) for f in schema]
    arrays = [(a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).cast(f.type) for a, f in zip(arrays, schema)]
    yield pa.RecordBatch.from_arrays(arrays, schema=schema)
