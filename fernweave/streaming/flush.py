"""Micro-batch flushes: a file stream whose batches are merged into keyed tables.

A batch may be delivered again after a failure.  Every flush is therefore idempotent: rows
are merged by key, or kept by the number of their batch, so that a second delivery
replaces the first.  Edges are resolved after the stream, against all symbols, as an
endpoint may come in a later batch than the edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Graph, GraphStore
from ..sources.shared import shared_folder


def open_stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """A stream of the Parquet files of a folder, or of a single file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def run_batches(stream: DataFrame, folder: str, flush: Callable[[DataFrame, int], None]) -> None:
    """All that the stream has now, batch by batch; returns when it is flushed."""
    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    writer.start().awaitTermination()


def count_stream(spark: SparkSession, path: str, key: str, files_per_batch: int = 100) -> DataFrame:
    """(key, n) over a Parquet file stream: each batch writes its partial counts under its own number."""
    folder = shared_folder(spark, "stream")
    stream = open_stream(spark, path, files_per_batch)

    def flush(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    run_batches(stream, folder, flush)
    return spark.read.schema("key string, n bigint").parquet(f"{folder}/counts/batch=*").groupBy("key").agg(F.sum("n").alias("n"))


def flush_symbols(stream: DataFrame, store: GraphStore, folder: str) -> Graph:
    """Symbol rows (with ordinal) of a stream merged into the stored graph, a commit per batch.

    The symbols of one file may come in several batches, so what a file no longer declares
    is swept once, after the stream: every batch leaves its keys and files under its number.
    """

    def flush(batch: DataFrame, number: int) -> None:
        store.commit(store.load().upsert_symbols(batch))
        batch.select("file_key", "key").distinct().write.mode("overwrite").parquet(f"{folder}/flushed/batch={number}")

    run_batches(stream, folder, flush)
    place = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/flushed")
    if not place.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return store.load()  # no batch came
    flushed = store.spark.read.schema("file_key string, key string").parquet(f"{folder}/flushed/batch=*")
    return store.commit(store.load().sweep(flushed.select("file_key"), flushed.select("key")))
