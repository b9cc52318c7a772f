"""Incremental runs: only what no earlier run has seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unprocessed(inputs: DataFrame, done: DataFrame, key: str = "segment") -> DataFrame:
    """Inputs without a row in done. Null keys are never done."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def read_new(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """A parquet table with its files' names as segment, without the segments that are done."""
    d = spark.read.option("ignoreCorruptFiles", "true").parquet(path).withColumn("segment", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return d if done is None else unprocessed(d, done)


def process_new_files(spark: SparkSession, source: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], schema=None) -> None:
    """Runs transform over the files that arrived in source since the last call and appends to sink; the stream's checkpoint knows which those are. Returns when all are written."""
    schema = schema or spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("ignoreCorruptFiles", "true").parquet(source)
    transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
