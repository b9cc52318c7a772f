"""Writers. Spark's committers publish whole results only, and an empty result keeps its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, level: int | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Zstandard parquet, of the given level."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if level is not None:
        w = w.option("parquet.compression.codec.zstd.level", str(level))
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header. one_file is for small results, such as charts' data."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", "true").csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def content_addressed(df: DataFrame, payload: str, path: str) -> None:
    """Adds the payloads that aren't there yet; their MD5 is their name."""
    d = df.select(F.md5(F.col(payload)).alias("name"), F.col(payload).alias("payload")).dropDuplicates(["name"])
    try:
        old = df.sparkSession.read.parquet(path).select("name")
    except Exception as e:  # nothing was written before
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        d = d.join(old, "name", "left_anti")
    d.write.mode("append").option("compression", "zstd").parquet(path)
