"""Building blocks that Spark has no single call for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed
from pyspark.sql import types as T

TOPICS = ("NEWS", "BLOG", "WIKI", "SHOP")


def unnest(df: DataFrame, *structs: str) -> DataFrame:
    """Fields of the structs as columns, in place of them."""
    return df.select(*(F.col(f"{c}.*") if c in structs else F.col(c) for c in df.columns))


def rename_fields(df: DataFrame, struct: str, names: list[str]) -> DataFrame:
    """The struct with its fields renamed by position."""
    fields = df.schema[struct].dataType.fieldNames()
    if len(names) != len(fields):
        raise ValueError(f"{struct} has {len(fields)} fields")
    return df.withColumn(struct, F.struct(*(F.col(struct)[f].alias(n) for f, n in zip(fields, names))))


def first_language(df: DataFrame, column: str = "lang") -> DataFrame:
    """The column as a struct: a list's first entry, or the struct as it is."""
    return df.withColumn(column, F.get(column, 0)) if isinstance(df.schema[column].dataType, T.ArrayType) else df


def suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns})


def join_both_ends(edges: DataFrame, stats: DataFrame, src: str = "from", dst: str = "to", key: str = "host") -> DataFrame:
    """Edges between different hosts, with the source's columns, and the target's under the suffix _to."""
    to = suffixed(stats, "_to")
    return edges.where(F.col(src) != F.col(dst)).join(stats, F.col(src) == F.col(key)).drop(key).join(to, F.col(dst) == F.col(f"{key}_to")).drop(f"{key}_to")


def argmax(values: dict[str, Column], none: str = "UNKNOWN") -> Column:
    """The name of the greatest value, the first of equal ones; none where all are 0 or null."""
    top = F.greatest(*values.values())
    out = F.when(F.coalesce(top, F.lit(0.0)) == 0, F.lit(none))
    for k, v in values.items():
        out = out.when(v == top, F.lit(k))
    return out


def tie_shares(values: dict[str, Column]) -> dict[str, Column]:
    """For each name, 1 / k where it is one of k that reach the greatest value, 0 elsewhere and where nothing is above 0."""
    top = F.greatest(*values.values())
    one = {k: F.when(v == top, 1.0).otherwise(0.0) for k, v in values.items()}
    total = reduce(lambda a, b: a + b, one.values())
    return {k: F.when(top > 0, v / F.nullif(total, F.lit(0.0))).otherwise(0.0) for k, v in one.items()}


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins of equal width from low to high, the last one closed; all in bin 0 where low equals high. Values out of range have none."""
    span = F.nullif(high - low, F.lit(0.0))
    b = F.coalesce(F.floor((value - low) / span * bins), F.lit(0))
    return F.when(value.between(low, high), F.least(b, F.lit(bins - 1))).cast("int")


def nth_largest(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """One row: the n-th largest value of each column, null where there are fewer rows. Each is a top-n of its own, so nothing is sorted as a whole."""
    out = None
    for c in columns:
        t = df.select(c).orderBy(F.desc(c)).limit(n).agg(F.when(F.count(F.lit(1)) >= n, F.min(c)).alias(c))
        out = t if out is None else out.crossJoin(t)
    return out


def reach_nth(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Rows that reach the n-th largest value in one of the columns at least, ties too; all rows where there are fewer than n. df is computed once, and kept in the shared folder."""
    df = checkpointed(df)
    at = suffixed(nth_largest(df, columns, n), "_nth")
    keep = reduce(lambda a, b: a | b, (F.col(f"{c}_nth").isNull() | (F.col(c) >= F.col(f"{c}_nth")) for c in columns))
    return df.crossJoin(F.broadcast(at)).where(keep).select(*df.columns)  # at is one row


def top_and_bottom(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k largest and the k smallest rows, with side "top" or "bottom"."""
    top = df.orderBy(F.desc(by), tie).limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(F.asc(by), tie).limit(k).withColumn("side", F.lit("bottom")))


def ratio_to_total(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*keys))))


def sample_rows(df: DataFrame, n: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """n random rows, the same for a seed however the rows are partitioned: those of the smallest hashes of seed and keys (all columns, if none are named)."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys or df.columns]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *own)), *(keys or df.columns)).limit(n)


def content_addressed(df: DataFrame, payload: str) -> DataFrame:
    """One row per content, with its name (MD5)."""
    return df.withColumn("name", F.md5(F.col(payload))).dropDuplicates(["name"])


def numbered(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """Distinct values with numbers from 0 in their order. Ranges are numbered apart and put together by their sizes, so no task sorts all."""
    d = df.select(column).where(F.col(column).isNotNull()).distinct()
    d = d.withColumn("_b", F.substring(F.hex(F.encode(F.col(column).cast("string"), "UTF-8")), 1, 4))
    sizes = d.groupBy("_b").count().withColumn("_o", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(sizes, "_b").withColumn(name, F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1 + F.col("_o")).select(column, name)
