"""Aggregates behind charts: fractions, roll-ups, proportions, merged lists, box plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _total(value: str, *keys: str):
    return F.sum(value).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))


def matrix_fractions(matrix: DataFrame, keys=("x_key", "y_key")) -> DataFrame:
    """The matrix with its fractions of row, column and whole."""
    w = F.col("weight")
    return matrix.withColumns({"of_x": F.try_divide(w.cast("double"), _total("weight", *keys, "x")), "of_y": F.try_divide(w.cast("double"), _total("weight", *keys, "y")), "of_all": F.try_divide(w.cast("double"), _total("weight", *keys))})


def treemap_rollup(comp: DataFrame, metric: str = "url", show_unknown: bool = True, focus: tuple = ()) -> DataFrame:
    """level, is_ai, ai_topic, topic, value, of_view, of_total: sums at each level of the hierarchy below the focus (a path of values)."""
    names = ["is_ai", "ai_topic", "topic"]
    if not show_unknown:
        comp = comp.where("is_ai <> 'UNKNOWN' and topic <> 'UNKNOWN'")
    total = comp.agg(F.sum(metric).alias("total"))
    for c, v in zip(names, focus):
        comp = comp.where(F.col(c) == v)
    r = comp.rollup(*names).agg(F.sum(metric).alias("value"), F.grouping_id().alias("g"))
    r = r.withColumn("level", F.when(F.col("g") == 0, 3).when(F.col("g") == 1, 2).when(F.col("g") == 3, 1).otherwise(0)).where(F.col("level") >= len(focus))
    view = F.max(F.when(F.col("level") == len(focus), F.col("value"))).over(Window.partitionBy(F.lit(0)))
    r = r.crossJoin(F.broadcast(total))  # one row
    return r.select("level", *names, "value", F.try_divide(F.col("value").cast("double"), view).alias("of_view"), F.try_divide(F.col("value").cast("double"), F.col("total")).alias("of_total"))


def proportions(values: DataFrame, category: str, value: str, categories: list[str]) -> DataFrame:
    """Each of the categories with its value (0 if missing) and its share of the sum."""
    dim = values.sparkSession.createDataFrame([(c, i) for i, c in enumerate(categories)], f"{category} string, position int")
    d = dim.join(values.groupBy(category).agg(F.sum(value).alias(value)), category, "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    return d.withColumn("share", F.coalesce(F.try_divide(F.col(value), _total(value)), F.lit(0.0)))


def sankey_shares(links: DataFrame, include_self: bool = False) -> DataFrame:
    """from, to, len with the totals of both ends, the greater grand total, and the link's share of its source."""
    d = links if include_self else links.where(F.col("from") != F.col("to"))
    d = d.withColumns({"from_total": _total("len", "from"), "to_total": _total("len", "to"), "grand_total": _total("len")})
    return d.withColumn("share", F.col("len") / F.col("from_total"))


def dumbbell(lists: DataFrame, top_n: int = 10, hide_symbols: bool = True, sort_by: str = "abs_diff") -> DataFrame:
    """stem, NOT_AI, AI, diff of merged lists: each stem once, with its greatest difference; the 2 top_n first in order."""
    d = lists.where(~F.col("stem").rlike("^[^a-zA-Z0-9]+$")) if hide_symbols else lists
    once = Window.partitionBy("stem").orderBy(F.desc(F.abs("diff")), F.desc("diff"))
    d = d.withColumn("_k", F.row_number().over(once)).where("_k = 1")
    order = {"abs_diff": F.abs("diff"), "ai": F.col("AI"), "not_ai": F.col("NOT_AI")}[sort_by]
    return d.orderBy(order.desc(), "stem").limit(2 * top_n).select("stem", "NOT_AI", "AI", "diff")


def boxplot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 interquartile ranges), mean and count by group."""
    q = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    q = q.select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "low", "high", "n")
    far = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.select(F.col(group).alias("_g"), F.col(value).alias("_v")).join(q, F.col("_g").eqNullSafe(F.col(group))).where(F.col("_v").between(F.col("q1") - far, F.col("q3") + far))
    whiskers = inside.groupBy("_g").agg(F.min("_v").alias("whisker_low"), F.max("_v").alias("whisker_high"))
    return q.join(whiskers, F.col("_g").eqNullSafe(F.col(group))).drop("_g")
