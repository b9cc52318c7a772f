"""The analytical questions, as functions of the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import argmax, equal_width_bin, join_both_ends, reach_nth, tie_shares, top_and_bottom
from .marts import pivoted

TOPICS = ("NEWS", "BLOG", "WIKI", "SHOP")
KEYS = ("ai", "ai_topic", "BLOG", "NEWS", "WIKI", "SHOP")
PUNCTUATION = "[,=:(]"


def _top_by_max(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    return df.withColumn("_m", F.greatest(*columns)).orderBy(F.desc("_m"), "stem").limit(k).drop("_m")


def word_diff(top: DataFrame, k: int = 2000, side: int = 1000) -> DataFrame:
    """stem, AI, HUMAN, diff, side: the words that differ most between texts of machines and humans."""
    d = _top_by_max(top.select("stem", "AI", "HUMAN"), ["AI", "HUMAN"], k)
    return top_and_bottom(d.withColumn("diff", F.round(F.col("AI") - F.col("HUMAN"), 12)), "diff", side, "stem")


def distinguishing_words(words: DataFrame, n: int = 10_000, k: int = 5000, side: int = 50, drop: str = PUNCTUATION) -> DataFrame:
    """stem, NOT_AI, AI, diff, side: the words that tell texts about AI from others. Stems with punctuation go after the top k is taken."""
    values = ["NOT_AI", "AI"]
    d = _top_by_max(reach_nth(pivoted(words, "ai_topic", values), values, n), values, k)
    d = d.withColumn("diff", F.round(F.col("AI") - F.col("NOT_AI"), 12)).where(~F.col("stem").rlike(drop))
    return top_and_bottom(d, "diff", side, "stem")


def citation_matrix(outflow: DataFrame, stats: DataFrame, keys=KEYS, bins: int = 4, dense: bool = True) -> DataFrame:
    """x_key, y_key, x, y, weight: for each pair of keys, links by the bin of the source's share and that of the target's.

    All pairs of keys are counted in one pass. Bins have equal width over the values that occur.
    """
    flat = stats.select("host", "ai", "ai_topic", "topic.*")
    j = join_both_ends(outflow, flat).groupBy(*keys, *(f"{k}_to" for k in keys)).agg(F.sum("occurrences").alias("w"))
    ends = [k + s for s in ("", "_to") for k in keys]
    lim = j.agg(*(f(c).alias(f"{n}_{c}") for c in ends for n, f in (("lo", F.min), ("hi", F.max))))
    binned = j.crossJoin(F.broadcast(lim))  # one row
    binned = binned.select("w", *(equal_width_bin(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins).alias(c) for c in ends))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("x_key"), F.lit(b).alias("y_key"), F.col(a).alias("x"), F.col(f"{b}_to").alias("y")) for a in keys for b in keys)))
    got = binned.select(pairs.alias("p"), "w").groupBy("p.x_key", "p.y_key", "p.x", "p.y").agg(F.sum("w").alias("weight"))
    if not dense:
        return got
    spark = outflow.sparkSession
    grid = spark.createDataFrame([(a, b, x, y) for a in keys for b in keys for x in range(bins) for y in range(bins)], "x_key string, y_key string, x int, y int")
    return grid.join(got, ["x_key", "y_key", "x", "y"], "left").na.fill(0, subset=["weight"])


def news_flow(outflow: DataFrame, stats: DataFrame, predicate: Column) -> DataFrame:
    """topic, outflow: links from hosts that meet the predicate (on ai, human, ai_topic, topic), to the greatest topic of their targets; equal topics share them."""
    j = join_both_ends(outflow, stats.select("host", "ai", "human", "ai_topic", "topic")).where(predicate)
    part = tie_shares({t: F.col(f"topic_to.{t}") for t in TOPICS})
    sums = j.agg(*(F.coalesce(F.sum(part[t] * F.col("occurrences")), F.lit(0.0)).alias(t) for t in TOPICS))
    return sums.unpivot([], list(TOPICS), "topic", "outflow")


def news_flows(outflow: DataFrame, stats: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """source, topic, outflow: news_flow() for several predicates by name, over one join and in one pass."""
    j = join_both_ends(outflow, stats.select("host", "ai", "human", "ai_topic", "topic"))
    part = tie_shares({t: F.col(f"topic_to.{t}") for t in TOPICS})
    sums = j.agg(*(F.coalesce(F.sum(F.when(test, part[t] * F.col("occurrences"))), F.lit(0.0)).alias(f"{name}|{t}") for name, test in predicates.items() for t in TOPICS))
    cells = F.explode(F.array(*(F.struct(F.lit(name).alias("source"), F.lit(t).alias("topic"), F.col(f"`{name}|{t}`").alias("outflow")) for name in predicates for t in TOPICS)))
    return sums.select(cells.alias("c")).select("c.*")


def news_predicates(low: float = 0.3, high: float = 0.7) -> dict[str, Column]:
    news = F.col("topic.NEWS") > high
    return {"ai_news": (F.col("ai") > high) & news, "human_news": (F.col("ai") < low) & news, "ai_topic_news": (F.col("ai_topic") > high) & news, "non_ai_topic_news": (F.col("ai_topic") < low) & news}


def buzzword_usage(stats: DataFrame, least: float = 0.25) -> DataFrame:
    """topic, mean_buzzword, mean_topic over hosts with more than the least share of the topic; a host can count for several."""
    long = stats.select("ai_topic", "topic.*").unpivot(["ai_topic"], list(TOPICS), "topic", "topic_score")
    return long.where(F.col("topic_score") > least).groupBy("topic").agg(F.avg("ai_topic").alias("mean_buzzword"), F.avg("topic_score").alias("mean_topic"))


def main_topic(column: str) -> Column:
    return argmax({t: F.col(f"{column}.{t}") for t in TOPICS})


def reference_sankey(outflow: DataFrame, stats: DataFrame) -> DataFrame:
    """from, to, len: pairs of hosts by their main topics; hosts without one don't count."""
    j = join_both_ends(outflow, stats.select("host", "topic")).select(main_topic("topic").alias("f"), main_topic("topic_to").alias("t"))
    return j.where("f <> 'UNKNOWN' and t <> 'UNKNOWN'").groupBy(F.col("f").alias("from"), F.col("t").alias("to")).agg(F.count(F.lit(1)).alias("len"))


def composition(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """is_ai, ai_topic, topic, url (pages), host (hosts of these classes, null if there are none)."""
    keys = ["is_ai", "ai_topic", "topic"]
    urls = pages.withColumn("topic", F.when(F.col("topic") == "NEWSAPI", "NEWS").otherwise(F.col("topic"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("url"))
    kind = F.when((F.col("ai") > F.col("human")) & (F.col("ai") > 0.5), "AI").when((F.col("ai") < F.col("human")) & (F.col("human") > 0.5), "HUMAN").otherwise("UNKNOWN")
    hosts = stats.select(kind.alias("is_ai"), F.when(F.col("ai_topic") > 0.5, "AI").otherwise("NOT_AI").alias("ai_topic"), main_topic("topic").alias("topic"))
    return urls.join(hosts.groupBy(*keys).agg(F.count(F.lit(1)).alias("host")), keys, "left")
