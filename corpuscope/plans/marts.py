"""Derived tables that the questions are answered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import ratio_to_total, reach_nth


def _share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).when(test.isNull(), F.lit(None)).otherwise(0.0))


def domain_stats(pages: DataFrame) -> DataFrame:
    """host, ai, human, ai_topic (shares of its pages), topic (struct of shares; news agencies count as NEWS), samples."""
    n = F.count(F.lit(1))
    topic = F.struct(*((F.count_if(F.col("topic").isin(*(("NEWS", "NEWSAPI") if t == "NEWS" else (t,)))) / n).alias(t) for t in ("NEWS", "BLOG", "WIKI", "SHOP")))
    return pages.groupBy("host").agg(_share(F.col("is_ai") == "AI").alias("ai"), _share(F.col("is_ai") == "HUMAN").alias("human"), _share(F.col("ai_topic") == "AI").alias("ai_topic"), topic.alias("topic"), n.alias("samples"))


def domain_outflow(pages: DataFrame) -> DataFrame:
    """from, to, occurrences: links between hosts. Rows with a null in any of them don't count."""
    d = pages.select(F.col("host").alias("from"), F.explode("outflow").alias("o")).select("from", F.col("o.url").alias("to"), F.col("o.occurrences").alias("occurrences")).dropna("any")
    return d.groupBy("from", "to").agg(F.sum("occurrences").alias("occurrences"))


def word_distribution(pages: DataFrame, keep_null_stem: bool = True) -> DataFrame:
    """is_ai, ai_topic, topic, stem, occurrence, and p, its share of the group's occurrences. Pages without stems give a null stem with 0."""
    e = F.explode_outer("stems") if keep_null_stem else F.explode("stems")
    d = pages.select("is_ai", "ai_topic", "topic", e.alias("s")).groupBy("is_ai", "ai_topic", "topic", F.col("s.stem").alias("stem")).agg(F.coalesce(F.sum("s.occurrences"), F.lit(0)).alias("occurrence"))
    return ratio_to_total(d, "occurrence", ["is_ai", "ai_topic", "topic"], "p")


def pivoted(words: DataFrame, by: str, values: list[str]) -> DataFrame:
    """stem, and the summed p for each value, 0 where there's none; rounded to 12 digits, so that ties are ties."""
    return words.groupBy("stem").pivot(by, values).agg(F.round(F.sum("p"), 12)).na.fill(0.0, subset=values)


def word_distribution_top(words: DataFrame, n: int = 10_000) -> DataFrame:
    """stem, AI, HUMAN, UNKNOWN of stems among the n of the greatest p in a class, ties too."""
    values = ["AI", "HUMAN", "UNKNOWN"]
    return reach_nth(pivoted(words, "is_ai", values), values, n)
