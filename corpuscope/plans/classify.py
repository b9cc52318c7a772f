"""The keyword classifier and its evaluation over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .stages import TOPIC_THRESHOLD, WEIGHTS


def bag_score(column: Column, weights: dict[str, float] | None = None) -> Column:
    """The sum of the weights of a text's distinct words."""
    table = F.create_map(*(F.lit(x) for kv in sorted((WEIGHTS if weights is None else weights).items()) for x in kv))
    return F.aggregate(F.array_distinct(text.tokens(column)), F.lit(0.0), lambda a, w: a + F.coalesce(table[w], F.lit(0.0)))


class TopicClassifier:
    """score() adds ai_topic_score to texts, predict() adds ai_topic too."""

    def __init__(self, weights: dict[str, float] | None = None, threshold: float = TOPIC_THRESHOLD):
        self.weights, self.threshold = dict(WEIGHTS if weights is None else weights), threshold

    def train(self, threshold: float = TOPIC_THRESHOLD) -> TopicClassifier:
        """The weights are given; training only sets the threshold."""
        self.threshold = threshold
        return self

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.withColumn("ai_topic_score", F.round(bag_score(F.col(text_col), self.weights), 9))

    def predict(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return self.score(df, text_col).withColumn("ai_topic", F.when(F.col("ai_topic_score") > self.threshold, "AI").otherwise("NOT_AI"))


def threshold_sweep(scores: DataFrame, n: int = 100, score: str = "score", positive: str = "positive") -> DataFrame:
    """th, tpr, fpr, precision_balanced (2 tpr / (2 tpr + 2 fpr)) and f1, for n thresholds from 0 to the greatest positive score.

    Scores are counted by value first, so the thresholds meet a small table.
    """
    counts = scores.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    top = counts.where("p > 0").agg(F.max("s").alias("top"))
    ths = top.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "top").select("k", (F.col("k") * F.col("top") / (n - 1)).alias("th"))
    g = F.coalesce(F.col("s") >= F.col("th"), F.lit(False))
    d = counts.crossJoin(F.broadcast(ths)).groupBy("k", "th").agg(F.sum(F.when(g, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(g, F.col("q")).otherwise(0)).alias("fp"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    d = d.select("k", "th", F.try_divide(F.col("tp").cast("double"), F.col("np")).alias("tpr"), F.try_divide(F.col("fp").cast("double"), F.col("nq")).alias("fpr"), F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("np")).alias("f1"))
    return d.withColumn("precision_balanced", F.try_divide(F.col("tpr"), F.col("tpr") + F.col("fpr")))
