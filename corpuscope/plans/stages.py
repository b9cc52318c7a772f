"""Stages that turn crawled pages into a scored, classified table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.relational import first_language

#: Words that tell of the subject, by weight.
WEIGHTS = {w: v for v, ws in {1.0: "ollama llm gpt copilot claude chatgpt ai", 0.9: "openai", 0.8: "geminus", 0.75: "agent", 0.3: "perplexity model integrate", 0.2: "token artificial", 0.1: "productivity powerful performance language intelligence deploy boost"}.items() for w in ws.split()}
TOPIC_THRESHOLD = 1.1
MIN_LANGUAGE, MIN_BYTES, MIN_RECORD = 0.3, 100, 1024


def consolidate(records: DataFrame, detect: Callable = text.languages, extract: Callable = text.main_text) -> DataFrame:
    """host, url, lang, outflow (map of host to links), text, of English pages with text.

    records: content_type, content_length, target_uri, body (HTML as text), as sources.warc gives them. A record without a target, of
    another type, or too short goes. Links count by host, relative ones too.
    """
    r = records.where((F.col("content_type") == "text/html") & (F.col("content_length") >= MIN_RECORD) & F.col("target_uri").isNotNull())
    # a filter over a generator's column isn't pushed below it, where the column's whole expression would be worked out once more for each of its uses
    once = lambda d, c, name: d.select("*", F.stack(F.lit(1), c).alias(name))
    r = once(r.select("target_uri", "body"), extract(F.col("body")), "text").where(F.col("text").isNotNull())
    r = once(r, detect(F.col("text")), "lang").where(F.get("lang", 0)["lang"] == "en")
    r = once(r, F.filter(F.transform(text.hrefs(F.col("body")), lambda h: text.link_host(F.col("target_uri"), h)), lambda h: h.isNotNull()), "_h")
    hosts = F.col("_h")
    r = r.withColumn("_c", text.counted(hosts))
    flow = F.when(F.size(hosts) > 0, F.map_from_entries(F.transform("_c", lambda c: F.struct(c["stem"], c["occurrences"])))).otherwise(F.create_map().cast("map<string,bigint>"))
    return r.select(text.host(F.col("target_uri")).alias("host"), F.col("target_uri").alias("url"), "lang", flow.alias("outflow"), "text")


def stub_scorer(texts: pd.Series) -> pd.DataFrame:
    """A stand-in for a model: the share of distinct words, squashed. Repeats look machine-made."""
    def distinct(text: str) -> float:  # the words of one text at a time
        w = text.split()
        return len(set(w)) / len(w) if w else 1.0

    ai = 1 - texts.fillna("").map(distinct)
    return pd.DataFrame({"predicted_label": ["ai" if a > 0.5 else "human" for a in ai], "human": 1 - ai, "ai": ai})


def score(pages: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame] = stub_scorer, text_col: str = "text") -> DataFrame:
    """pages with predicted_label and label_scores (human, ai). scorer: texts to a frame with predicted_label, human and ai; it's called with whole Arrow batches."""

    @F.pandas_udf("predicted_label string, human double, ai double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield scorer(x)

    return pages.withColumn("_s", run(F.col(text_col))).withColumns({"predicted_label": F.col("_s.predicted_label"), "label_scores": F.struct(F.col("_s.human"), F.col("_s.ai"))}).drop("_s")


def clean(scored: DataFrame) -> DataFrame:
    """root_host, host, url, text, lang_en, ai, outflow of the English pages. lang may be a list, of which the first counts, or a struct."""
    d = first_language(scored).where(F.col("lang.lang") == "en")
    return d.select(text.root_host(F.col("host")).alias("root_host"), "host", "url", "text", F.col("lang.score").alias("lang_en"), F.col("label_scores.ai").alias("ai"), "outflow")


def featurize(cleaned: DataFrame, *, human_lt: float = 0.005, ai_gt: float = 0.9, min_lang: float = MIN_LANGUAGE, min_bytes: int = MIN_BYTES, boilerplate=text.BOILERPLATE, merge_ai: bool = False) -> DataFrame:
    """host, url, text, stems, outflow (list), ai, is_ai of pages in a sure language, with enough text that isn't boilerplate."""
    d = cleaned.where((F.col("lang_en") > min_lang) & (F.octet_length("text") > min_bytes) & ~text.contains_any(F.col("text"), boilerplate))
    flow = F.transform(F.map_entries(F.map_filter("outflow", lambda k, v: v.isNotNull())), lambda e: F.struct(e["key"].alias("url"), e["value"].alias("occurrences")))
    return d.select("host", "url", "text", text.stems(F.col("text"), merge_ai).alias("stems"), flow.alias("outflow"), "ai", text.is_ai(F.col("ai"), human_lt, ai_gt).alias("is_ai"))


def topic_scores(pages: DataFrame, weights: dict[str, float], keys: list[str], entries: str = "stems") -> DataFrame:
    """ai_topic_score by keys: each entry adds its stem's weight, however often it occurs.

    The few weights are a literal map, so that no entry is shuffled before its sum.
    """
    table = F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv))
    own = F.aggregate(F.coalesce(F.col(entries), F.array().cast("array<struct<stem:string,occurrences:bigint>>")), F.lit(0.0), lambda a, e: a + F.coalesce(table[e["stem"]], F.lit(0.0)))
    return pages.groupBy(*keys).agg(F.sum(own).alias("ai_topic_score"))


def enrich(features: DataFrame, *, weights: dict[str, float] | None = None, domains: list[str] | None = None, threshold: float = TOPIC_THRESHOLD, segment: str | None = None) -> DataFrame:
    """features with topic (of the site), ai_topic_score and ai_topic. Pages of one url share the score, within a segment if one is named. A null score or ai becomes 0."""
    keys = [*([segment] if segment else []), "url"]
    scores = topic_scores(features.where(F.col("url").isNotNull()), WEIGHTS if weights is None else weights, keys)
    d = features.withColumn("topic", text.site_type(F.col("url"), domains)).join(scores, keys, "left").na.fill(0.0, subset=["ai_topic_score", "ai"])
    return d.withColumn("ai_topic", F.when(F.col("ai_topic_score") > threshold, "AI").otherwise("NOT_AI"))
