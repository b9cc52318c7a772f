"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w: u is uniform, from a hash of its id and a
seed, and w is its quality weight. In order of the key, the documents of a source are
a weighted sample without replacement. A source's token budget is its target share of
all tokens. It first takes the whole source as many times as it fits (complete epochs), then
documents in order of the key as long as their summed tokens stay within the rest.

The order within a source is never made in one task: keys fall into intervals, the sums
of tokens by interval give every interval its start, and only rows within an interval are
sorted. A hot source is spread over as many tasks as it has intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, table

SEED = "mix-1"
#: Target weights of sources; others have the weight "*". They are made to sum to 1 over the sources present.
TARGETS = {"src0": 1.0, "src1": 3.0, "src2": 2.0, "src3": 2.0, "*": 1.0}
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}
#: Rows that an interval holds on average.
INTERVAL_ROWS = 4096
_EPS = 1e-9
#: More sources than these are joined by a shuffle.
BROADCAST_ROWS = 100_000


def n_tokens(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def decide(docs: DataFrame, targets: dict[str, float], weights: DataFrame | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_tokens: int | None = None, seed: str = SEED, interval_rows: int = INTERVAL_ROWS) -> DataFrame:
    """What mix_sources() takes: d_id, d_tie (hash of the text), d_source, mix_tokens, mix_key, mix_copies."""
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~"))
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d_id"), F.xxhash64(F.col(text_col)).alias("d_tie"), src.alias("src"), F.col(source_col).alias("d_source"), n_tokens(F.col(text_col)).alias("mix_tokens"))
    if weights is not None:
        ws = weights.groupBy(F.col(id_col).alias("w_id")).agg(F.max("weight").alias("w")).where(F.col("w_id").isNotNull())
        d = d.join(ws, F.col("d_id") == F.col("w_id"), "left").drop("w_id")
    else:
        d = d.withColumn("w", F.lit(None).cast("double"))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("d_id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    d = d.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(1.0))).withColumn("mix_key", -F.log(u) / F.col("w")).drop("w")
    # totals by source: intervals follow the number of rows
    per = d.groupBy("src").agg(F.sum("mix_tokens").alias("total"), F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(targets.get("*", 0.0)))
    for k, v in targets.items():
        if k != "*":
            weight = F.when(F.col("src") == "=" + k, F.lit(float(v))).otherwise(weight)
    allw = Window.partitionBy(F.lit(1))
    size = F.lit(int(total_tokens)) if total_tokens is not None else F.sum("total").over(allw)
    share = F.coalesce(F.try_divide(F.col("share"), F.sum("share").over(allw)), F.lit(0.0))
    per = per.withColumn("share", weight).withColumns({"budget": F.floor(share * size + _EPS)})
    per = per.withColumns({"epochs": F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(F.lit(1)).cast("long"), "intervals": (F.floor(F.col("n") / interval_rows) + 1).cast("long")})
    per = checkpointed(per.withColumn("rest", (F.col("budget") - F.col("epochs") * F.col("total")).cast("long")).select(F.col("src").alias("p_src"), "epochs", "rest", "intervals"))
    few = F.broadcast if per.count() <= BROADCAST_ROWS else (lambda x: x)  # one row per source, counted before it is broadcast
    # exp(-key) is u^(1/w), in (0, 1); its intervals are in reverse order of the key
    step = F.greatest(F.lit(0), F.floor((1 - F.exp(-F.col("mix_key"))) * F.col("intervals"))).cast("long")
    d = d.join(few(per), F.col("src") == F.col("p_src")).withColumn("b", F.least(step, F.col("intervals") - 1))
    sums = d.groupBy("src", "b").agg(F.sum("mix_tokens").alias("bt"))
    before = F.coalesce(F.sum("bt").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("src").alias("s_src"), F.col("b").alias("s_b"), before.alias("start"))
    d = d.join(sums, (F.col("src") == F.col("s_src")) & (F.col("b") == F.col("s_b")))
    within = Window.partitionBy("src", "b").orderBy("mix_key", "d_id", "d_tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.col("start") + F.sum("mix_tokens").over(within))
    d = d.withColumn("mix_copies", F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), F.lit(1)).otherwise(F.lit(0)))
    return d.where(F.col("mix_copies") > 0).select("d_id", "d_tie", "d_source", "src", "mix_tokens", "mix_key", "mix_copies")


def mix_sources(docs: DataFrame, targets: dict[str, float], weights: DataFrame | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents that the mixture takes, with how many copies of each.

    docs keeps all its columns; added are mix_tokens (words), mix_key and mix_copies (at least 1), whose
    names get underscores if docs has them. weights: id_col and a positive "weight", 1 where it's absent,
    null, or not positive. total_tokens: the mixture's size; None: that of docs.

    Whole texts are counted, whatever their length; an empty text has 0 tokens.
    Nulls: a null source is a source of its own, with the weight "*"; a null text has 0 tokens and
    is taken with every epoch, and with the fraction where its key falls. Rows with a null id are dropped, for they have no key.
    Repeated ids share a key; ties are in order of the text's hash. Rows of equal id, source and text are taken together: all or none, and all count.
    Of repeated ids in weights the greatest weight counts. Empty docs give an empty result. A source with no tokens at all takes one epoch.
    """
    names = fresh(docs, "mix_tokens", "mix_key", "mix_copies", "mix_id_", "mix_tie_", "mix_src_", "mix_tie", "mix_src")
    took = decide(docs, targets, weights, id_col=id_col, source_col=source_col, text_col=text_col, **options).dropDuplicates(["d_id", "d_tie", "src"])
    took = took.select(*(F.col(c).alias(n) for c, n in zip(("mix_tokens", "mix_key", "mix_copies", "d_id", "d_tie", "src"), names)))
    d = docs.withColumns({names[6]: F.xxhash64(F.col(text_col)), names[7]: F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~"))})
    out = d.join(took.hint("shuffle_hash"), (F.col(id_col) == F.col(names[3])) & (F.col(names[6]) == F.col(names[4])) & (F.col(names[7]) == F.col(names[5])))
    return out.select(*docs.columns, *names[:3])


def quality_weights(labels: DataFrame) -> DataFrame:
    w = F.lit(QUALITY[None])
    for k, v in QUALITY.items():
        if k is not None:
            w = F.when(F.col("quality") == k, F.lit(v)).otherwise(w)
    return labels.select("doc_id", w.alias("weight"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = decide(table(spark, sf_dir, "documents"), TARGETS, quality_weights(table(spark, sf_dir, "labels")))
    return took.select(F.col("d_id").alias("doc_id"), F.col("d_source").alias("source"), "mix_tokens", "mix_copies")


def sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TARGETS.items() if k != "*")
    return f"""
WITH w AS (SELECT doc_id, max(CASE quality WHEN 1 THEN {QUALITY[1]} WHEN 0 THEN {QUALITY[0]} ELSE {QUALITY[None]} END) AS w FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS mix_tokens,
  -ln((CAST(('0x' || substr(md5('{SEED}|' || d.doc_id), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(w.w, 1.0) AS k
  FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id WHERE d.doc_id IS NOT NULL),
p AS (SELECT source, sum(mix_tokens) AS total, CASE source {cases} ELSE {TARGETS["*"]} END AS share FROM d GROUP BY source),
b AS (SELECT source, total, CAST(floor(share / sum(share) OVER () * sum(total) OVER () + {_EPS}) AS BIGINT) AS budget FROM p),
e AS (SELECT source, total, budget, CASE WHEN total > 0 THEN CAST(budget // total AS BIGINT) ELSE 1 END AS epochs FROM b),
r AS (SELECT d.doc_id, d.source, d.mix_tokens, e.epochs, e.budget - e.epochs * e.total AS rest,
  sum(d.mix_tokens) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, mix_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS mix_copies
FROM r WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""
