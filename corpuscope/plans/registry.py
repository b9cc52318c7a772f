"""All queries of the engine by name, and the SQL that gives the same rows.

The tables at hand hold no links between hosts and no scores of a model, so those are derived from ids by formulas that both sides
share (SCORED, EDGES). Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from ..operators.relational import content_addressed, ratio_to_total, sample_rows, top_and_bottom
from ..streaming import incremental
from . import charts, classify, marts, questions, stages

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOPIC_NAMES = ("NEWS", "BLOG", "WIKI", "SHOP", "NEWSAPI", "UNKNOWN")
HUMAN_LT, AI_GT = 0.4, 0.6
DOC_WEIGHTS = stages.WEIGHTS
#: Of the words: those that reach the n-th value of a class; of these the k of the greatest values; of these the most different on either side.
WORDS_N, DIFF_K, DIFF_SIDE, DISTINCT_K, DISTINCT_SIDE = 10_000, 2000, 1000, 5000, 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_id(id_col: str, host: str | None = None) -> dict:
    """Derived score and classes of a row, from its id; the topic of most pages is that of their host, from the length of its name."""
    i = F.col(id_col)
    at = i if host is None else F.when(i % 5 == 0, i).otherwise(F.coalesce(F.length(host), F.lit(0)))
    topic = F.element_at(F.array(*(F.lit(t) for t in TOPIC_NAMES)), (at % 6 + 1).cast("int"))
    ai = ((i * 7919) % 1000) / 1000.0
    return {"ai": ai, "is_ai": text.is_ai(ai, HUMAN_LT, AI_GT), "ai_topic": F.when(i % 4 == 0, "AI").otherwise("NOT_AI"), "topic": topic}


def _scored(id_col: str, host: str | None = None) -> str:
    at = id_col if host is None else f"(CASE WHEN {id_col} % 5 = 0 THEN {id_col} ELSE coalesce(length({host}), 0) END)"
    cases = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TOPIC_NAMES))
    return f"(({id_col} * 7919) % 1000) / 1000.0 AS ai, CASE WHEN ai < {HUMAN_LT} THEN 'HUMAN' WHEN ai > {AI_GT} THEN 'AI' ELSE 'UNKNOWN' END AS is_ai, CASE WHEN {id_col} % 4 = 0 THEN 'AI' ELSE 'NOT_AI' END AS ai_topic, CASE {at} % 6 {cases} END AS topic"


HOST_SQL = "nullif(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '')"
HREFS_SQL = "unnest(list_filter(list_transform(regexp_extract_all(html, '" + text.HREF.replace("'", "''") + """', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')), lambda x: x <> ''))"""
TAG_TEXT_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
PAGES_SQL = f"px AS (SELECT page_id, host, url, {_scored('page_id', 'host')} FROM (SELECT page_id, {HOST_SQL} AS host, url FROM pages))"
EDGES_SQL = PAGES_SQL + """,
ex AS (SELECT p.page_id, p.host AS src, t.host AS dst, 1 + (p.page_id + k) % 3 AS occurrences FROM px p, unnest(range(1, 6)) AS u(k), (SELECT count(*) AS n FROM px) c, px t WHERE t.page_id = (p.page_id * 7 + k * 13) % c.n),
oe AS (SELECT src, dst, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM ex WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL)"""
STATS_SQL = """st AS (SELECT host, avg(CASE WHEN is_ai = 'AI' THEN 1.0 ELSE 0 END) AS ai, avg(CASE WHEN is_ai = 'HUMAN' THEN 1.0 ELSE 0 END) AS human, avg(CASE WHEN ai_topic = 'AI' THEN 1.0 ELSE 0 END) AS ai_topic,
 count(*) FILTER (topic IN ('NEWS', 'NEWSAPI')) / count(*)::DOUBLE AS NEWS, count(*) FILTER (topic = 'BLOG') / count(*)::DOUBLE AS BLOG, count(*) FILTER (topic = 'WIKI') / count(*)::DOUBLE AS WIKI, count(*) FILTER (topic = 'SHOP') / count(*)::DOUBLE AS SHOP, count(*) AS samples FROM px GROUP BY host)"""
FLOW_SQL = f"WITH {EDGES_SQL}, {STATS_SQL}"
JOINED_SQL = FLOW_SQL + ", j AS (SELECT o.occurrences, s.*, t.host AS host_to, t.ai AS ai_to, t.human AS human_to, t.ai_topic AS ai_topic_to, t.NEWS AS NEWS_to, t.BLOG AS BLOG_to, t.WIKI AS WIKI_to, t.SHOP AS SHOP_to FROM oe o JOIN st s ON o.src = s.host JOIN st t ON o.dst = t.host WHERE o.src <> o.dst)"
WORDS_SQL = f"""dw AS (SELECT {_scored('doc_id')}, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents),
wc AS (SELECT is_ai, ai_topic, topic, stem, count(stem) AS occurrence FROM (SELECT is_ai, ai_topic, topic, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [NULL] END) AS stem FROM dw) GROUP BY ALL),
wd AS MATERIALIZED (SELECT *, occurrence / sum(occurrence) OVER (PARTITION BY is_ai, ai_topic, topic) AS p FROM wc)"""


def _main(suffix: str = "") -> str:
    top = f"greatest(NEWS{suffix}, BLOG{suffix}, WIKI{suffix}, SHOP{suffix})"
    return f"CASE WHEN {top} = 0 THEN 'UNKNOWN' " + " ".join(f"WHEN {top} = {t}{suffix} THEN '{t}'" for t in questions.TOPICS) + " END"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"), "url").withColumns(_by_id("page_id", "host"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with derived outflow: five links each."""
    p = _pages(spark, sf_dir)
    n = p.agg(F.count(F.lit(1)).alias("n"))
    links = p.select("page_id").crossJoin(F.broadcast(n)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))  # n is one row
    links = links.select("page_id", ((F.col("page_id") * 7 + F.col("k") * 13) % F.col("n")).alias("to_id"), (1 + (F.col("page_id") + F.col("k")) % 3).cast("long").alias("occurrences"))
    to = p.select(F.col("page_id").alias("to_id"), F.col("host").alias("to"))
    flow = links.join(to, "to_id").groupBy("page_id").agg(F.collect_list(F.struct(F.col("to").alias("url"), "occurrences")).alias("outflow"))
    return p.join(flow, "page_id", "left")


def _stats(spark, sf_dir) -> DataFrame:
    return marts.domain_stats(_pages(spark, sf_dir))


def _outflow(spark, sf_dir) -> DataFrame:
    return marts.domain_outflow(_linked(spark, sf_dir))


def _words(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents").withColumns(_by_id("doc_id"))
    entries = F.transform(text.tokens(F.lower("text")), lambda w: F.struct(w.alias("stem"), F.lit(1).cast("long").alias("occurrences")))
    return marts.word_distribution(d.withColumn("stems", entries))


def _r(*names: str, digits: int = 6) -> dict:
    return {n: F.round(F.col(n).cast("double"), digits) for n in names}


# --- pages and hosts


@query(f"""
WITH p AS (SELECT {HOST_SQL} AS host, CASE WHEN regexp_matches(url, '/blog/|blog\\.') THEN 'BLOG' WHEN regexp_matches(url, '/wiki|\\.wiki|wiki\\.') THEN 'WIKI' WHEN regexp_matches(url, '/news/|/articles/|articles\\.|news\\.') THEN 'NEWS' WHEN regexp_matches(url, '{text.news_pattern()}') THEN 'NEWSAPI' WHEN regexp_matches(url, '/shop/|shop\\.') THEN 'SHOP' ELSE 'UNKNOWN' END AS topic FROM pages)
SELECT host, count(*) AS samples, round(count(*) FILTER (topic IN ('NEWS', 'NEWSAPI')) / count(*)::DOUBLE, 6) AS news, round(count(*) FILTER (topic = 'BLOG') / count(*)::DOUBLE, 6) AS blog, round(count(*) FILTER (topic = 'WIKI') / count(*)::DOUBLE, 6) AS wiki, round(count(*) FILTER (topic = 'SHOP') / count(*)::DOUBLE, 6) AS shop FROM p GROUP BY host""")
def host_site_type_stats(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select(text.host(F.col("url")).alias("host"), text.site_type(F.col("url")).alias("topic"), F.lit("UNKNOWN").alias("is_ai"), F.lit("NOT_AI").alias("ai_topic"))
    return marts.domain_stats(p).select("host", "samples", *(F.round(f"topic.{t}", 6).alias(t.lower()) for t in questions.TOPICS))


@query(f"WITH {PAGES_SQL}, {STATS_SQL} SELECT host, round(ai, 6) AS ai, round(human, 6) AS human, round(ai_topic, 6) AS ai_topic, round(NEWS, 6) AS news, round(BLOG, 6) AS blog, round(WIKI, 6) AS wiki, round(SHOP, 6) AS shop, samples FROM st")
def domain_stats(spark, sf_dir):
    s = _stats(spark, sf_dir)
    return s.select("host", *(F.round(c, 6).alias(c) for c in ("ai", "human", "ai_topic")), *(F.round(f"topic.{t}", 6).alias(t.lower()) for t in questions.TOPICS), "samples")


@query(f"WITH {EDGES_SQL} SELECT src, dst, occurrences FROM oe")
def host_edges(spark, sf_dir):
    return _outflow(spark, sf_dir).withColumnsRenamed({"from": "src", "to": "dst"})


@query(f"""
WITH l AS (SELECT page_id, url, {HREFS_SQL} AS href FROM pages),
h AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN lower(regexp_extract(href, '^[a-zA-Z]+://([^/:?#]+)', 1)) WHEN regexp_matches(href, '^//') THEN lower(regexp_extract(href, '^//([^/:?#]+)', 1)) WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL ELSE {HOST_SQL} END AS to_host FROM l)
SELECT page_id, to_host, count(*) AS links FROM h WHERE to_host IS NOT NULL GROUP BY ALL""")
def page_links(spark, sf_dir):
    l = _t(spark, sf_dir, "pages").select("page_id", "url", F.explode(text.hrefs(F.col("html"))).alias("href"))
    return l.select("page_id", text.link_host(F.col("url"), F.col("href")).alias("to_host")).where("to_host is not null").groupBy("page_id", "to_host").agg(F.count(F.lit(1)).alias("links"))


@query(f"SELECT page_id, {TAG_TEXT_SQL} AS text FROM pages")
def page_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.tag_text(F.col("html")).alias("text"))


@query()
def main_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.main_text(F.col("html")).alias("text"))


@query(f"""
WITH p AS (SELECT page_id, string_split({HOST_SQL}, '.') AS h FROM pages)
SELECT page_id, CASE WHEN len(h) < 2 THEN array_to_string(h, '.') WHEN array_to_string(h[-2:], '.') IN ({", ".join(f"'{s}'" for s in sorted(text.SUFFIXES))}) THEN array_to_string(h[-3:], '.') ELSE array_to_string(h[-2:], '.') END AS root_host FROM p""")
def root_host(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.root_host(text.host(F.col("url"))).alias("root_host"))


@query(f"""
WITH l AS (SELECT page_id, url, {HREFS_SQL} AS href FROM pages)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || href
 WHEN starts_with(href, '#') THEN regexp_extract(url, '^([^#]*)', 1) || href WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || href ELSE regexp_extract(url, '^([a-zA-Z]+://[^?#]*/)', 1) || href END AS target FROM l""")
def url_join(spark, sf_dir):
    l = _t(spark, sf_dir, "pages").select("page_id", "url", F.explode(text.hrefs(F.col("html"))).alias("href"))
    return l.select("page_id", "href", text.url_join(F.col("url"), F.col("href")).alias("target"))


@query("""
WITH p AS (SELECT page_id, url, unnest(['/index', 'blog', '.com', 'page']) AS pattern FROM pages)
SELECT pattern, page_id FROM p WHERE contains(url, pattern)""")
def substring_theta_join(spark, sf_dir):
    patterns = spark.createDataFrame([(x,) for x in ("/index", "blog", ".com", "page")], "pattern string")
    return _t(spark, sf_dir, "pages").join(F.broadcast(patterns), F.contains("url", "pattern")).select("pattern", "page_id")


@query("SELECT page_id, url FROM pages ORDER BY md5(concat_ws('|', '42', page_id, url)), page_id, url LIMIT 50")
def sample_segments(spark, sf_dir):
    return sample_rows(_t(spark, sf_dir, "pages").select("page_id", "url"), 50, 42)


@query(f"""
WITH {EDGES_SQL}, n AS (SELECT host, count(*) AS pages FROM px GROUP BY host), e AS (SELECT src, dst, count(DISTINCT page_id) AS n FROM ex WHERE dst IS NOT NULL GROUP BY ALL)
SELECT src, dst, round(e.n / n.pages::DOUBLE, 6) AS weight FROM e JOIN n ON e.src = n.host""")
def link_graph(spark, sf_dir):
    return graph.link_graph(_crawl(spark, sf_dir)).withColumns(_r("weight"))


def _crawl(spark, sf_dir) -> DataFrame:
    """Pages in the crawl's old form: status, and links as JSON."""
    return _linked(spark, sf_dir).select("url", F.lit(200).alias("status"), F.to_json(F.transform("outflow", lambda o: F.concat(F.lit("http://"), o["url"], F.lit("/x")))).alias("links"))


REACH_SQL = f"""WITH RECURSIVE {EDGES_SQL}, g AS (SELECT DISTINCT src, dst FROM ex WHERE (page_id + occurrences) % 3 = 1 AND src <> dst),
r(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
s AS (SELECT component, count(*) AS size FROM c GROUP BY component HAVING count(*) > 1)"""


def _scc_edges(spark, sf_dir) -> DataFrame:
    """Links that are k-th of their page where k is 0 modulo 3: a sparser graph, of all pages."""
    e = _linked(spark, sf_dir).select("page_id", F.col("host").alias("src"), F.explode("outflow").alias("o"))
    return e.where((F.col("page_id") + F.col("o.occurrences")) % 3 == 1).select("src", F.col("o.url").alias("dst"))


@query(REACH_SQL + " SELECT node, component, size FROM c JOIN s USING (component)")
def scc(spark, sf_dir):
    return graph.scc(_scc_edges(spark, sf_dir))


@query(REACH_SQL + " SELECT node, component, size FROM c JOIN s USING (component)")
def scc_spread(spark, sf_dir):
    """scc() by the rounds that large graphs take, with nothing collected."""
    return graph.scc(_scc_edges(spark, sf_dir), driver_edges=0)


@query(REACH_SQL + " SELECT DISTINCT src, dst FROM g WHERE src IN (SELECT node FROM c JOIN s USING (component)) AND dst IN (SELECT node FROM c JOIN s USING (component))")
def induced_subgraph(spark, sf_dir):
    e = graph.checkpointed(_scc_edges(spark, sf_dir).where("src <> dst").distinct())
    return graph.induced(e, graph.scc(e))


# --- documents


@query("""
SELECT doc_id, source AS host, CASE lang WHEN 'en' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS lang_en, CAST(((doc_id * 7919) % 1000) / 1000.0 AS DOUBLE) AS ai FROM documents WHERE lang = 'en'""")
def clean_language(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("host"), "text", F.array(F.struct("lang", F.when(F.col("lang") == "en", 0.9).otherwise(0.1).alias("score"))).alias("lang"), F.struct(F.lit(0.0).alias("human"), (((F.col("doc_id") * 7919) % 1000) / 1000.0).alias("ai")).alias("label_scores"), F.create_map().cast("map<string,bigint>").alias("outflow"))
    return stages.clean(d).select(F.col("url").cast("long").alias("doc_id"), "host", "lang_en", "ai")


_BOILER = " AND ".join("NOT contains(text, '" + s.replace("'", "''") + "')" for s in text.BOILERPLATE)


@query(f"SELECT doc_id, {_scored('doc_id')}, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents WHERE CASE lang WHEN 'en' THEN 0.9 ELSE 0.1 END > {stages.MIN_LANGUAGE} AND strlen(text) > {stages.MIN_BYTES} AND {_BOILER}".replace("AS ai,", "AS ai,", 1))
def quality_filters(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where((F.when(F.col("lang") == "en", 0.9).otherwise(0.1) > stages.MIN_LANGUAGE) & (F.octet_length("text") > stages.MIN_BYTES) & ~text.contains_any(F.col("text"), text.BOILERPLATE))
    return d.withColumns(_by_id("doc_id")).select("doc_id", "ai", "is_ai", "ai_topic", "topic", F.octet_length("text").alias("n_bytes"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '[.,\\-—!()\\s]'), lambda x: x = 'ai')) AS BIGINT) AS mentions FROM documents")
def ai_mentions(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.ai_mentions(F.col("text")).alias("mentions"))


TERMS_SQL = "t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS stem FROM documents), dt AS (SELECT doc_id, stem, count(*) AS occurrences FROM t GROUP BY ALL)"


@query(f"WITH {TERMS_SQL} SELECT * FROM dt")
def doc_terms(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens(F.lower("text"))).alias("stem"))
    return d.groupBy("doc_id", "stem").agg(F.count(F.lit(1)).alias("occurrences"))


def _topical(spark, sf_dir, keep: str | None = None) -> DataFrame:
    """Documents with derived words of the subject at their ends, for the invented prose has none: three of the weighted words by id."""
    words, i = F.array(*(F.lit(w) for w in _SUBJECT)), F.col("doc_id")
    at = lambda k: F.element_at(words, (k % len(_SUBJECT) + 1).cast("int"))
    d = _t(spark, sf_dir, "documents")
    return (d if keep is None else d.withColumn(keep, F.col("text"))).withColumn("text", F.concat_ws(" ", F.coalesce("text", F.lit("")), at(i), at(i * 7), F.concat(at(F.floor(i / 3)), F.lit("s"))))


_SUBJECT = sorted(stages.WEIGHTS)
_AT = lambda k: "[" + ", ".join(f"'{w}'" for w in _SUBJECT) + f"][{k} % {len(_SUBJECT)} + 1]"
TOPICAL_SQL = f"td AS (SELECT * REPLACE (concat_ws(' ', coalesce(text, ''), {_AT('doc_id')}, {_AT('doc_id * 7')}, {_AT('doc_id // 3')} || 's') AS text) FROM documents)"


def _stems_sql(table: str, name: str = "ds") -> str:
    """Lemma counts of a table's texts, and one more entry for standing-alone "ai"."""
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.IRREGULAR.items())
    lemma = f"CASE w {irregular} ELSE CASE WHEN regexp_matches(w, '^[a-z]{{3,}}ies$') THEN w[:-4] || 'y' WHEN regexp_matches(w, '(?:ss|x|ch|sh)es$') THEN w[:-3] WHEN regexp_matches(w, '^[a-z]{{2,}}[^su]s$') THEN w[:-2] ELSE w END END"
    words = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))"
    mentions = "len(list_filter(string_split_regex(lower(text), '[.,\\-—!()\\s]'), lambda x: x = 'ai'))"
    return f"{name} AS MATERIALIZED (SELECT doc_id, stem, count(*) AS occurrences FROM (SELECT doc_id, {lemma} AS stem FROM (SELECT doc_id, {words} AS w FROM {table})) GROUP BY ALL UNION ALL SELECT doc_id, 'ai', CAST({mentions} AS BIGINT) FROM {table} WHERE {mentions} > 0)"


@query(f"WITH {_stems_sql('documents')} SELECT d.doc_id, stem, occurrences FROM documents d LEFT JOIN ds ON d.doc_id = ds.doc_id")
def doc_stems(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.inline_outer(text.stems(F.col("text"))))


_WEIGHTS_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in DOC_WEIGHTS.items()) + ") AS v(stem, weight))"


SCORES_SQL = f"{TOPICAL_SQL}, {_stems_sql('td')}, {_WEIGHTS_SQL}, s AS (SELECT doc_id, sum(weight) AS score FROM ds JOIN w USING (stem) GROUP BY doc_id)"


@query(f"""
WITH {SCORES_SQL}
SELECT doc_id, round(coalesce(score, 0), 6) AS ai_topic_score, CASE WHEN round(coalesce(score, 0), 9) > {stages.TOPIC_THRESHOLD} THEN 'AI' ELSE 'NOT_AI' END AS ai_topic FROM documents LEFT JOIN s USING (doc_id)""")
def topic_score(spark, sf_dir):
    scores = _topic_scores(spark, sf_dir)
    return scores.select("doc_id", F.round("ai_topic_score", 6).alias("ai_topic_score"), F.when(F.col("ai_topic_score") > stages.TOPIC_THRESHOLD, "AI").otherwise("NOT_AI").alias("ai_topic"))


def _topic_scores(spark, sf_dir, *more: str) -> DataFrame:
    """The weighted stems' scores of all documents, rounded to 9 digits."""
    d = _topical(spark, sf_dir).select("doc_id", *more, text.stems(F.col("text")).alias("stems"))
    return stages.topic_scores(d, DOC_WEIGHTS, ["doc_id", *more]).withColumn("ai_topic_score", F.round("ai_topic_score", 9))


BAG_SQL = f"{TOPICAL_SQL}, {_WEIGHTS_SQL}, b AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS stem FROM td), bs AS (SELECT d.doc_id, round(coalesce(s, 0), 9) AS score FROM documents d LEFT JOIN (SELECT doc_id, sum(weight) AS s FROM b JOIN w USING (stem) GROUP BY doc_id) x ON d.doc_id = x.doc_id)"


@query(f"WITH {BAG_SQL} SELECT doc_id, round(score, 6) AS ai_topic_score, CASE WHEN score > {stages.TOPIC_THRESHOLD} THEN 'AI' ELSE 'NOT_AI' END AS ai_topic FROM bs")
def bag_score(spark, sf_dir):
    d = classify.TopicClassifier(DOC_WEIGHTS).predict(_topical(spark, sf_dir))
    return d.select("doc_id", F.round("ai_topic_score", 6).alias("ai_topic_score"), "ai_topic")


@query(f"""
WITH {BAG_SQL}, x AS (SELECT score, quality = 1 AS pos FROM bs JOIN labels USING (doc_id)), m AS (SELECT max(score) AS top FROM x WHERE pos),
t AS (SELECT k, k * top / 99 AS th FROM m, unnest(range(0, 100)) AS u(k)),
c AS (SELECT k, th, sum(CASE WHEN pos AND score >= th THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT pos AND score >= th THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN pos THEN 1 ELSE 0 END) AS np, sum(CASE WHEN pos THEN 0 ELSE 1 END) AS nq FROM t, x GROUP BY k, th)
SELECT CAST(k AS INTEGER) AS k, round(th, 6) AS th, round(tp / np::DOUBLE, 6) AS tpr, round(fp / nullif(nq, 0)::DOUBLE, 6) AS fpr, round(2.0 * tp / nullif(tp + fp + np, 0), 6) AS f1, round((tp / np::DOUBLE) / nullif(tp / np::DOUBLE + fp / nullif(nq, 0)::DOUBLE, 0), 6) AS precision_balanced FROM c""")
def threshold_sweep(spark, sf_dir):
    s = classify.TopicClassifier(DOC_WEIGHTS).score(_topical(spark, sf_dir)).join(_t(spark, sf_dir, "labels"), "doc_id")
    out = classify.threshold_sweep(s.select(F.col("ai_topic_score").alias("score"), (F.col("quality") == 1).alias("positive")))
    return out.withColumns(_r("th", "tpr", "fpr", "f1", "precision_balanced"))


@query(f"WITH {WORDS_SQL} SELECT is_ai, ai_topic, topic, stem, CAST(occurrence AS BIGINT) AS occurrence, round(p, 9) AS p FROM wd")
def word_distribution(spark, sf_dir):
    return _words(spark, sf_dir).withColumns(_r("p", digits=9))


def _pivot_sql(by: str, values: list[str]) -> str:
    cols = ", ".join(f"round(coalesce(sum(p) FILTER ({by} = '{v}'), 0), 12) AS {v}" for v in values)
    ranks = ", ".join(f"rank() OVER (ORDER BY {v} DESC) AS r{k}" for k, v in enumerate(values))
    keep = " OR ".join(f"r{k} <= {WORDS_N}" for k in range(len(values)))
    return f"pv AS (SELECT stem, {cols} FROM wd GROUP BY stem), wt AS MATERIALIZED (SELECT * FROM (SELECT *, {ranks} FROM pv) WHERE {keep})"


TOP_SQL = f"WITH {WORDS_SQL}, {_pivot_sql('is_ai', ['AI', 'HUMAN', 'UNKNOWN'])}"


@query(TOP_SQL + " SELECT stem, round(AI, 9) AS ai, round(HUMAN, 9) AS human, round(UNKNOWN, 9) AS unknown FROM wt")
def word_top(spark, sf_dir):
    t = marts.word_distribution_top(_words(spark, sf_dir), WORDS_N)
    return t.select("stem", *(F.round(c, 9).alias(c.lower()) for c in ("AI", "HUMAN", "UNKNOWN")))


def _diff_sql(a: str, b: str, k: int, side: int, extra: str = "") -> str:
    return f", tk AS (SELECT * FROM wt ORDER BY greatest({a}, {b}) DESC, stem LIMIT {k}), df AS (SELECT stem, {a}, {b}, round({a} - {b}, 12) AS diff FROM tk {extra}), tb AS (SELECT *, 'top' AS side FROM (SELECT * FROM df ORDER BY diff DESC, stem LIMIT {side}) UNION ALL SELECT *, 'bottom' FROM (SELECT * FROM df ORDER BY diff, stem LIMIT {side}))"


@query(TOP_SQL + _diff_sql("AI", "HUMAN", DIFF_K, DIFF_SIDE) + " SELECT stem, round(AI, 9) AS ai, round(HUMAN, 9) AS human, round(diff, 9) AS diff, side FROM tb")
def word_diff(spark, sf_dir):
    d = questions.word_diff(marts.word_distribution_top(_words(spark, sf_dir), WORDS_N), DIFF_K, DIFF_SIDE)
    return d.select("stem", F.round("AI", 9).alias("ai"), F.round("HUMAN", 9).alias("human"), F.round("diff", 9).alias("diff"), "side")


DISTINCT_SQL = f"WITH {WORDS_SQL}, {_pivot_sql('ai_topic', ['NOT_AI', 'AI'])}" + _diff_sql("AI", "NOT_AI", DISTINCT_K, DISTINCT_SIDE, "WHERE NOT regexp_matches(stem, '[,=:(]')")


@query(DISTINCT_SQL + " SELECT stem, round(AI, 9) AS ai, round(NOT_AI, 9) AS not_ai, round(diff, 9) AS diff, side FROM tb")
def distinguishing_words(spark, sf_dir):
    d = questions.distinguishing_words(_words(spark, sf_dir), WORDS_N, DISTINCT_K, DISTINCT_SIDE)
    return d.select("stem", F.round("AI", 9).alias("ai"), F.round("NOT_AI", 9).alias("not_ai"), F.round("diff", 9).alias("diff"), "side")


@query(DISTINCT_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY abs(diff) DESC, diff DESC) AS k FROM tb WHERE NOT regexp_matches(stem, '^[^a-zA-Z0-9]+$')) SELECT stem, round(AI, 9) AS ai, round(NOT_AI, 9) AS not_ai, round(diff, 9) AS diff FROM o WHERE k = 1 ORDER BY abs(o.diff) DESC, stem LIMIT 20")
def dumbbell_merge(spark, sf_dir):
    d = charts.dumbbell(questions.distinguishing_words(_words(spark, sf_dir), WORDS_N, DISTINCT_K, DISTINCT_SIDE))
    return d.select("stem", F.round("AI", 9).alias("ai"), F.round("NOT_AI", 9).alias("not_ai"), F.round("diff", 9).alias("diff"))


@query(f"""
WITH {SCORES_SQL}, d AS (SELECT lang, round(coalesce(score, 0), 9) AS v FROM documents LEFT JOIN s USING (doc_id)),
q AS (SELECT lang, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, avg(v) AS mean, min(v) AS low, max(v) AS high, count(*) AS n FROM d GROUP BY lang)
SELECT q.lang, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(mean), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, any_value(n) AS n, round(min(v), 6) AS whisker_low, round(max(v), 6) AS whisker_high
FROM q JOIN d ON q.lang = d.lang AND v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY q.lang""")
def score_boxplot(spark, sf_dir):
    d = _topic_scores(spark, sf_dir, "lang").withColumnRenamed("ai_topic_score", "v")
    return charts.boxplot(d, "lang", "v").withColumns(_r("q1", "median", "q3", "mean", "low", "high", "whisker_low", "whisker_high"))


@query("SELECT md5(text) AS name, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_groups(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.md5("text").alias("name")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@query("SELECT DISTINCT md5(text) AS name FROM documents")
def content_hash_dedupe(spark, sf_dir):
    return content_addressed(_t(spark, sf_dir, "documents").select("text"), "text").select("name")


def _languages_sql() -> str:
    """The two best languages by their shares of stop words, of equal ones the name that is last."""
    of = lambda k, ws: f"{{'score': len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in ws.split())}))) / greatest(len(w), 1)::DOUBLE, 'lang': '{k}'}}"
    return "list_sort([" + ", ".join(of(k, ws) for k, ws in sorted(text.STOPWORDS.items())) + "], 'DESC')"


@query(f"""
WITH r AS (SELECT page_id, url, html, {HOST_SQL} AS host, {TAG_TEXT_SQL} AS text FROM pages WHERE page_id % 7 <> 0 AND strlen(html) >= {stages.MIN_RECORD} AND url IS NOT NULL),
l AS (SELECT * EXCLUDE (w), {_languages_sql()}[1] AS l FROM (SELECT *, coalesce(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), []) AS w FROM r)),
h AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN lower(regexp_extract(href, '^[a-zA-Z]+://([^/:?#]+)', 1)) WHEN regexp_matches(href, '^//') THEN lower(regexp_extract(href, '^//([^/:?#]+)', 1)) WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL ELSE host END AS to_host FROM (SELECT page_id, host, {HREFS_SQL} AS href FROM r)),
n AS (SELECT page_id, count(DISTINCT to_host) AS n_hosts, count(*) AS n_links FROM h WHERE to_host IS NOT NULL GROUP BY page_id)
SELECT host, url, round(l.score, 6) AS lang_score, CAST(coalesce(n_hosts, 0) AS INTEGER) AS n_hosts, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, length(text) AS n_text FROM l LEFT JOIN n USING (page_id) WHERE l.lang = 'en'""")
def consolidated_pages(spark, sf_dir):
    """Archive records to English pages with text and links; the records' headers are derived, every seventh is of another type. The text is that by expressions, which SQL can give too."""
    kind = F.when(F.col("page_id") % 7 != 0, "text/html").otherwise("text/plain")
    records = _t(spark, sf_dir, "pages").select(kind.alias("content_type"), F.octet_length("html").alias("content_length"), F.col("url").alias("target_uri"), F.col("html").alias("body"))
    d = stages.consolidate(records, extract=text.tag_text)
    links = F.aggregate(F.map_values("outflow"), F.lit(0).cast("long"), lambda a, n: a + n)
    return d.select("host", "url", F.round(F.get("lang", 0)["score"], 6).alias("lang_score"), F.size("outflow").alias("n_hosts"), links.alias("n_links"), F.length("text").cast("long").alias("n_text"))


@query(f"WITH d AS (SELECT doc_id, lang, coalesce(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), []) AS w FROM documents), l AS (SELECT doc_id, lang, {_languages_sql()} AS l FROM d) SELECT doc_id, lang, l[1].lang AS first, round(l[1].score, 6) AS first_score, l[2].lang AS second, round(l[2].score, 6) AS second_score FROM l")
def lang_id(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", text.languages(F.col("text")).alias("l"))
    return d.select("doc_id", "lang", F.get("l", 0)["lang"].alias("first"), F.get("l", 0)["score"].alias("first_score"), F.get("l", 1)["lang"].alias("second"), F.get("l", 1)["score"].alias("second_score"))


AI_SQL = "ws AS (SELECT doc_id, coalesce(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), []) AS w FROM documents), sc AS (SELECT doc_id, 1 - CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 1 END AS ai FROM ws)"


@query(f"WITH {AI_SQL} SELECT doc_id, CASE WHEN ai > 0.5 THEN 'ai' ELSE 'human' END AS predicted_label, round(ai, 6) AS ai, round(1 - ai, 6) AS human FROM sc")
def ai_scorer(spark, sf_dir):
    d = stages.score(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "predicted_label", F.round("label_scores.ai", 6).alias("ai"), F.round("label_scores.human", 6).alias("human"))


@query(f"""
WITH {AI_SQL}, {TOPICAL_SQL}, fd AS (SELECT td.*, ai FROM td JOIN sc USING (doc_id) WHERE lang = 'en' AND strlen(text) > {stages.MIN_BYTES} AND {_BOILER}), {_stems_sql('fd')}, {_WEIGHTS_SQL},
n AS (SELECT doc_id, count(*) AS n_stems, sum(weight) AS score FROM ds LEFT JOIN w USING (stem) GROUP BY doc_id)
SELECT 'http://' || source || '.example.com/' || doc_id AS url, source || '.example.com' AS host, CASE WHEN ai < 0.005 THEN 'HUMAN' WHEN ai > 0.9 THEN 'AI' ELSE 'UNKNOWN' END AS is_ai, 'UNKNOWN' AS topic, CASE WHEN round(coalesce(score, 0), 9) > {stages.TOPIC_THRESHOLD} THEN 'AI' ELSE 'NOT_AI' END AS ai_topic, round(coalesce(score, 0), 6) AS ai_topic_score, CAST(n_stems AS INTEGER) AS n_stems FROM fd JOIN n USING (doc_id)""")
def pipeline_features(spark, sf_dir):
    """The stages from scoring to classes, one after the other, over documents."""
    d = _scored_topical(spark, sf_dir).select(F.concat(F.lit("http://"), "source", F.lit(".example.com/"), "doc_id").alias("url"), F.concat("source", F.lit(".example.com")).alias("host"), "text", "label_scores", F.array(F.struct("lang", F.lit(0.9).alias("score"))).alias("lang"), F.create_map().cast("map<string,bigint>").alias("outflow"))
    e = stages.enrich(stages.featurize(stages.clean(d)))
    e = e.withColumn("ai_topic", F.when(F.round("ai_topic_score", 9) > stages.TOPIC_THRESHOLD, "AI").otherwise("NOT_AI"))
    return e.select("url", "host", "is_ai", "topic", "ai_topic", F.round("ai_topic_score", 6).alias("ai_topic_score"), F.size("stems").alias("n_stems"))


def _scored_topical(spark, sf_dir) -> DataFrame:
    """The model's scores go by the texts, the stems by the texts with the derived words."""
    d = stages.score(_topical(spark, sf_dir, keep="plain"), text_col="plain")
    return d.drop("plain")


# --- questions over hosts


_BIN = "CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({v} - {lo}) / ({hi} - {lo}) * 4), 3) END"


def _matrix_sql() -> str:
    ends = [k + s for s in ("", "_to") for k in questions.KEYS]
    lim = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in ends)
    parts = " UNION ALL ".join(f"SELECT '{a}' AS x_key, '{b}' AS y_key, CAST({_BIN.format(v=a, lo=f'lo_{a}', hi=f'hi_{a}')} AS INTEGER) AS x, CAST({_BIN.format(v=b + '_to', lo=f'lo_{b}_to', hi=f'hi_{b}_to')} AS INTEGER) AS y, occurrences AS w FROM j, lim" for a in questions.KEYS for b in questions.KEYS)
    keys = ", ".join(f"'{k}'" for k in questions.KEYS)
    return JOINED_SQL + f""", lim AS (SELECT {lim} FROM j), b AS ({parts}), m AS (SELECT x_key, y_key, x, y, sum(w) AS w FROM b GROUP BY ALL),
grid AS (SELECT a AS x_key, c AS y_key, CAST(i AS INTEGER) AS x, CAST(k AS INTEGER) AS y FROM unnest([{keys}]) AS ka(a), unnest([{keys}]) AS kb(c), unnest(range(0, 4)) AS ki(i), unnest(range(0, 4)) AS kk(k)),
mx AS (SELECT x_key, y_key, x, y, CAST(coalesce(w, 0) AS BIGINT) AS weight FROM grid LEFT JOIN m USING (x_key, y_key, x, y))"""


@query(_matrix_sql() + " SELECT * FROM mx")
def citation_matrix(spark, sf_dir):
    return questions.citation_matrix(_outflow(spark, sf_dir), _stats(spark, sf_dir))


@query(_matrix_sql() + " SELECT *, round(weight / nullif(sum(weight) OVER (PARTITION BY x_key, y_key, x), 0)::DOUBLE, 6) AS of_x, round(weight / nullif(sum(weight) OVER (PARTITION BY x_key, y_key, y), 0)::DOUBLE, 6) AS of_y, round(weight / nullif(sum(weight) OVER (PARTITION BY x_key, y_key), 0)::DOUBLE, 6) AS of_all FROM mx")
def matrix_fractions(spark, sf_dir):
    return charts.matrix_fractions(citation_matrix(spark, sf_dir)).withColumns(_r("of_x", "of_y", "of_all"))


_FLOWS = {"ai_news": "ai > 0.7 AND NEWS > 0.7", "human_news": "ai < 0.3 AND NEWS > 0.7", "ai_topic_news": "ai_topic > 0.7 AND NEWS > 0.7", "non_ai_topic_news": "ai_topic < 0.3 AND NEWS > 0.7"}


def _flow_sql() -> str:
    top = "greatest(NEWS_to, BLOG_to, WIKI_to, SHOP_to)"
    ties = " + ".join(f"CASE WHEN {t}_to = {top} THEN 1.0 ELSE 0 END" for t in questions.TOPICS)
    return " UNION ALL ".join(f"SELECT '{name}' AS source, '{t}' AS topic, round(coalesce(sum(CASE WHEN {top} > 0 AND {t}_to = {top} THEN occurrences / ({ties}) ELSE 0 END), 0)::DOUBLE, 6) AS outflow FROM j WHERE {cond}" for name, cond in _FLOWS.items() for t in questions.TOPICS)


@query(JOINED_SQL + " " + _flow_sql())
def news_flow(spark, sf_dir):
    return questions.news_flows(_outflow(spark, sf_dir), _stats(spark, sf_dir), questions.news_predicates()).withColumns(_r("outflow"))


@query(JOINED_SQL + f", f AS ({_flow_sql()}) SELECT topic, outflow, round(coalesce(outflow / nullif(sum(outflow) OVER (), 0), 0), 6) AS share, CASE topic WHEN 'BLOG' THEN 0 WHEN 'NEWS' THEN 1 WHEN 'WIKI' THEN 2 ELSE 3 END AS position FROM f WHERE source = 'human_news'")
def proportions(spark, sf_dir):
    flow = news_flow(spark, sf_dir).where("source = 'human_news'")
    return charts.proportions(flow, "topic", "outflow", ["BLOG", "NEWS", "WIKI", "SHOP"]).select("topic", "outflow", F.round("share", 6).alias("share"), "position")


@query(FLOW_SQL + ", l AS (" + " UNION ALL ".join(f"SELECT '{t}' AS topic, ai_topic, {t} AS v FROM st" for t in questions.TOPICS) + ") SELECT topic, round(avg(ai_topic), 6) AS mean_buzzword, round(avg(v), 6) AS mean_topic FROM l WHERE v > 0.25 GROUP BY topic")
def buzzword_usage(spark, sf_dir):
    return questions.buzzword_usage(_stats(spark, sf_dir)).withColumns(_r("mean_buzzword", "mean_topic"))


SANKEY_SQL = JOINED_SQL + f', k AS (SELECT {_main()} AS "from", {_main("_to")} AS "to" FROM j), sk AS (SELECT "from", "to", count(*) AS len FROM k WHERE "from" <> \'UNKNOWN\' AND "to" <> \'UNKNOWN\' GROUP BY ALL)'


@query(SANKEY_SQL + " SELECT * FROM sk")
def reference_sankey(spark, sf_dir):
    return questions.reference_sankey(_outflow(spark, sf_dir), _stats(spark, sf_dir))


@query(SANKEY_SQL + ' SELECT "from", "to", len, CAST(sum(len) OVER (PARTITION BY "from") AS BIGINT) AS from_total, CAST(sum(len) OVER (PARTITION BY "to") AS BIGINT) AS to_total, CAST(sum(len) OVER () AS BIGINT) AS grand_total, round(len / sum(len) OVER (PARTITION BY "from"), 6) AS share FROM sk WHERE "from" <> "to"')
def sankey_shares(spark, sf_dir):
    return charts.sankey_shares(reference_sankey(spark, sf_dir)).withColumns(_r("share"))


COMP_SQL = f"""WITH {PAGES_SQL}, {STATS_SQL}, u AS (SELECT is_ai, ai_topic, CASE topic WHEN 'NEWSAPI' THEN 'NEWS' ELSE topic END AS topic, count(*) AS url FROM px GROUP BY ALL),
h AS (SELECT CASE WHEN ai > human AND ai > 0.5 THEN 'AI' WHEN ai < human AND human > 0.5 THEN 'HUMAN' ELSE 'UNKNOWN' END AS is_ai, CASE WHEN ai_topic > 0.5 THEN 'AI' ELSE 'NOT_AI' END AS ai_topic, {_main()} AS topic FROM st),
hc AS (SELECT is_ai, ai_topic, topic, count(*) AS host FROM h GROUP BY ALL), cp AS (SELECT u.is_ai, u.ai_topic, u.topic, url, host FROM u LEFT JOIN hc USING (is_ai, ai_topic, topic))"""


@query(COMP_SQL + " SELECT * FROM cp")
def composition(spark, sf_dir):
    return questions.composition(_pages(spark, sf_dir), _stats(spark, sf_dir))


@query(COMP_SQL + """, r AS (SELECT is_ai, ai_topic, topic, CAST(sum(url) AS BIGINT) AS value, CASE grouping(is_ai, ai_topic, topic) WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS level FROM cp GROUP BY ROLLUP (is_ai, ai_topic, topic))
SELECT level, is_ai, ai_topic, topic, value, round(value / (SELECT sum(url) FROM cp)::DOUBLE, 6) AS of_view, round(value / (SELECT sum(url) FROM cp)::DOUBLE, 6) AS of_total FROM r""")
def treemap_rollup(spark, sf_dir):
    return charts.treemap_rollup(composition(spark, sf_dir)).withColumns(_r("of_view", "of_total"))


# --- plain operators over the other tables


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    return _t(spark, sf_dir, "events").select("event_id", F.explode(m).alias("key", "value"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def ratio_to_order(spark, sf_dir):
    d = ratio_to_total(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_orderkey"], "share")
    return d.select("l_orderkey", "l_linenumber", F.round("share", 6).alias("share"))


@query("SELECT * FROM (SELECT c_custkey, c_acctbal, 'top' AS side FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25) UNION ALL SELECT * FROM (SELECT c_custkey, c_acctbal, 'bottom' FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25)")
def top_bottom_customers(spark, sf_dir):
    return top_and_bottom(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 25, "c_custkey")


@query("SELECT o_orderpriority, " + ", ".join(f"CAST(count(*) FILTER (o_orderstatus = '{s}') AS BIGINT) AS {s.lower()}_orders" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_orders(spark, sf_dir):
    p = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", list("FOP")).count().na.fill(0)
    return p.withColumnsRenamed({s: f"{s.lower()}_orders" for s in "FOP"})


@query("SELECT n_name, r_name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def nation_customers(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    d = n.join(_t(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name")
    return d.agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
def line_summary(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT min(l_quantity) AS lq, max(l_quantity) AS hq, min(l_discount) AS ld, max(l_discount) AS hd FROM lineitem)
SELECT CAST(least(floor((l_quantity - lq) / (hq - lq) * 10), 9) AS INTEGER) AS x, CAST(least(floor((l_discount - ld) / (hd - ld) * 5), 4) AS INTEGER) AS y, round(sum(l_extendedprice), 2) AS weight FROM lineitem, b GROUP BY 1, 2""")
def line_histogram(spark, sf_dir):
    from ..operators.relational import equal_width_bin

    d = _t(spark, sf_dir, "lineitem")
    lim = d.agg(F.min("l_quantity").alias("lq"), F.max("l_quantity").alias("hq"), F.min("l_discount").alias("ld"), F.max("l_discount").alias("hd"))
    d = d.crossJoin(F.broadcast(lim))  # one row
    return d.groupBy(equal_width_bin(F.col("l_quantity"), F.col("lq"), F.col("hq"), 10).alias("x"), equal_width_bin(F.col("l_discount"), F.col("ld"), F.col("hd"), 5).alias("y")).agg(F.round(F.sum("l_extendedprice"), 2).alias("weight"))


@query("SELECT page_id, url FROM pages")
def incremental_pages(spark, sf_dir):
    """Pages through the incremental reader, as its first run sees them."""
    return incremental.read_new(spark, f"{sf_dir}/pages.parquet").select("page_id", "url")


@query("SELECT count(*) AS n_pages, count(DISTINCT url) AS n_urls FROM pages")
def row_counts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("url").alias("n_urls"))
