import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import graph, relational
from corpuscope.plans import charts, classify, marts, questions, stages

TOPIC = "struct<NEWS:double,BLOG:double,WIKI:double,SHOP:double>"


def stats(spark, rows):
    return spark.createDataFrame(rows, f"host string, ai double, human double, ai_topic double, topic {TOPIC}, samples long")


@pytest.fixture()
def net(spark):
    s = stats(spark, [("n", 0.9, 0.1, 0.8, (0.9, 0.0, 0.0, 0.0), 1), ("h1", 0.1, 0.9, 0.0, (0.4, 0.6, 0.0, 0.0), 1), ("h2", 0.5, 0.5, 0.0, (0.0, 0.5, 0.5, 0.0), 1), ("h3", 0.2, 0.2, 0.0, (0.0, 0.0, 0.0, 0.0), 1)])
    e = spark.createDataFrame([("n", "h1", 3), ("n", "h2", 5), ("n", "h3", 9), ("n", "n", 100)], "from string, to string, occurrences long")
    return e, s


def test_domain_stats(spark):
    d = spark.createDataFrame([("h", "AI", "AI", "NEWS"), ("h", "HUMAN", "NOT_AI", "NEWSAPI"), ("h", "HUMAN", "NOT_AI", "BLOG"), ("h", "UNKNOWN", "NOT_AI", "UNKNOWN")], "host string, is_ai string, ai_topic string, topic string")
    r = marts.domain_stats(d).first()
    assert (r.ai, r.human, r.ai_topic, r.samples, tuple(r.topic)) == (0.25, 0.5, 0.25, 4, (0.5, 0.25, 0.0, 0.0))


def test_news_flow(net):
    got = {r.topic: r.outflow for r in questions.news_flow(*net, questions.news_predicates()["ai_news"]).collect()}
    assert got == {"BLOG": 5.5, "NEWS": 0.0, "WIKI": 2.5, "SHOP": 0.0}


def test_sankey(net):
    assert [tuple(r) for r in questions.reference_sankey(*net).collect()] == [("NEWS", "BLOG", 2)]
    d = charts.sankey_shares(questions.reference_sankey(*net)).first()
    assert (d.from_total, d.to_total, d.grand_total, d.share) == (2, 2, 2, 1.0)


def test_matrix_total(net):
    m = questions.citation_matrix(*net)
    assert m.count() == 36 * 16
    assert {r.s for r in m.groupBy("x_key", "y_key").agg(F.sum("weight").alias("s")).collect()} == {17}


def test_histogram_bins(spark):
    d = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,)], "v double")
    assert [r[0] for r in d.select(relational.equal_width_bin(F.col("v"), F.lit(0.0), F.lit(1.0), 4)).collect()] == [0, 1, 2, 3]
    assert d.select(relational.equal_width_bin(F.col("v"), F.lit(0.5), F.lit(0.5), 4)).where("1=1").collect()[2][0] == 0


def test_composition(spark):
    s = stats(spark, [("a", 0.6, 0.4, 0.6, (1.0, 0.0, 0.0, 0.0), 1), ("b", 0.5, 0.5, 0.0, (1.0, 0.0, 0.0, 0.0), 1), ("c", 0.4, 0.45, 0.0, (0.0, 0.0, 0.0, 0.0), 1), ("d", 0.2, 0.8, 0.0, (0.0, 1.0, 0.0, 0.0), 1)])
    pages = spark.createDataFrame([("AI", "AI", "NEWSAPI"), ("AI", "AI", "NEWS"), ("HUMAN", "NOT_AI", "BLOG"), ("HUMAN", "NOT_AI", "SHOP")], "is_ai string, ai_topic string, topic string")
    got = {tuple(r)[:3]: (r.url, r.host) for r in questions.composition(pages, s).collect()}
    assert got == {("AI", "AI", "NEWS"): (2, 1), ("HUMAN", "NOT_AI", "BLOG"): (1, 1), ("HUMAN", "NOT_AI", "SHOP"): (1, None)}
    roll = charts.treemap_rollup(questions.composition(pages, s))
    assert roll.where("level = 0").first().value == 4 and abs(roll.where("level = 3").agg(F.sum("of_total")).first()[0] - 1) < 1e-9
    focus = charts.treemap_rollup(questions.composition(pages, s), focus=("HUMAN",)).where("level = 1").first()
    assert (focus.value, focus.of_view, focus.of_total) == (2, 1.0, 0.5)


def test_words(spark):
    d = spark.createDataFrame([("AI", "AI", "NEWS", [("a", 6), ("b", 2)]), ("AI", "AI", "NEWS", []), ("HUMAN", "AI", "BLOG", None)], "is_ai string, ai_topic string, topic string, stems array<struct<stem:string,occurrences:bigint>>")
    got = {(r.is_ai, r.stem): (r.occurrence, r.p) for r in marts.word_distribution(d).collect()}
    assert got == {("AI", "a"): (6, 0.75), ("AI", "b"): (2, 0.25), ("AI", None): (0, 0.0), ("HUMAN", None): (0, None)}
    top = marts.word_distribution_top(marts.word_distribution(d, keep_null_stem=False), 1)
    assert {r.stem for r in top.collect()} == {"a", "b"}  # the other classes have only zeros: all tie
    diff = questions.word_diff(top, 2, 1)
    assert {(r.stem, r.side) for r in diff.collect()} == {("a", "top"), ("b", "bottom")}


def test_topic_score(spark):
    w = {"ai": 1.0, "model": 0.3, "token": 0.2}
    cases = [([("ai", 7), ("model", 2)], 1.3, "AI"), ([("ai", 1)], 1.0, "NOT_AI"), ([("ai", 1), ("ai", 1)], 2.0, "AI"), ([("cat", 1)], 0.0, "NOT_AI"), (None, 0.0, "NOT_AI")]
    d = spark.createDataFrame([(f"http://x.org/{k}", s, None) for k, (s, _, _) in enumerate(cases)], "url string, stems array<struct<stem:string,occurrences:bigint>>, ai double")
    got = stages.enrich(d, weights=w).orderBy("url").collect()
    assert [(round(r.ai_topic_score, 9), r.ai_topic, r.ai) for r in got] == [(s, t, 0.0) for _, s, t in cases]


def test_clean_takes_list_or_struct(spark):
    row = ("www.x.org", "u", "t", 0.8, {"a": 1})
    for kind, lang in (("array<struct<lang:string,score:double>>", [("en", 0.8), ("fr", 0.1)]), ("struct<lang:string,score:double>", ("en", 0.8))):
        d = spark.createDataFrame([(row[0], row[1], row[2], lang, (0.2, 0.8), {"a": 1})], f"host string, url string, text string, lang {kind}, label_scores struct<human:double,ai:double>, outflow map<string,bigint>")
        r = stages.clean(d).first()
        assert (r.root_host, r.lang_en, r.ai) == ("x.org", 0.8, 0.8)


def test_featurize_limits(spark):
    rows = [("a" * 100, 0.9), ("a" * 101, 0.9), ("é" * 51, 0.9), ("a" * 101, 0.3), ("scrapers break the web" + "x" * 100, 0.9)]
    d = spark.createDataFrame([("h", "u", t, s, None, {"x": None, "y": 2}) for t, s in rows], "host string, url string, text string, lang_en double, ai double, outflow map<string,bigint>")
    got = stages.featurize(d).collect()
    assert [r.text for r in got] == ["a" * 101, "é" * 51] and got[0].outflow == [Row(url="y", occurrences=2)] and got[0].is_ai == "UNKNOWN"


def test_sweep_and_classifier(spark):
    d = spark.createDataFrame([("ai ai model",), ("cat",), (None,)], "text string")
    c = classify.TopicClassifier({"ai": 1.0, "model": 0.3}).train(1.1)
    assert [(r.ai_topic_score, r.ai_topic) for r in c.predict(d).collect()] == [(1.3, "AI"), (0.0, "NOT_AI"), (0.0, "NOT_AI")]
    s = spark.createDataFrame([(1.0, True), (2.0, True), (0.0, False), (1.5, False)], "score double, positive boolean")
    got = {r.k: r for r in classify.threshold_sweep(s, n=5).collect()}
    assert (got[0].tpr, got[0].fpr) == (1.0, 1.0) and (got[2].th, got[2].tpr, got[2].fpr) == (1.0, 1.0, 0.5) and (got[4].tpr, got[4].fpr, got[4].precision_balanced) == (0.5, 0.0, 1.0)


def test_link_graph(spark):
    b, other = '["http://b.com/1", "http://b.com/2"]', '["http://z.com/"]'
    rows = [("http://a.com/1", 200, b), ("http://a.com/2", 299, b), ("http://a.com/3", 200, '["http://b.com/"]'), ("http://a.com/4", 200, other), ("http://a.com/5", 199, b), ("http://a.com/6", 300, b), ("http://b.com/", 200, None), ("nowhere", 200, b)]
    d = spark.createDataFrame(rows, "url string, status int, links string")
    assert [tuple(r) for r in graph.link_graph(d).collect()] == [("a.com", "b.com", 0.75)]


def components(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, set()).add(r.node)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("driver_edges", [1000, 0])
def test_scc(spark, driver_edges):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e"), ("f", "a")], "src string, dst string")
    assert components(graph.scc(e, driver_edges)) == {frozenset("ab"), frozenset("cd")}


def test_scc_both_ways_agree(spark):
    r = random.Random(3)
    e = spark.createDataFrame([(r.randrange(25), r.randrange(25)) for _ in range(40)], "src int, dst int")
    a, b = components(graph.scc(e)), components(graph.scc(e, 0))
    assert a == b and a == components(graph.scc(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


def test_relational(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "i int, v double")
    assert {r.i for r in relational.reach_nth(d, ["v"], 1).collect()} == {1, 2}
    assert relational.reach_nth(d, ["v"], 9).count() == 3
    assert relational.nth_largest(d, ["v"], 9).first().v is None
    n = relational.numbered(spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("aé",)], "x string"), "x")
    assert {r.x: r.id for r in n.collect()} == {"a": 0, "aé": 1, "b": 2}
    s = spark.createDataFrame([((1, 2),)], "s struct<a:int,b:int>")
    assert relational.unnest(relational.rename_fields(s, "s", ["x", "y"]), "s").columns == ["x", "y"]


def test_boxplot_dumbbell_proportions(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double")
    r = charts.boxplot(d, "g", "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.high) == (2.0, 3.0, 4.0, 1.0, 4.0, 100.0)
    w = spark.createDataFrame([("x", 0.0, 3.0, 3.0), ("x", 0.0, 1.0, 1.0), ("y", 5.0, 0.0, -5.0), ("..", 9.0, 0.0, -9.0)], "stem string, NOT_AI double, AI double, diff double")
    assert [(r.stem, r.diff) for r in charts.dumbbell(w, 5).collect()] == [("y", -5.0), ("x", 3.0)]
    p = charts.proportions(spark.createDataFrame([("A", 3.0)], "c string, v double"), "c", "v", ["A", "B"])
    assert {r.c: r.share for r in p.collect()} == {"A": 1.0, "B": 0.0}


def test_samples_do_not_depend_on_partitions(spark):
    d = spark.range(500).withColumn("v", F.col("id") * 2)
    got = [{r.id for r in relational.sample_rows(x, 20, seed).collect()} for x, seed in ((d, 1), (d.repartition(7), 1), (d, 2))]
    assert got[0] == got[1] != got[2] and len(got[0]) == 20


def test_news_flows_in_one_pass(net):
    p = questions.news_predicates()
    got = {(r.source, r.topic): r.outflow for r in questions.news_flows(*net, p).collect()}
    assert got == {(k, r.topic): r.outflow for k in p for r in questions.news_flow(*net, p[k]).collect()}


def test_consolidate_works_texts_out_once(spark):
    """The text's expression, its split into words and the links' pattern are in the plan once, not in each filter and column that uses them."""
    d = spark.createDataFrame([("text/html", 2000, "http://a.org/", "<p>the</p>")], "content_type string, content_length int, target_uri string, body string")
    plan = stages.consolidate(d, extract=text.tag_text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<script") == 1 and plan.count("split(") == 1 and plan.count("regexp_extract_all(") == 1
