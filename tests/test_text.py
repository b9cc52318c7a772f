import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.plans import stages


def col(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in d.orderBy("i").select(f(F.col("v"))).collect()]


def test_site_type(spark):
    cases = {"https://blog.x.org/wiki/a": "BLOG", "https://x.wiki/": "WIKI", "https://foxnews.com/a": "NEWS", "https://time.com/a": "NEWSAPI", "https://cumintime.com/a": "UNKNOWN", "https://shop.x.org/": "SHOP", "https://x.org/shop": "UNKNOWN", None: "UNKNOWN"}
    assert col(spark, list(cases), text.site_type) == list(cases.values())


def test_is_ai(spark):
    assert col(spark, [0.0049, 0.005, 0.9, 0.901, None], text.is_ai, "double") == ["HUMAN", "UNKNOWN", "UNKNOWN", "AI", "UNKNOWN"]


def test_ai_mentions(spark):
    cases = {"AI": 1, "ai ai ai": 3, "AI\nis AI, (ai)": 3, "mail ai-based": 1, "foo ai bar": 1, "": 0, None: 0}
    assert col(spark, list(cases), text.ai_mentions) == list(cases.values())


def test_link_domain(spark):
    cases = {"http://a.com/x?y": "a.com", "http://a.com/p//q/r": "q", "http://a.com:80/": "a.com:80", "nothing": None, None: None}
    assert col(spark, list(cases), text.link_domain) == list(cases.values())


def test_host(spark):
    cases = {"https://User@Www.A.com:8080/x": "www.a.com", "not a url": None, "http://[bad": None, None: None}
    assert col(spark, list(cases), text.host) == list(cases.values())


def test_root_host(spark):
    cases = {"a.b.co.uk": "b.co.uk", "www.x.org": "x.org", "localhost": "localhost", None: None}
    assert col(spark, list(cases), text.root_host) == list(cases.values())


def test_counted_and_stems(spark):
    got = col(spark, ["b a b"], lambda c: text.counted(text.tokens(c)))[0]
    assert [(r.stem, r.occurrences) for r in got] == [("a", 1), ("b", 2)]
    got = {(r.stem, r.occurrences) for r in col(spark, ["Cats, AI and cities."], text.stems)[0]}
    assert {("cat", 1), ("city", 1), (",", 1), (".", 1), ("ai", 1)} <= got
    assert col(spark, ["ai!"], text.stems)[0].count(("ai", 1)) == 2  # equal keys stay apart
    assert col(spark, ["ai!"], lambda c: text.stems(c, merge_ai=True))[0].count(("ai", 1)) == 1
    assert col(spark, ["", None], text.stems) == [[], []]


def test_stems_take_no_object_for_each_entry():
    """A batch's entries are never held as Python objects all at once: of 500,000 they took over 100 MB."""
    x = pa.array([" ".join(f"w{i}x{k}" for k in range(500)) for i in range(1000)] + [None, ""])
    tracemalloc.start()
    out = text.stem_counts(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1002 and len(out.flatten()) == 500_000 and out[1000].as_py() == out[1001].as_py() == []
    assert peak < 60e6, peak


def test_scorer_takes_one_text_at_a_time():
    """Words of a batch's texts aren't held all at once: 2,000,000 words took over 100 MB."""
    x = pd.Series([" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(1000)] + [None, "", "a a a b"])
    tracemalloc.start()
    out = stages.stub_scorer(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["ai"].tolist() == [0.0] * 1002 + [0.5] and peak < 20e6, peak


def test_hrefs_and_link_hosts(spark):
    html = '<a class="k" href="/x">1</a><a href="">2</a><a href="http://B.com/y">3</a><a href="//c.org">4</a><a href="mailto:q@r">5</a>'
    d = spark.createDataFrame([("https://A.com/p", html)], "base string, html string").select("base", F.explode(text.hrefs(F.col("html"))).alias("h"))
    assert [r[0] for r in d.select(text.link_host(F.col("base"), F.col("h"))).collect()] == ["a.com", "b.com", "c.org", None]
    assert [r[0] for r in d.select(text.url_join(F.col("base"), F.col("h"))).collect()][:2] == ["https://A.com/x", "http://B.com/y"]


def test_main_text(spark):
    html = "<html><head><title>t</title></head><body><nav>menu</nav><p>One  two.</p><p>One two.</p><script>x</script><p>Three</p></body></html>"
    assert col(spark, [html, "", None], text.main_text) == ["One two.\nThree", None, None]
    assert col(spark, ["<p>a <b>b</b></p><!-- c -->"], text.tag_text) == ["a b"]


def test_boilerplate(spark):
    assert col(spark, ["x scrapers break the web y", "scrapers", "Scrapers break the web"], lambda c: text.contains_any(c, text.BOILERPLATE)) == [True, False, False]


def test_languages(spark):
    got = col(spark, ["the cat is in the house", "der Hund und die Katze"], text.languages)
    assert [g[0].lang for g in got] == ["en", "de"] and all(len(g) == 2 for g in got)


def test_news_domains(tmp_path):
    f = tmp_path / "d.txt"
    f.write_text("a.com/\n\n b.org \na.com")
    assert text.news_domains(f) == ["a.com", "b.org"]
    assert text.news_pattern(["a.com"]) == r"[/.](?:a\.com)"
    assert len(text.news_domains()) > 100


@pytest.mark.parametrize("word,base", [("children", "child"), ("boxes", "box"), ("stories", "story"), ("glass", "glass"), ("models", "model"), ("gemini", "geminus"), (",", ",")])
def test_lemma(spark, word, base):
    assert col(spark, [word], text.lemma) == [base]


def test_hrefs_of_any_quoting(spark):
    html = """<a href='x'>1</a><A class=c HREF=y>2</A><a data-href="no" href = "z">3</a><a href="">4</a><abbr href="no">5</abbr><a
 title="t" href="it's">6</a>"""
    assert col(spark, [html], text.hrefs) == [["x", "y", "z", "it's"]]
