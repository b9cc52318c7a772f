import gzip
import json

from pyspark.sql import functions as F

from corpuscope.plans import stages
from corpuscope.sources import readers, writers
from corpuscope.streaming import incremental


def record(uri, body, kind="text/html; charset=utf-8"):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: " + kind.encode() + b"\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    return head + http + b"\r\n\r\n"


def test_warc_and_consolidate(spark, tmp_path):
    text = "the cat is in the house and it was with the dog for as long as this " * 20
    page = f'<html><body><p>{text}</p><a href="/x">1</a><a href="http://B.org/">2</a></body></html>'.encode()
    data = gzip.compress(record("http://a.com/1", page)) + gzip.compress(record("http://a.com/2", b"short")) + gzip.compress(record("http://a.com/3", page, "image/png"))
    (tmp_path / "w.warc.gz").write_bytes(data)
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(record("http://c.com/", page + b"\xff"))[:-20])
    d = readers.warc(spark, str(tmp_path))
    rows = d.where("segment = 'w.warc.gz'").collect()
    assert [(r.target_uri, r.content_type) for r in rows] == [("http://a.com/1", "text/html"), ("http://a.com/2", "text/html"), ("http://a.com/3", "image/png")]
    got = stages.consolidate(d.where("error is null and segment = 'w.warc.gz'")).collect()
    assert [(r.host, r.url, r.outflow) for r in got] == [("a.com", "http://a.com/1", {"a.com": 1, "b.org": 1})]
    scored = stages.score(stages.consolidate(d.where("error is null and segment = 'w.warc.gz'"))).first()
    assert 0 <= scored.label_scores.ai <= 1 and scored.predicted_label in ("ai", "human")


def test_readers(spark, tmp_path):
    (tmp_path / "m.gz").write_bytes(gzip.compress(b" seg1 \n\nseg2\n"))
    assert [r.segment for r in readers.manifest(spark, str(tmp_path / "m.gz")).collect()] == ["seg1", "seg2"]
    (tmp_path / "n.json").write_text(json.dumps({"articles": [{"url": "https://a.com/x"}, {"url": "http://b.org"}]}))
    assert [r.site for r in readers.json_urls(spark, str(tmp_path / "n.json"), "articles").collect()] == ["a.com/x", "b.org"]
    (tmp_path / "l.txt").write_text("a.com\n")
    assert {r.pattern for r in readers.site_patterns(readers.text_list(spark, str(tmp_path / "l.txt"))).collect()} == {"/a.com", ".a.com"}


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "x string, y int")
    writers.parquet(d, str(tmp_path / "p"), level=6)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    writers.parquet(d.where("false"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["x", "y"]
    writers.csv(d, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "x string, y int").count() == 3
    writers.json(d, str(tmp_path / "j"))
    for _ in range(2):
        writers.content_addressed(d, "x", str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


def test_incremental(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.range(5).write.parquet(src)
    double = lambda d: d.select((F.col("id") * 2).alias("id"))
    incremental.process_new_files(spark, src, out, mark, double)
    spark.range(5, 8).write.mode("append").parquet(src)
    incremental.process_new_files(spark, src, out, mark, double)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [2 * i for i in range(8)]
    first = incremental.read_new(spark, src)
    assert incremental.read_new(spark, src, first.select("segment")).count() == 0
