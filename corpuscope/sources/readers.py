"""Readers for the corpus' file formats."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WARC = "segment string, record_type string, target_uri string, content_type string, content_length long, body string, error string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, gzip too: segment, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("segment")).where("segment <> ''")


def text_list(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def site_patterns(domains: DataFrame, name: str = "value") -> DataFrame:
    """pattern: each domain behind a slash and behind a dot."""
    return domains.select(F.explode(F.array(F.concat(F.lit("/"), name), F.concat(F.lit("."), name))).alias("pattern"))


def json_urls(spark: SparkSession, path: str, array: str, field: str = "url") -> DataFrame:
    """Urls of the objects in one array of a JSON file, and site, without the scheme."""
    u = spark.read.option("multiLine", "true").json(path).select(F.explode(array).alias("o")).select(F.col(f"o.{field}").alias("url"))
    return u.withColumn("site", F.regexp_replace("url", "^https?://", ""))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def _members(data: bytes) -> Iterator[bytes]:
    """Contents of concatenated gzip members, or the data itself where it isn't gzip."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(wbits=31)
        out = d.decompress(data) + d.flush()
        yield out
        if not d.eof:
            return
        data = d.unused_data.lstrip(b"\0")


def _headers(f: io.BytesIO) -> dict[str, str]:
    out = {}
    while line := f.readline():
        if not line.strip():
            break
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def parse_warc(segment: str, data: bytes) -> Iterator[tuple]:
    """Records of a WARC file whose content is an HTTP message. A broken record gives a row with its error, and ends the file."""
    try:
        for member in _members(data):
            f = io.BytesIO(member)
            while line := f.readline():
                if not line.startswith(b"WARC/"):
                    continue
                h = _headers(f)
                content = f.read(int(h.get("content-length", 0)))
                if "application/http" not in h.get("content-type", ""):
                    continue
                c = io.BytesIO(content)
                c.readline()
                http = _headers(c)
                body = c.read()
                if http.get("content-encoding", "") == "gzip":
                    body = gzip.decompress(body)
                kind = http.get("content-type", "").split(";")[0].strip().lower()
                yield segment, h.get("warc-type"), h.get("warc-target-uri"), kind, len(body), body.decode("utf-8", "replace"), None
    except (ValueError, OSError, EOFError, zlib.error) as e:
        yield segment, None, None, None, None, None, f"{type(e).__name__}: {e}"


def warc(spark: SparkSession, path: str) -> DataFrame:
    """HTTP records of WARC files, plain or gzip, with bad bytes replaced. One file is one task's work; errors are rows of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WARC.split(", ")]
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                got = []
                for r in parse_warc(p.rsplit("/", 1)[-1], data):
                    got.append(r)
                    if len(got) == 256:
                        yield _frame(got, names)
                        got = []
                if got:
                    yield _frame(got, names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, WARC)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=names)
    d["content_length"] = d["content_length"].astype("Int64")
    return d
