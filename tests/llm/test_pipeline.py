"""The pipeline against a version in plain Python, on a small corpus."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from corpuscope.llm import decontam, jaccard, langid, mixing, pii

from .test_operators import near, prose, slow_leaks, slow_pairs


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, path = random.Random(21), str(tmp_path_factory.mktemp("sf"))
    items = [(k, prose(r, 30, 5000)) for k in range(4)]
    docs = []
    for k in range(120):
        kind = r.randrange(6)
        t = prose(r, r.randrange(5, 80), 5000)
        if kind == 0 and docs:
            t = near(r, r.choice(docs)[1] or "", 0.03)
        elif kind == 1:
            t += " " + " ".join(items[k % 4][1].split()[2:20])
        elif kind == 2:
            t += f" write to u{k}@mail.example.com now"
        elif kind == 3:
            t = r.choice(["", "123 456", None, t])
        docs.append((k, t, r.choice(["en", "fr"]), f"src{r.randrange(3)}", len(t or "")))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 120, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_pipeline(spark, corpus):
    path, docs, items = corpus
    table = spark.read.parquet(f"{path}/documents.parquet")
    langs, net = langid.fit(table)
    kept = []
    for d in docs:
        b = np.frombuffer((d[1] or "").encode(), np.uint8)
        p, _, letters = langid.score(net, b, np.array([0, len(b)]))
        if letters[0] and round(float(p[0].max()), 4) >= langid.MIN_CONFIDENCE:
            kept.append(d)
    root = {d[0]: d[0] for d in kept}
    pairs = slow_pairs([(d[0], d[1], d[3]) for d in kept], jaccard.NGRAM, jaccard.THRESHOLD)
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    kept = [d for d in kept if root[d[0]] == d[0]]
    bad = {i for i, _ in slow_leaks([(d[0], d[1]) for d in kept], items, decontam.MIN_WORDS)}
    kept = [d for d in kept if d[0] not in bad]
    clean = [(d[0], pii.redact_text(d[1], pii.find(d[1])), d[2], d[3]) for d in kept]
    quality = {k: mixing.QUALITY[k % 2] for k in range(0, 120, 3)}

    def key(i):
        u = (int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / quality.get(i, 1.0)

    total = Counter()
    for _, t, _, s in clean:
        total[s] += len(t.split())
    share = {s: mixing.TARGETS.get(s, mixing.TARGETS["*"]) for s in total}
    want = {}
    for s in total:
        budget, run = math.floor(share[s] / sum(share.values()) * sum(total.values()) + 1e-9), 0
        for i, t, lang, _ in sorted((d for d in clean if d[3] == s), key=lambda d: key(d[0])):
            run += len(t.split())
            n = budget // total[s] + (run <= budget % total[s])
            if n:
                want[i] = (t, lang, s, len(t), n)
    got = {r.doc_id: (r.text, r.lang, r.source, r.n_chars, r.mix_copies) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == want
    assert bad and pairs and any("[EMAIL]" in v[0] for v in want.values())


def test_stages_keep_columns(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        assert out.columns[: len(docs.columns)] == docs.columns
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), path).count() == 0


def test_stages_take_odd_rows(spark, corpus):
    """Null texts, sources and ids, repeated rows, very long and empty texts, ties, and extra columns with clashing names."""
    path, docs, _ = corpus
    long = "kalo mira tuno sefa " * 20_000
    odd = [(None, "no id here at all", "en", None, 3), (900, None, None, None, None), (901, "", "en", "src0", 0), (902, long, "en", None, 5), (903, "same words again here now", "fr", "src1", 4), (903, "same words again here now", "fr", "src1", 4), (904, "write to x@mail.example.com", None, None, None)]
    rows = [*docs[:40], *odd]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS gone_id", "2 AS leaked_id", "3 AS pii_spans", "4 AS mix_key", "5 AS lid_lang")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, path)
        assert out.columns[: len(d.columns)] == d.columns, name
        got = out.collect()
        assert all((x["gone_id"], x["leaked_id"], x["pii_spans"], x["mix_key"], x["lid_lang"]) == (1, 2, 3, 4, 5) for x in got), name
        ids = [x["doc_id"] for x in got]
        if name == "language":
            assert 900 not in ids and 901 not in ids and 902 in ids
        elif name == "mixture":
            assert None not in ids
        else:
            assert None in ids and ids.count(903) == 2 and {900, 901, 902, 904} <= set(ids), name
