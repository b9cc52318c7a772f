"""Benchmark decontamination with suffix arrays of the training texts.

Training texts are cut into shards. A shard's suffix array holds the suffixes of its documents, word by word, in the order of their words' hashes,
sorted by prefix doubling; suffixes whose first MIN_WORDS words begin no suffix of a test item are left out, as they have no match. Every
suffix of every test item is binary-searched in every shard, by longest common prefixes. The longest common prefix of a test suffix with a document is that with the document's
suffix just before or just after the place that the search finds; the longest over an item's suffixes is the match of document and item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_class, chunks, fresh, gram_hashes, mix, table, utf8, word_hashes, words

#: A match counts from so many words on.
MIN_WORDS = 8
#: Bytes of test items that are broadcast at once; more items are searched in several passes.
TEST_BYTES = 32 << 20
SHARD = 4 << 20
_WORD = byte_class("word")
_M1 = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, match_words int, doc_word int, item_word int"


class Words:
    """Word hashes of texts; end: where the text of a word ends; levels[k]: hashes of the 2^k words from each word on (meaningless where the text ends before)."""

    def __init__(self, h: np.ndarray, end: np.ndarray):
        self.h, self.end, self.levels = h, end, [h]
        self.longest = int((end - np.arange(len(h))).max()) if len(h) else 0
        while (2 << (len(self.levels) - 1)) <= self.longest:
            x, k = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.append(mix(x[:-k] * _M1 + mix(x[k:])), x[len(x) - k :]))


def common(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes i of a and j of b, in words."""
    out = np.zeros(len(i), np.int64)
    left = np.minimum(a.end[i] - i, b.end[j] - j)
    for k in range(min(len(a.levels), len(b.levels)) - 1, -1, -1):
        size = 1 << k
        for _ in range(2 if k == min(len(a.levels), len(b.levels)) - 1 else 1):  # the longer text may have twice the top level
            fits = np.flatnonzero(left - out >= size)
            same = a.levels[k][i[fits] + out[fits]] == b.levels[k][j[fits] + out[fits]]
            out[fits[same]] += size
    return out


def suffix_array(w: Words) -> np.ndarray:
    """All suffixes in order of their words' hashes, one that ends first before those that go on, equal ones by place. By prefix doubling."""
    n = len(w.h)
    rank = np.unique(w.h, return_inverse=True)[1].astype(np.int64) + 1
    k, place = 1, np.arange(n)
    while k < w.longest and (n == 0 or rank.max() < n):
        after = place + k
        second = np.where(after < w.end, rank[np.minimum(after, n - 1)], 0)
        rank = np.unique((rank << 32) | second, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return np.argsort(rank, kind="stable")


def search(tests: Words, t: np.ndarray, w: Words, array: np.ndarray) -> np.ndarray:
    """For each test suffix t the number of the array's suffixes that come before it."""
    lo, hi = np.zeros(len(t), np.int64), np.full(len(t), len(array))
    while True:
        todo = np.flatnonzero(lo < hi)
        if not len(todo):
            return lo
        mid = (lo[todo] + hi[todo]) // 2
        i, j = t[todo], array[mid]
        n = common(tests, i, w, j)
        i, j = i + n, j + n
        ends = i >= tests.end[t[todo]]  # the test suffix is a prefix, or the same: it comes first
        runs_out = j >= w.end[array[mid]]
        before = ~ends & (runs_out | (w.h[np.minimum(j, len(w.h) - 1)] < tests.h[np.minimum(i, len(tests.h) - 1)]))
        lo[todo[before]] = mid[before] + 1
        hi[todo[~before]] = mid[~before]


class Tests:
    """Test items: their words, the item and place of each, and the hashes of the first n words of the suffixes that have them, in order."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, ids: np.ndarray, n: int):
        starts, ends, at = words(buf, off, _WORD)
        row = np.repeat(np.arange(len(off) - 1), np.diff(at))
        self.words = Words(word_hashes(buf, starts, ends), at[row + 1])
        self.item, self.place = ids[row], np.arange(len(row)) - at[row]
        g = gram_hashes(self.words.h, n)
        t = np.flatnonzero(np.arange(len(g)) + n <= self.words.end[: len(g)])
        self.suffix = t[np.argsort(g[t], kind="stable")]
        self.key = g[self.suffix]


def _expand(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (many[k] of them), for all k."""
    return np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def matches(buf: np.ndarray, off: np.ndarray, tests: Tests, n: int) -> tuple[np.ndarray, ...]:
    """The longest match for each row and item of a shard: row, item, words, place in the row, place in the item.

    Of matches of equal length the one that is first in the document, then in the item, counts.
    """
    none = (np.zeros(0, np.int64),) * 5
    starts, ends, at = words(buf, off, _WORD)
    h = word_hashes(buf, starts, ends)
    g = gram_hashes(h, n)
    if not len(g) or not len(tests.key):
        return none
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    hit = tests.key[np.minimum(np.searchsorted(tests.key, g), len(tests.key) - 1)] == g
    hit &= np.arange(len(g)) + n <= at[row[: len(g)] + 1]
    p = np.flatnonzero(hit)
    if not len(p):
        return none
    # the words that a match can hold
    cover = np.zeros(len(h) + 1, np.int32)
    cover[p] += 1
    np.subtract.at(cover, p + n, 1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    last = np.flatnonzero(np.append((kept[1:] != kept[:-1] + 1) | (row[kept[1:]] != row[kept[:-1]]), True))
    w = Words(h[kept], np.repeat(last + 1, np.diff(last, prepend=-1)))
    array = suffix_array(w)
    array = array[w.end[array] - array >= n]
    array = array[hit[kept[array]]]
    # test suffixes that have a match here
    key = g[kept[array]]
    order = np.argsort(key, kind="stable")
    gram, group = np.unique(key, return_inverse=True)
    lo, hi = np.searchsorted(tests.key, gram, "left"), np.searchsorted(tests.key, gram, "right")
    t = tests.suffix[_expand(lo, hi - lo)]
    of = np.repeat(np.arange(len(gram)), hi - lo)
    place = search(tests.words, t, w, array)
    # the documents that hold the first n words of each: for each the neighbours of that place among its suffixes there
    del order
    rank = np.arange(len(array))
    doc = row[kept[array]]
    by = np.lexsort((rank, doc, group))
    pair = group[by] * np.int64(len(off)) + doc[by]
    edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    size = np.diff(np.append(edge, len(by)))
    first, end = np.searchsorted(group[by][edge], np.arange(len(gram)), "left"), np.searchsorted(group[by][edge], np.arange(len(gram)), "right")
    many = (end - first)[of]
    run = _expand(first[of], many)  # runs of suffixes of one document and one start
    who = np.repeat(np.arange(len(t)), many)
    wide = np.int64(len(array) + 1)
    k = np.searchsorted(pair_rank := np.repeat(np.arange(len(edge)), size) * wide + by, run * wide + place[who], "left")
    best = np.zeros(len(run), np.int64)
    for near in (k - 1, k):
        inside = (near >= edge[run]) & (near < edge[run] + size[run])
        best[inside] = np.maximum(best[inside], common(tests.words, t[who[inside]], w, array[by[near[inside]]]))
    del pair_rank
    # the longest of each document and item; then its first place in the document
    item, r = tests.item[t[who]], doc[by[edge[run]]]
    order = np.lexsort((-best, item, r))
    new = np.flatnonzero(np.append(True, (r[order][1:] != r[order][:-1]) | (item[order][1:] != item[order][:-1])))
    top = np.repeat(best[order][new], np.diff(np.append(new, len(order))))
    win = order[best[order] == top]
    least = _first_place(tests.words, t[who[win]], best[win], w, array[by], edge[run[win]], size[run[win]])
    r, item, best, p, q = r[win], item[win], best[win], kept[least] - at[r[win]], tests.place[t[who[win]]]
    order = np.lexsort((q, p, item, r))
    r, item, best, p, q = (v[order] for v in (r, item, best, p, q))
    new = np.append(True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]))
    return r[new], item[new], best[new], p[new], q[new]


def _first_place(tests: Words, t: np.ndarray, length: np.ndarray, w: Words, array: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first of the suffixes array[lo : lo + size] (in suffix order) that agree with t in length words: they are neighbours, so both ends are binary-searched."""
    out = np.empty(len(t), np.int64)
    ends = []
    for upper in (False, True):
        a, b = lo.copy(), lo + size
        while True:
            todo = np.flatnonzero(a < b)
            if not len(todo):
                break
            mid = (a[todo] + b[todo]) // 2
            j = array[mid]
            n = common(tests, t[todo], w, j)
            agrees = n >= length[todo]
            x, y = j + n, t[todo] + n
            before = ~agrees & ((x >= w.end[j]) | (w.h[np.minimum(x, len(w.h) - 1)] < tests.h[np.minimum(y, len(tests.h) - 1)]))
            before |= agrees & upper
            a[todo[before]] = mid[before] + 1
            b[todo[~before]] = mid[~before]
        ends.append(a)
    for k in range(len(t)):
        out[k] = array[ends[0][k] : ends[1][k]].min()
    return out


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, test_bytes: int = TEST_BYTES) -> DataFrame:
    """The longest verbatim match of every document and test item with one of min_words words at least.

    Words are runs of letters and digits, in lower case. doc_word and item_word are the places of the match, counted in words.
    Rows with a null id or text have no matches; nor have texts or items of fewer than min_words words (an empty one has none).
    Rows with equal ids give one row per item, of their longest match. Other columns are not looked at. Of equal matches the first in the document counts, then the first in the item.
    Whole texts are searched, whatever their length, repeated words too. An empty table on either side gives no rows. Ids must be integers.
    """
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    b = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = int(size // test_bytes) + 1
    n, found = min_words, None
    for k in range(passes):
        part = b if passes == 1 else b.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        got = part.toArrow()
        buf, off = utf8(got["text"], lower=True)
        ids = got["item_id"].to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast((buf, off, ids))

        def find(batches, shared=shared):
            tests = Tests(*shared.value, n)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                buf, off = utf8(batch.column(1), lower=True)
                for i, j in chunks(off, SHARD):
                    r, item, length, p, q = matches(buf[off[i] : off[j]], off[i : j + 1] - off[i], tests, n)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][r]), pa.array(item), *(pa.array(x.astype(np.int32)) for x in (length, p, q))], names=["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        one = d.mapInArrow(find, FOUND)
        found = one if found is None else found.unionAll(one)
    best = F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("m.match_words").alias("match_words"), (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def remove_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold a match; rows with a null id stay, for they have no matches. See find_leaks()."""
    bad = fresh(docs, "leaked_id")[0]
    ids = find_leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(ids, F.col(id_col) == F.col(bad), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql() -> str:
    n = MIN_WORDS
    grams = "SELECT {id}, i - 1 AS p, array_to_string(w[i:i + {m}], ' ') AS g FROM (SELECT {id}, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {t} WHERE {id} IS NOT NULL AND text IS NOT NULL), unnest(range(1, len(w) - {m} + 1)) AS u(i)"
    return f"""
WITH b AS ({grams.format(id="item_id", t="benchmark", m=n - 1)}),
d AS ({grams.format(id="doc_id", t="documents", m=n - 1)}),
m AS (SELECT DISTINCT doc_id, item_id, d.p AS p, b.p AS q FROM d JOIN b ON d.g = b.g),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM m),
l AS (SELECT doc_id, item_id, p - q AS diag, run, count(*) + {n - 1} AS len, min(p) AS p, min(q) AS q FROM r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len DESC, p, q) AS k FROM l)
SELECT doc_id, item_id, CAST(len AS INTEGER) AS match_words, CAST(p AS INTEGER) AS doc_word, CAST(q AS INTEGER) AS item_word FROM o WHERE k = 1"""
