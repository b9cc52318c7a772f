"""Removal of passages that repeat earlier ones, by longest-previous-factor arrays.

Documents follow each other in order of their id; a passage of SPAN words or more that also begins
earlier is a later copy and goes, the first stays. LPF[i] is the length of the longest factor at word i that also
begins before i: the larger of the common prefixes with the previous and with the next smaller position in suffix order. The passages that go are
the union of [i, i + LPF[i]) over all i with LPF[i] >= SPAN.

Spark holds the suffixes in buckets, and each bucket has its own suffix array and LPF array. What brings equal suffixes together is an anchor: of the factors of ANCHOR words within a suffix's first
SPAN words, that of the smallest fingerprint. Suffixes that agree in SPAN words have the same anchor, so both smaller positions that matter lie in one bucket. A bucket gets, for each run of suffixes
with one anchor, the run's words. Only anchors that are found at two places are sent, and of equal runs of a batch the earliest, as the others are later copies of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PACKED, bucket_names, buckets, byte_class, chunks, fresh, gram_hashes, mix, packed, split_by, table, utf8, word_hashes, words

SPAN = 50
ANCHOR = 16
_TEXT = byte_class("space")
_TOP = np.uint64(2**64 - 1)
_ENTRY = np.dtype([("h", "<u8"), ("row", "<u2"), ("pos", "<u4")])
_RUN = np.dtype([("h", "<u8"), ("row", "<u2"), ("pos", "<u4"), ("n", "<u4")])
PLACES = "d_id long, d_hash long, places binary"


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over all windows of width elements."""
    have, cur = 1, x
    while have * 2 <= width:
        cur = op(cur[: len(cur) - have], cur[have:])
        have *= 2
    if have < width:
        cur = op(cur[: len(cur) - (width - have)], cur[width - have :])
    return cur


def _tokens(buf: np.ndarray, off: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Word hashes; where rows begin among them; fingerprints of anchors; and, for each suffix of span words at least, the smallest of its window (0: no such suffix)."""
    starts, ends, at = words(buf, off, _TEXT)
    h = word_hashes(buf, starts, ends)
    g = gram_hashes(h, anchor) | np.uint64(1)
    w = span - anchor + 1
    if len(g) < w:
        return h, at, g, np.zeros(0, np.uint64)
    low = _slide(g, w, np.minimum)
    last = np.repeat(at[1:], np.diff(at))[: len(low)]
    low[np.arange(len(low)) + span > last] = 0
    return h, at, g, low


def _anchors(g: np.ndarray, low: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the smallest of a window."""
    if not len(low):
        return np.zeros(0, np.int64)
    z = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([z, low, z]), w, np.maximum)
    return np.flatnonzero(most == g)


def _send(got: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, hashes: np.ndarray, names: np.ndarray) -> pa.RecordBatch | None:
    """One blob per bucket: counts of rows and entries, the rows' ids and text hashes, entries."""
    if not got:
        return None
    h, row, pos = (np.concatenate([g[k] for g in got]) for k in range(3))
    if not len(h):
        return None
    order, bound = split_by((mix(h) % np.uint64(len(names))).astype(np.int64), len(names))
    h, row, pos = h[order], row[order], pos[order]
    out = []
    for b in np.flatnonzero(np.diff(bound)):
        s = slice(bound[b], bound[b + 1])
        own, idx = np.unique(row[s], return_inverse=True)
        e = np.empty(len(idx), _ENTRY)
        e["h"], e["row"], e["pos"] = h[s], idx, pos[s]
        out.append((int(b), np.array([len(own), len(e)], np.int64).tobytes() + ids[own].tobytes() + hashes[own].tobytes() + e.tobytes()))
    return packed(out, names)


def _ranks(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each document in order of id and text hash; ids and hashes by rank. Equal rows have one rank."""
    order = np.lexsort((hashes, ids))
    a, b = ids[order], hashes[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.empty(len(a), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, a[new], b[new]


def _places(doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> pa.Table:
    """One row per document: its positions."""
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order].astype(np.uint32)
    edge = np.flatnonzero(np.diff(doc, prepend=-1))
    own = doc[edge]
    bound = np.append(edge, len(doc)).astype(np.int32) * 4
    blob = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bound.tobytes()), pa.py_buffer(pos.tobytes())])
    return pa.table({"d_id": pa.array(ids[own]), "d_hash": pa.array(hashes[own]), "places": blob})


def _shared(t: pa.Table) -> pa.Table:
    """Anchors found at two places or more."""
    ids, hashes, h, row, pos, base = [], [], [], [], [], 0
    for x in t.column("payload"):
        blob = x.as_buffer()
        n, m = np.frombuffer(blob, np.int64, 2)
        ids.append(np.frombuffer(blob, np.int64, n, 16))
        hashes.append(np.frombuffer(blob, np.int64, n, 16 + 8 * n))
        e = np.frombuffer(blob, _ENTRY, m, 16 + 16 * n)
        h.append(e["h"])
        row.append(e["row"].astype(np.int64) + base)
        pos.append(e["pos"])
        base += n
    rank, ids, hashes = _ranks(np.concatenate(ids), np.concatenate(hashes))
    h, doc, pos = np.concatenate(h), rank[np.concatenate(row)], np.concatenate(pos)
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    keep = n[which] > 1
    return _places(doc[keep], pos[keep], ids, hashes)


def _expand(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (many[k] of them), for all k."""
    return np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def _send_runs(got: list[tuple[np.ndarray, ...]], ids: np.ndarray, hashes: np.ndarray, span: int, names: np.ndarray) -> pa.RecordBatch | None:
    """One blob per bucket: counts; the rows' ids and text hashes; runs of suffixes, and their words; and runs that are later copies for sure. got: anchor, row, first position, suffixes, and words of runs."""
    if not got:
        return None
    h, row, pos, n = (np.concatenate([g[k] for g in got]) for k in range(4))
    if not len(h):
        return None
    word = np.concatenate([g[4] for g in got])
    size = n + span - 1
    at = np.cumsum(size) - size
    # of equal runs the first in order of documents and places
    total = np.add.reduceat(mix(word.astype(np.uint64) ^ mix((np.arange(len(word)) - np.repeat(at, size)).astype(np.uint64))), at) ^ h
    order = np.lexsort((pos, hashes[row], ids[row], n, total))
    new = np.append(True, (total[order][1:] != total[order][:-1]) | (n[order][1:] != n[order][:-1]))
    later = np.zeros(len(h), bool)
    later[order] = ~new
    # equal rows: none is later than the other
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = np.zeros(len(h), bool)
    same[order] = (ids[row[order]] == ids[row[first]]) & (hashes[row[order]] == hashes[row[first]]) & (pos[order] == pos[first])
    order, bound = split_by((mix(h) % np.uint64(len(names))).astype(np.int64), len(names))
    out = []
    for b in np.flatnonzero(np.diff(bound)):
        s = order[bound[b] : bound[b + 1]]
        s = s[~(later & same)[s]]
        own, idx = np.unique(row[s], return_inverse=True)
        e = np.empty(len(s), _RUN)
        e["h"], e["row"], e["pos"], e["n"] = h[s], idx, pos[s], n[s]
        sent, gone = ~later[s], later[s]
        out.append((int(b), b"".join(v.tobytes() for v in (np.array([len(own), sent.sum(), gone.sum()], np.int64), ids[own], hashes[own], e[sent], e[gone], word[_expand(at[s[sent]], size[s[sent]])]))))
    return packed(out, names)


def order_of(word: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes by their first depth words at least, and those by their first 1, 2, 4, ... words. By prefix doubling; a suffix ends at end."""
    rank = np.unique(word, return_inverse=True)[1].astype(np.int32) + 1
    levels, k, place = [rank], 1, np.arange(len(word))
    while k < depth and len(word):
        after = place + k
        second = np.where(after < end, rank[np.minimum(after, len(word) - 1)], 0)
        key = (rank.astype(np.int64) << 32) | second
        del after, second
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32) + 1
        levels.append(rank)
        k *= 2
    return rank, levels


def smaller(pos: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of the previous and of the next element of the same group that is smaller than an element, or -1. Groups are neighbours; minima over powers of two are searched, so no element takes more steps than the logarithm of its group."""
    n = len(pos)
    out = np.full((2, n), -1, np.int64)
    if not n:
        return out[0], out[1]
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(edge, n))
    for big in (False, True):
        use = np.repeat((size > 64) == big, size)
        where = np.flatnonzero(use)
        if not len(where):
            continue
        m = size[(size > 64) == big]
        lo = np.repeat(np.cumsum(m) - m, m)
        for side in (0, 1):
            x = pos[where] if side == 0 else pos[where][::-1]
            first = lo if side == 0 else (len(where) - (lo + np.repeat(m, m)))[::-1]  # where an element's group begins, in this direction
            low = [x]  # low[k][i]: the least of x[i - 2^k + 1 .. i]
            while 1 << len(low) <= int(m.max()):
                y, k = low[-1], 1 << (len(low) - 1)
                z = y.copy()
                z[k:] = np.minimum(y[k:], y[:-k])
                low.append(z)
            j = np.arange(len(x)) - 1  # the last element that isn't ruled out
            for k in range(len(low) - 1, -1, -1):
                fits = j - (1 << k) + 1 >= first
                over = fits & (low[k][np.maximum(j, 0)] > x)
                j[over] -= 1 << k
            found = j >= first
            j = np.where(found, j, -1)
            if side:
                j = np.where(found, len(x) - 1 - j, -1)[::-1]
            out[side, where] = np.where(j >= 0, where[np.maximum(j, 0)], -1)
    return out[0], out[1]


def lpf(word: np.ndarray, end: np.ndarray, start: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
    """For the suffixes of word that begin at start: the longest previous factor (words, measured to a power of two that is span at least). end: by word; place: where a suffix stands in the order of all texts."""
    rank, levels = order_of(word, end, span)
    depth = 1 << (len(levels) - 1)
    order = np.lexsort((place, rank[start]))
    at, where = start[order], place[order]

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        left, out = np.minimum(np.minimum(end[i] - i, end[j] - j), depth), np.zeros(len(i), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            go = np.flatnonzero(left - out >= 1 << k)
            out[go[levels[k][i[go] + out[go]] == levels[k][j[go] + out[go]]]] += 1 << k
        return out

    # suffixes that agree in fewer words than span are in other groups: no factor that counts lies across
    near = np.append(0, common(at[1:], at[:-1])) if len(at) else np.zeros(0, np.int64)
    group = np.cumsum(near < span)
    best = np.zeros(len(at), np.int64)
    for other in smaller(where, group):
        has = np.flatnonzero(other >= 0)
        best[has] = np.maximum(best[has], common(at[has], at[other[has]]))
    out = np.empty(len(start), np.int64)
    out[order] = best
    return out


def _later(span: int):
    def run(t: pa.Table) -> pa.Table:
        """Suffixes whose longest previous factor has span words at least."""
        ids, hashes, sent, gone, word, base = [], [], [], [], [], 0
        for x in t.column("payload"):
            blob = x.as_buffer()
            n, m, k = (int(v) for v in np.frombuffer(blob, np.int64, 3))
            ids.append(np.frombuffer(blob, np.int64, n, 24))
            hashes.append(np.frombuffer(blob, np.int64, n, 24 + 8 * n))
            at = 24 + 16 * n
            for into, many in ((sent, m), (gone, k)):
                e = np.frombuffer(blob, _RUN, many, at)
                into.append((e["h"], e["row"].astype(np.int64) + base, e["pos"].astype(np.int64), e["n"].astype(np.int64)))
                at += e.nbytes
            word.append(np.frombuffer(blob, np.uint32, offset=at))
            base += n
        rank, ids, hashes = _ranks(np.concatenate(ids), np.concatenate(hashes))
        word = np.concatenate(word)
        h, row, pos, n = (np.concatenate([e[k] for e in sent]) for k in range(4))
        doc, size = rank[row], n + span - 1
        at = np.cumsum(size) - size
        start, place = _expand(at, n), _expand((doc << 32) | pos, n)
        end = np.repeat(at + size, size)
        # runs of equal rows stand at equal places: of those one is enough
        start, place = start[(once := np.unique(place, return_index=True)[1])], place[once]
        later = place[lpf(word, end, start, place, span) >= span] if len(start) else place
        _, row, pos, n = (np.concatenate([e[k] for e in gone]) for k in range(4))
        later = np.concatenate([later, _expand((rank[row] << 32) | pos, n)])
        return _places(later >> 32, later & 0xFFFFFFFF, ids, hashes)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """docs with the later copies cut from text_col, and dedup_words, dedup_removed (words), dedup_spans (places where something went).

    Words are runs without white space, compared as they are written (by hashes of 32 bits, span of them in a row); a removed word takes the white space after it along. "Earlier" goes by
    id, then by the text's hash, then by position; repeats within a text count, and may overlap, however long the text. Rows of equal id and
    text are one document: they get equal results. Rows with a null id or text are neither compared nor changed (0 removed; a null text has 0 words).
    Texts of fewer than span words, empty ones too, stay as they are; an empty table gives none. Extra columns pass through; added names get
    underscores where docs has them. Ids must be integers.
    """
    w = span - anchor + 1
    if not 0 < anchor <= span:
        raise ValueError("an anchor has a word at least, and span words at most")
    names = bucket_names(docs.sparkSession, buckets(docs.sparkSession))
    name_hash, name_key, places = fresh(docs, "d_hash", "d_key", "places")
    added = fresh(docs, "dedup_words", "dedup_removed", "dedup_spans")
    columns = docs.columns
    who, where = columns.index(id_col), columns.index(text_col)
    whole = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    # texts move once: all three passes read this exchange
    base = docs.where(whole).withColumn(name_hash, F.xxhash64(F.col(text_col))).withColumn(name_key, F.xxhash64(F.col(id_col).cast("long"), F.col(name_hash))).repartition(F.col(name_key))

    def pieces(batch):
        """Ids, text hashes and parts of rows of a batch, each part with its chunks."""
        ids, hashes = batch.column(who).cast(pa.int64()).to_numpy(), batch.column(len(columns)).to_numpy()
        buf, off = utf8(batch.column(where))
        for lo in range(0, len(ids), 60000):
            hi = min(len(ids), lo + 60000)
            part = off[lo : hi + 1]
            yield lo, hi, ids[lo:hi], hashes[lo:hi], [(i, j, buf[part[i] : part[j]], part[i : j + 1] - part[i]) for i, j in chunks(part)]

    def find(batches):
        for batch in batches:
            for _, _, ids, hashes, parts in pieces(batch):
                got = []
                for i, _, b, o in parts:
                    _, at, g, low = _tokens(b, o, span, anchor)
                    p = _anchors(g, low, w)
                    row = np.searchsorted(at, p, "right") - 1
                    got.append((g[p], row + i, p - at[row]))
                out = _send(got, ids, hashes, names)
                if out is not None:
                    yield out

    def keyed(found: DataFrame) -> DataFrame:
        return found.groupBy(F.xxhash64("d_id", "d_hash").alias("k_")).agg(F.collect_list(F.struct("d_id", "d_hash", "places")).alias(places)).select(F.col("k_").alias("k_" + name_key), places)

    def with_places(found: DataFrame, how: str) -> DataFrame:
        return base.join(keyed(found).hint("shuffle_hash"), F.col(name_key) == F.col("k_" + name_key), how).select(*columns, name_hash, name_key, places)

    anchors = base.mapInArrow(find, PACKED).groupBy("bucket").applyInArrow(_shared, PLACES)

    def sift(batches):
        for batch in batches:
            marks = batch.column(len(columns) + 2)
            for lo, _, ids, hashes, parts in pieces(batch):
                got = []
                for i, j, b, o in parts:
                    h, at, g, low = _tokens(b, o, span, anchor)
                    if not len(low):
                        continue
                    own = np.full(len(g), _TOP)
                    for r in range(i, j):
                        p = _positions(marks[lo + r], ids[r], hashes[r]) + at[r - i]
                        own[p] = g[p]
                    p = np.flatnonzero((_slide(own, w, np.minimum) == low) & (low > 0))
                    if not len(p):
                        continue
                    row = np.searchsorted(at, p, "right") - 1
                    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1] + 1) | (low[p[1:]] != low[p[:-1]]) | (row[1:] != row[:-1])))
                    n = np.diff(np.append(first, len(p)))
                    p, row = p[first], row[first]
                    got.append((low[p], row + i, p - at[row], n, mix(h[_expand(p, n + span - 1)]).astype(np.uint32)))
                out = _send_runs(got, ids, hashes, span, names)
                if out is not None:
                    yield out

    later = with_places(anchors, "inner").mapInArrow(sift, PACKED).groupBy("bucket").applyInArrow(_later(span), PLACES)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in added)])

    def cut(batches):
        for batch in batches:
            text = batch.column(where)
            ids, hashes = batch.column(who).cast(pa.int64()).to_pylist(), batch.column(len(columns)).to_pylist()
            buf, off = utf8(text)
            marks = batch.column(len(columns) + 2)
            n, gone, spans = (np.zeros(len(off) - 1, np.int64) for _ in range(3))
            new: dict[int, bytes] = {}
            for i, j in chunks(off):
                part = off[i : j + 1] - off[i]
                starts, _, at = words(buf[off[i] : off[j]], part, _TEXT)
                n[i:j] = np.diff(at)
                for r in range(i, j):
                    p = _positions(marks[r], ids[r], hashes[r])
                    if not len(p):
                        continue
                    cover = np.zeros(n[r] + 1, np.int32)
                    np.add.at(cover, p, 1)
                    np.add.at(cover, p + span, -1)
                    drop = np.cumsum(cover)[:-1] > 0
                    gone[r], spans[r] = drop.sum(), np.count_nonzero(np.diff(drop.astype(np.int8), prepend=0) == 1)
                    s = starts[at[r - i] : at[r - i + 1]] - part[r - i]
                    own = buf[off[r] : off[r + 1]]
                    keep = np.ones(len(own), bool)
                    keep[s[0] :] = np.repeat(~drop, np.diff(np.append(s, len(own))))
                    new[r] = own[keep].tobytes()
            if new:
                text = pa.array([new[r].decode() if r in new else v for r, v in enumerate(text.to_pylist())], text.type)
            out = [*batch.columns[: len(columns)], *(pa.array(x) for x in (n, gone, spans))]
            out[where] = text
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *added])

    kind = "array<struct<d_id:bigint,d_hash:bigint,places:binary>>"
    rest = docs.where(~whole).select(*columns, F.lit(0).cast("long").alias(name_hash), F.lit(0).cast("long").alias(name_key), F.lit(None).cast(kind).alias(places))
    return with_places(later, "left").mapInArrow(cut, schema).unionAll(rest.mapInArrow(cut, schema))


def _positions(marks, d_id: int, d_hash: int) -> np.ndarray:
    """Positions of a document among those that share its key."""
    if not marks.is_valid:
        return np.zeros(0, np.int64)
    own = [x["places"].as_buffer() for x in marks.values if x["d_id"].as_py() == d_id and x["d_hash"].as_py() == d_hash]
    return np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in own])).astype(np.int64) if own else np.zeros(0, np.int64)


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql() -> str:
    k = SPAN
    return f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS w, regexp_extract_all(text, '[^ \\t\\n\\r]+[ \\t\\n\\r]*') AS c, regexp_extract(text, '^[ \\t\\n\\r]*') AS lead FROM documents),
g AS (SELECT doc_id, i - 1 AS p, md5(array_to_string(w[i:i + {k - 1}], ' ')) AS g FROM d, unnest(range(1, len(w) - {k} + 2)) AS u(i)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS later FROM g),
x AS (SELECT doc_id, list_distinct(flatten(list(range(p + 1, p + {k + 1})))) AS gone FROM f WHERE later GROUP BY doc_id),
o AS (SELECT d.doc_id, d.text, w, c, lead, CASE WHEN x.gone IS NULL THEN NULL ELSE list_sort(x.gone) END AS gone FROM d LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN text ELSE lead || array_to_string(list_filter(c, lambda e, i: NOT list_contains(gone, i)), '') END AS text,
  CAST(coalesce(len(w), 0) AS BIGINT) AS dedup_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS dedup_removed,
  CAST(coalesce(len(list_filter(gone, lambda e, i: i = 1 OR gone[i - 1] <> e - 1)), 0) AS BIGINT) AS dedup_spans
FROM o"""
