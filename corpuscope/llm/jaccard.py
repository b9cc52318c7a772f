"""N-gram Jaccard join by universe partition and pigeonhole.

A document is the set of its n-grams of words. Sizes fall into bands so wide that sets whose Jaccard similarity is at least t are in the same
band or in neighbouring ones; a pair belongs to the scheme of its larger set's band. A scheme cuts the universe of grams, by hash, into
segments; two similar sets must agree in some segments, or nearly so, and an index of segment subsets finds them. What a segment does is allocated by cost, from
the sizes of all documents and the popularity of all grams:

* fine segments, of a gram each. T = ceil(t |r|) of them agree. Of both sets the T - AGREE whose grams are the most popular (by an order that is the
  same for all) are left out (-1), the others are indexed (0): the AGREE rarest ones that agree are among them, and pairs with fewer in common
  aren't candidates. Where T is less, it takes AGREE's place. All fine bands share their entries.
* coarse segments, of DELETION grams on average. The sets differ in at most H = c (|r| + |s|) grams, c = (1 - t) / (1 + t). A segment counts one unit by its
  subset, and two as its one-deletion neighbourhood is indexed too (+1). If r has more than H units, one entry agrees. These entries are more, but
  hardly any two unlike sets share one, so they are for bands in which unpopular grams alone would bring very many candidates.

A set in a coarse band whose units don't exceed H is looked up by its grams instead: every other set that holds one of its first grams, as many as the
threshold asks for, is a candidate. Candidates are verified exactly.

Near copies of one text share most entries, and their pairs, in every bucket, would grow by the square of the copies. So entries that very many sets share
(hot ones) aren't expanded into pairs: they only join their sets, step by step, into hot groups, and all pairs within such a group are verified by blocks, as products of matrices.
Two sets of different hot groups, or of none, share no hot entry; those that agree are all among the others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, PACKED, bucket_names, buckets, byte_class, checkpointed, chunks, fresh, gram_hashes, mix, packed, split_by, table, utf8, word_hashes, words

NGRAM = 4
THRESHOLD = 0.5
#: Grams of a coarse segment on average; bands of smaller sets are always fine.
DELETION, SMALL = 2.0, 150
#: Cells of the table of popularity, by hash of the gram; one is popular if it exceeds the mean by so many roots of the mean, which chance doesn't, and so many more.
CELLS, ABOVE = 1 << 24, (5.0, 5.0)
#: Fine segments that must agree.
AGREE = 6
#: Cost of a candidate pair, in index entries.
PAIR_COST = 4.0
#: An entry is hot if more sets share it than this and this share of the documents.
HOT, HOT_SHARE = 50, 0.0002
#: Sets and grams of a hot group's block on average; a task has two.
BLOCK_SETS, BLOCK_GRAMS = 2048, 1 << 19
#: Candidate sets and probes of at most so many are found by a broadcast array, more by a shuffle or in several passes.
BROADCAST_SETS, PROBES = 4_000_000, 2_000_000
_WORD = byte_class("word")
_SALT = np.uint64(0xA24BAED4963EE407)


def grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all rows, ascending within a row, and where rows begin among them. A row of fewer than n words has one gram, of all its words; one without words has none."""
    starts, ends, at = words(buf, off, _WORD)
    h = word_hashes(buf, starts, ends)
    g = gram_hashes(h, n)
    out, size = [], np.zeros(len(off) - 1, np.int64)
    for r in range(len(off) - 1):
        a, b = at[r], at[r + 1]
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            if len(x) > 1:
                x = x[np.append(True, x[1:] != x[:-1])]
        else:
            x = gram_hashes(h[a:b], int(b - a)) if b > a else g[:0]
        out.append(x)
        size[r] = len(x)
    return (np.concatenate(out) if out else g[:0]), np.concatenate([[0], np.cumsum(size)])


def set_hash(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x + _SALT), out=total[1:])
    return mix((total[at[1:]] - total[at[:-1]]) ^ np.diff(at).astype(np.uint64)).view(np.int64)


class Bands:
    """Bands of sizes and their schemes."""

    def __init__(self, t: float):
        self.t, self.c = t, (1 - t) / (1 + t)
        low = [1]
        while low[-1] < 1 << 40:
            low.append(math.floor(low[-1] / t) + 1)
        self.low = np.array(low)
        self.coarse = np.zeros(len(low), bool)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def segments(self, band: np.ndarray) -> np.ndarray:
        return np.maximum(2, np.ceil((self.low[band + 1] - 1) / DELETION)).astype(np.int64)

    def allocate(self, docs: np.ndarray, single: float) -> None:
        """Chooses the cheaper kind of segments for each band. docs: documents by band; single: the expected number of unpopular grams that two documents share."""
        for b in np.flatnonzero(docs):
            n, top, e = float(docs[b]), float(self.low[b + 1] - 1), math.exp(-DELETION)
            fine = n * top * (1 - self.t) + PAIR_COST * n * n * single * (1 - self.t) ** 2
            coarse = 2 * n * top * ((1 - e) / DELETION + 1 - e) + PAIR_COST * n * n * single * e * e
            self.coarse[b] = coarse < fine and top >= SMALL


def _least(size: np.ndarray, t: float) -> np.ndarray:
    """Grams that a set has in common with any partner, at least."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def _fine(x: np.ndarray, row: np.ndarray, size: np.ndarray, t: float, popular: np.ndarray) -> np.ndarray:
    """Which grams are indexed: of each row all but the T - min(AGREE, T) most popular ones; among grams of a level the order is that of their hashes."""
    level = popular[x & np.uint64(len(popular) - 1)].astype(np.int64) if len(popular) else np.zeros(len(x), np.int64)
    order = np.argsort((row << 8) | level, kind="stable")
    start = np.cumsum(size) - size
    rank = np.arange(len(x)) - start[row]
    keep = np.zeros(len(x), bool)
    least = _least(size, t)
    keep[order[rank < (size - least + np.minimum(AGREE, least))[row]]] = True
    return keep


def _coarse(x: np.ndarray, row: np.ndarray, rows: int, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries in the coarse schemes of band (by row): signatures and rows; and the units of each row. x: grams, by row."""
    if not len(x):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, np.zeros(rows, np.int64)
    m = bands.segments(band)
    s = mix(x ^ _SALT)
    # segments of a row are told apart by its number above them: there are fewer than 2^40, and rows fewer than 2^23
    place = (row.astype(np.uint64) << np.uint64(40)) | (s % m[row].astype(np.uint64))
    order = np.argsort(place)
    place, s = place[order], s[order]
    edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    size = np.diff(np.append(edge, len(place)))
    sub = np.add.reduceat(s, edge)
    own = (place[edge] >> np.uint64(40)).astype(np.int64)
    salt = mix(band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    tag = mix((place[edge] & np.uint64((1 << 40) - 1)) ^ salt[own])
    two = size > 1
    g = np.repeat(np.arange(len(edge)), size)
    d = np.flatnonzero(two[g])
    sig = np.concatenate([mix(sub ^ tag), mix((sub[g[d]] - s[d]) ^ tag[g[d]])])
    return sig, np.concatenate([own, own[g[d]]]), np.bincount(own, 1 + two, rows).astype(np.int64)


def index(x: np.ndarray, at: np.ndarray, bands: Bands, popular: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each row in the schemes of its own band and of the next: signature, row, whether the row looks others up by it; and which rows lack units.

    popular: levels by cell of the grams' hashes, 0 for those that aren't popular.
    """
    size = np.diff(at)
    rows = len(size)
    row = np.repeat(np.arange(rows), size)
    band = bands.of(np.maximum(size, 1))
    own, above = bands.coarse[band], bands.coarse[band + 1]
    fine = _fine(x, row, size, bands.t, popular) & (~own | ~above)[row]
    got = [(mix(x[fine] + _SALT), row[fine], ~own[row[fine]])]
    lacking = np.zeros(rows, bool)
    if own.any():
        u = own[row]
        sig, who, units = _coarse(x[u], row[u], rows, band, bands)
        got.append((sig, who, np.ones(len(sig), bool)))
        lacking = own & (units <= np.floor(bands.c * 2 * size + 1e-9))
    if above.any():
        u = above[row]
        sig, who, _ = _coarse(x[u], row[u], rows, band + 1, bands)
        got.append((sig, who, np.zeros(len(sig), bool)))
    return *(np.concatenate([g[k] for g in got]) for k in range(3)), lacking


#: Parts of the table of popularity that are summed apart.
PARTS = 16


def _popular(cells: np.ndarray) -> tuple[np.ndarray, float]:
    """Levels of popularity, 0 for cells that aren't popular; and the pairs of grams, in either order, that the others hold beyond those that fall into one cell by chance."""
    mean = cells.mean()
    many = cells - mean
    high = many > ABOVE[0] * np.sqrt(mean) + ABOVE[1]
    rest = cells[~high].astype(np.float64)
    level = np.where(high, np.minimum(8 * (1 + np.log2(np.maximum(many, 1))), 255), 0).astype(np.uint8)
    return level, float((rest * (rest - 1)).sum() - rest.sum() ** 2 / max(1, len(rest)))


def _statistics(docs: DataFrame, n: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, float]:
    """Documents by band; levels of popularity by cell; unpopular grams that two documents share, on average. Over all documents, however they are cut into tasks.
    Which pairs are found doesn't depend on the levels."""

    def count(batches):
        cells, sizes = np.zeros(CELLS, np.uint32), np.zeros(len(bands.low), np.int64)
        for batch in batches:
            buf, off = utf8(batch.column(0), lower=True)
            for i, j in chunks(off):
                x, at = grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
                np.add.at(cells, (x & np.uint64(CELLS - 1)).view(np.int64), np.uint32(1))
                size = np.diff(at)
                sizes += np.bincount(bands.of(size[size > 0]), minlength=len(sizes))
        if sizes.any():
            for k, c in enumerate(np.split(cells, PARTS)):  # planes of bytes, mostly 0
                c = zlib.compress(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.binary()), pa.array([sizes.tobytes() if k == 0 else b""], pa.binary()), pa.array([0.0])], names=["part", "cells", "sizes", "f2"])

    def add(t: pa.Table) -> pa.Table:
        cells, sizes = np.zeros(CELLS // PARTS, np.int64), np.zeros(len(bands.low), np.int64)
        for c, z in zip(t.column("cells"), t.column("sizes")):
            cells += np.ascontiguousarray(np.frombuffer(zlib.decompress(c.as_buffer()), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
            if len(z := z.as_py()):
                sizes += np.frombuffer(z, np.int64)
        level, f2 = _popular(cells)
        return pa.table({"part": t.column("part")[:1], "cells": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "f2": [f2]})

    shape = "part int, cells binary, sizes binary, f2 double"
    sizes, level, f2 = np.zeros(len(bands.low), np.int64), np.zeros(CELLS, np.uint8), 0.0
    for r in docs.mapInArrow(count, shape).groupBy("part").applyInArrow(add, shape).collect():  # PARTS rows, of a byte a cell at most
        level[r["part"] * (CELLS // PARTS) :][: CELLS // PARTS] = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)
        sizes += np.frombuffer(r["sizes"], np.int64)
        f2 += r["f2"]
    return sizes, level, max(0.0, f2) / max(1, int(sizes.sum())) ** 2


#: Bits of signatures within a bucket; entries that differ beyond them agree by mistake, which verification mends.
_BITS = 32
#: Bytes of text whose entries a task holds at once.
SEND = 8 << 20
_ROW = np.uint16(0x7FFF)
_LOOKS = np.uint16(0x8000)


def _send(sig: np.ndarray, row: np.ndarray, looks: np.ndarray, lacking: np.ndarray, ids: np.ndarray, sets: np.ndarray, size: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Blobs by bucket, which are ranges of signatures: counts; hashes and sizes of sets with entries; entries, signatures as planes of bytes of
    their differences; and the sets (hash, document, whether it lacks units) whose own hash falls here."""
    nb, order = len(names), np.argsort(sig)
    sig, row, looks = sig[order], row[order], looks[order]
    step = -(-(2**64) // nb)  # a Python integer: that of a single bucket has 65 bits
    low = np.array([b * step for b in range(nb)], np.uint64)  # where buckets begin
    bound = np.append(np.searchsorted(sig, low), len(sig))
    shift = np.uint64(max(0, (step - 1).bit_length() - _BITS))
    real = np.flatnonzero(size > 0)
    o2, b2 = split_by(np.searchsorted(low, sets[real].view(np.uint64), "right") - 1, nb)
    real = real[o2]
    out, number = [], np.zeros(len(sets), np.uint16)
    for b in np.flatnonzero((np.diff(bound) > 0) | (np.diff(b2) > 0)):
        s, d = slice(bound[b], bound[b + 1]), real[b2[b] : b2[b + 1]]
        r = row[s]
        here = np.zeros(len(sets), bool)
        here[r] = True
        own = np.flatnonzero(here)
        number[own] = np.arange(len(own))
        h = ((sig[s] - low[b]) >> shift).astype(np.uint32)
        gaps = np.diff(h, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4)
        marked = number[r] | np.where(looks[s], _LOOKS, np.uint16(0))
        out.append((int(b), b"".join(v.tobytes() for v in (np.array([len(own), len(h), len(d)], np.int64), sets[own], size[own].astype(np.uint32), sets[d], ids[d], lacking[d].astype(np.int64), np.ascontiguousarray(gaps.T), marked.astype(np.uint16)))))
    return packed(out, names)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, w = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(w, np.concatenate(n), len(k)).astype(np.int64)


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (mix(x.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


#: Candidate pairs that a bucket holds at once, before equal ones are summed.
SLICE = 1 << 22


def _candidates(t_: float, bands: Bands, names: np.ndarray, hot: float = HOT):
    """_candidate_slices() as one table."""
    run = _candidate_slices(t_, bands, names, hot)
    return lambda t: pa.Table.from_batches(run(t))


def _candidate_slices(t_: float, bands: Bands, names: np.ndarray, hot: float = HOT):
    """Of a bucket of entries, blobs by part of a pair's smaller hash: each a with its bs, entries that agree, and those that must; members of sets; sets that lack units; and for
    entries that more than hot sets share, each of these with the smallest, and its size. The pairs come by slices of the sets that look others up, so that memory doesn't grow with them."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sets, sizes, h, row, s2, d2, l2, base = [], [], [], [], [], [], [], 0
        for x in t.column("payload"):
            blob = x.as_buffer()
            n, m, k = (int(v) for v in np.frombuffer(blob, np.int64, 3))
            at = 24
            for into, many, kind in ((sets, n, np.int64), (sizes, n, np.uint32), (s2, k, np.int64), (d2, k, np.int64), (l2, k, np.int64)):
                into.append(np.frombuffer(blob, kind, many, at))
                at += into[-1].nbytes
            h.append(np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * m, at).reshape(4, m).T).view(np.uint32).reshape(-1), dtype=np.uint32))
            marked = np.frombuffer(blob, np.uint16, m, at + 4 * m)
            row.append(((marked & _ROW).astype(np.uint32) + np.uint32(base)) << np.uint32(1) | (marked >= _LOOKS))
            base += n
        sets, sizes, h, row, s2, d2, l2 = (np.concatenate(v) for v in (sets, sizes, h, row, s2, d2, l2))
        # equal sets are one
        own, first, which = np.unique(sets, return_index=True, return_inverse=True)
        size = sizes[first].astype(np.int64)
        order = np.argsort(h)
        row = row[order]
        h = h[order]
        del order
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        alone = new & np.append(new[1:], True)
        keep = np.flatnonzero(~alone)
        new, row = new[keep], row[keep]
        del h, alone, keep
        who, looks = which[row >> 1], (row & 1) > 0
        edge = np.flatnonzero(new)
        many = np.diff(np.append(edge, len(who)))
        group = np.cumsum(new) - 1
        # of equal sets in a group one counts
        _, once = np.unique(group * np.int64(len(own) + 1) + who, return_index=True)
        who, looks, group = who[once], looks[once], group[once]
        many = np.bincount(group, minlength=len(edge))
        edge = np.cumsum(many) - many
        crowd = many > hot
        at = np.flatnonzero(crowd[group])
        star = np.unique((who[edge[group[at]]] << 32) | who[at])
        star = np.stack([own[star >> 32], own[star & 0xFFFFFFFF], size[star & 0xFFFFFFFF]], 1)
        # documents of sets that several documents have, and of sets that lack units
        lack = np.flatnonzero(l2 > 0)
        lack = lack[np.unique(s2[lack], return_index=True)[1]]
        lack_d, lack_s = d2[lack], s2[lack]
        order = np.lexsort((d2, s2))
        s2, d2 = s2[order], d2[order]
        once = np.append(True, (s2[1:] != s2[:-1]) | (d2[1:] != d2[:-1]))[: len(s2)]
        s2, d2 = s2[once], d2[once]
        _, w, n = np.unique(s2, return_inverse=True, return_counts=True)
        dup = n[w] > 1
        member, lack, none = np.stack([d2[dup], s2[dup]], 1), np.stack([lack_d, lack_s], 1), np.zeros(0, np.int64)
        yield _pairs_out(none, none, none, none, member, lack, star, names)
        # each pair is found by one of its sets only, so a slice has all entries that agree
        look = np.flatnonzero(looks & ~crowd[group])
        look = look[np.argsort(who[look], kind="stable")]
        cost = np.cumsum(many[group[look]])
        ends = np.append(np.flatnonzero(np.diff(who[look])) + 1, len(look)) if len(look) else none
        i = 0
        while i < len(look):
            limit = (cost[i - 1] if i else 0) + SLICE
            stop = max(int(np.searchsorted(ends, i, "right")), int(np.searchsorted(cost[ends - 1], limit, "right")) - 1)
            stop = int(ends[stop])
            keys: list[np.ndarray] = [none]
            counts: list[np.ndarray] = [none]
            while i < stop:
                j = min(stop, max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + (1 << 19), "right"))))
                g = group[look[i:j]]
                n = many[g]
                a = np.repeat(who[look[i:j]], n)
                b = who[np.repeat(edge[g], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
                # the larger looks up the smaller, of equal ones the first the second
                near = ((size[b] < size[a]) | ((size[b] == size[a]) & (a < b))) & (size[b] >= t_ * size[a] - 1e-9)
                k, c = np.unique((a[near] << 32) | b[near], return_counts=True)
                keys.append(k)
                counts.append(c)
                i = j
            both, agree = _summed(keys, counts)
            if len(both):
                large, small = size[both >> 32], size[both & 0xFFFFFFFF]
                need = np.where(bands.coarse[bands.of(large)], 1, np.minimum(AGREE, np.minimum(_least(large, t_), _least(small, t_))))
                yield _pairs_out(own[both >> 32], own[both & 0xFFFFFFFF], agree, need, member[:0], lack[:0], star[:0], names)

    return run


def _pairs_out(a: np.ndarray, b: np.ndarray, agree: np.ndarray, need: np.ndarray, member: np.ndarray, lack: np.ndarray, star: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Blobs by part, see _candidate_slices()."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, agree, need = a[order], b[order], np.minimum(agree[order], 255).astype(np.uint8), need[order].astype(np.uint8)
    (oa, ba), (om, bm), (ol, bl), (oh, bh) = (split_by(_part(v, len(names)), len(names)) for v in (a, member[:, 1], lack[:, 1], star[:, 0]))
    out = []
    for k in np.flatnonzero((np.diff(ba) > 0) | (np.diff(bm) > 0) | (np.diff(bl) > 0) | (np.diff(bh) > 0)):
        w, m, z, h = oa[ba[k] : ba[k + 1]], member[om[bm[k] : bm[k + 1]]], lack[ol[bl[k] : bl[k + 1]]], star[oh[bh[k] : bh[k + 1]]]
        first, n = np.unique(a[w], return_counts=True)
        out.append((int(k), b"".join(v.tobytes() for v in (np.array([len(first), len(w), len(m), len(z), len(h)], np.int64), first, b[w], m, z, h, n.astype(np.uint32), agree[w], need[w]))))
    return packed(out, names)


def _agreed(t: pa.Table) -> pa.Table:
    """Pairs of sets that enough entries of all buckets agree on (kind 0), documents of sets that several have (1) and of sets that lack units (2);
    sets that share a hot entry (3), w is the size of b."""
    a, b, agree, need, more, stars = [], [], [], [], [], [np.zeros((0, 3), np.int64)]
    for x in t.column("payload"):
        blob = x.as_buffer()
        n, m, members, lack, star = (int(v) for v in np.frombuffer(blob, np.int64, 5))
        at = 40
        first, own = np.frombuffer(blob, np.int64, n, at), np.frombuffer(blob, np.int64, m, at + 8 * n)
        at += 8 * (n + m)
        more += [(k, np.frombuffer(blob, np.int64, 2 * v, at + skip).reshape(-1, 2)) for k, v, skip in ((1, members, 0), (2, lack, 16 * members))]
        at += 16 * (members + lack)
        stars.append(np.frombuffer(blob, np.int64, 3 * star, at).reshape(-1, 3))
        at += 24 * star
        a.append(np.repeat(first, np.frombuffer(blob, np.uint32, n, at)))
        b.append(own)
        agree.append(np.frombuffer(blob, np.uint8, m, at + 4 * n))
        need.append(np.frombuffer(blob, np.uint8, m, at + 4 * n + m))
    a, b, agree, need = (np.concatenate(v) for v in (a, b, agree, need))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    if len(edge):
        keep = np.add.reduceat(agree[order].astype(np.int64), edge) >= np.maximum.reduceat(need[order], edge)
        a, b = a[edge[keep]], b[edge[keep]]
    more.append((3, np.unique(np.concatenate(stars), axis=0)))
    kind = np.concatenate([np.zeros(len(a), np.int32), *(np.full(len(v), k, np.int32) for k, v in more)])
    w = np.concatenate([np.zeros(len(kind) - len(more[-1][1]), np.int64), more[-1][1][:, 2]])
    return pa.table({"kind": kind, "a": np.concatenate([a, *(v[:, 0] for _, v in more)]), "b": np.concatenate([b, *(v[:, 1] for _, v in more)]), "w": w})


#: Bytes of a gram's hash that verification compares.
_GRAM = 6


def _narrow(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :_GRAM]).tobytes()


def _wide(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).reshape(-1, _GRAM)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :_GRAM] = x
    return out.view(np.uint64).reshape(-1)


def _common(v: np.ndarray, row: np.ndarray, second: np.ndarray, one: bool) -> np.ndarray:
    """Grams (v, of row) that each row of the first block has in common with each of the second one (second: which rows); if there is but one, all rows with all."""
    order = np.argsort(v)
    v, row = v[order], row[order]
    gram = np.cumsum(np.append(True, v[1:] != v[:-1])[: len(v)]) - 1
    place = np.where(second, np.cumsum(second), np.cumsum(~second)) - 1
    if not one:
        right = second[row]
        (ga, ra), (gb, rb) = ((gram[k], place[row[k]]) for k in (~right, right))
    else:
        ga, ra = gb, rb = gram, row
    na, nb = (len(second),) * 2 if one else (int(np.sum(~second)), int(np.sum(second)))
    many = int(gram[-1]) + 1 if len(gram) else 0
    ca, cb = np.bincount(ga, minlength=many), np.bincount(gb, minlength=many)
    both = np.zeros(na * nb, np.float32)
    # grams of many rows by products of matrices
    dense = ca * cb * 400 > na * nb
    column = np.cumsum(dense) - 1
    for k in range(0, int(dense.sum()), 1024):
        x, y = np.zeros((na, 1024), np.float32), np.zeros((nb, 1024), np.float32)
        for m, g, r in ((x, ga, ra), (y, gb, rb)):
            here = np.flatnonzero(dense[g] & (column[g] >= k) & (column[g] < k + 1024))
            m[r[here], column[g[here]] - k] = 1
        both += (x @ y.T).reshape(-1)
    # those of few by their pairs of rows
    from_b = np.cumsum(cb) - cb
    todo = np.flatnonzero(~dense[ga] & (cb[ga] > 0))
    cost = np.cumsum(cb[ga[todo]])
    i = 0
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + (1 << 20), "right")))
        g = ga[todo[i:j]]
        n = cb[g]
        r = rb[np.repeat(from_b[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at, times = np.unique(np.repeat(ra[todo[i:j]], n) * nb + r, return_counts=True)
        both[at] += times
        i = j
    return both.reshape(na, nb)


def _block(v: np.ndarray, at: np.ndarray, second: np.ndarray, one: bool, doc: np.ndarray, many: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sets (grams v, from at on): the documents of similar ones, between both blocks or, if there is but one, within it, and the smallest doc that they join each with here. many: documents of each set."""
    size = np.diff(at)
    both = _common(v, np.repeat(np.arange(len(size)), size), second, one)
    a, b = (np.arange(len(size)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
    near = np.zeros(both.shape, bool)
    for k in range(0, len(a), 256):
        x = both[k : k + 256].astype(np.float64)
        near[k : k + 256] = x / (size[a[k : k + 256], None] + size[None, b] - x) >= threshold - 1e-12
    del both
    if one:
        np.fill_diagonal(near, False)
    links, root, last = np.zeros(len(size), np.int64), doc.copy(), np.iinfo(np.int64).max
    ways = [(near, a, b)] if one else [(near, a, b), (near.T, b, a)]
    for m, p, q in ways:
        for k in range(0, len(p), 256):
            links[p[k : k + 256]] = np.where(m[k : k + 256], many[None, q], 0).sum(1)
    while True:
        before = root.copy()
        for m, p, q in ways:
            for k in range(0, len(p), 256):
                root[p[k : k + 256]] = np.minimum(root[p[k : k + 256]], np.where(m[k : k + 256], root[None, q], last).min(1, initial=last))
        if (root == before).all():
            return links, root


#: Pairs that are verified in one task at most, on average.
HOME_PAIRS = 1 << 17
LABEL_ROUNDS = 1


def _verified(pairs: DataFrame, blocks: DataFrame | None, docs: DataFrame, copies: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """For each set of the candidate pairs (a, b), or of blocks, that is similar to another, in each task where it has such pairs: s, doc (the smallest id of its documents), n (its documents), links (the
    documents of similar sets) and root, the smallest doc of those that similar pairs of this task join. The pairs stay in their task.

    A set goes once to each home where it has pairs: the smallest of the sets that LABEL_ROUNDS steps over pairs lead to from a,
    which is mostly the same for a whole group. Homes of very many pairs are cut by both ends. blocks: sets (s) of hot groups (h1), of every two blocks of a group (h2 < 0, h3) those of
    the first (side 0) and of the second. copies: s, first, n of sets that several documents have."""
    ends = pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(pairs.select("b", "a"))
    label = ends.groupBy("v").agg(F.least(F.min("u"), F.min("v")).alias("home"))
    for _ in range(LABEL_ROUNDS - 1):
        near = label.select(F.col("v").alias("n"), "home")
        label = checkpointed(ends.join(near, F.col("u") == F.col("n")).groupBy("v").agg(F.min("home").alias("home")))
    homed = checkpointed(pairs.join(label, F.col("a") == F.col("v")).select("home", "a", "b"))
    cut = homed.groupBy("home").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / HOME_PAIRS)).cast("int").alias("cut")).where("cut > 1").select(F.col("home").alias("h"), "cut")
    homed = homed.join(cut, F.col("home") == F.col("h"), "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("cut"))
    homed = homed.select("home", part("a").alias("pa"), part("b").alias("pb"), "a", "b")
    keys = ["home", "pa", "pb"]
    needed = homed.select(*keys, F.explode(F.array("a", "b")).alias("s")).distinct().select("s", F.col("home").alias("h1"), F.col("pa").alias("h2"), F.col("pb").alias("h3"), F.lit(0).cast("long").alias("side"))
    if blocks is not None:
        needed = needed.unionByName(blocks)
    needed = checkpointed(needed.join(copies.select(F.col("s").alias("s2"), "first", "n"), F.col("s") == F.col("s2"), "left").select("s", "h1", "h2", "h3", "side", F.coalesce("first", F.lit(-(2**63))).alias("first"), F.coalesce("n", F.lit(0)).alias("n")))
    sent = _sets_of(docs, needed, ngram)

    def rows(s, doc, many, links, root) -> pa.Table:
        return pa.table([pa.array(x, pa.int64()) for x in (s, doc, many, links, root)], names=["s", "doc", "n", "links", "root"])

    def verify(p: pa.Table, q: pa.Table) -> pa.Table:
        if len(q) and q.column("h2")[0].as_py() < 0:
            s = q.column("s").to_numpy()
            q = q.take(np.unique(s, return_index=True)[1])  # the same set from several batches
            one = bool(q.column("h3")[0].as_py() == -1 - q.column("h2")[0].as_py())
            s, d, first, n, side = (q.column(c).to_numpy() for c in ("s", "doc", "first", "n", "side"))
            d, n = np.where(n > 0, first, d), np.maximum(n, 1)
            g = [_wide(x.as_buffer()) for x in q.column("grams")]
            links, root = _block(np.concatenate(g), np.concatenate([[0], np.cumsum([len(x) for x in g])]), side > 0, one, d, n, threshold)
            k = links > 0
            return rows(s[k], d[k], n[k], links[k], root[k])
        sets: dict = {}
        doc: dict = {}
        many: dict = {}
        for s, d, first, n, g in zip(*(q.column(c).to_pylist() for c in ("s", "doc", "first", "n", "grams"))):
            if s not in sets:
                sets[s], many[s] = _wide(g), n or 1
                doc[s] = first if n else d
        links = dict.fromkeys(sets, 0)
        up = {s: s for s in sets}

        def root(v):
            while up[v] != v:
                up[v] = v = up[up[v]]
            return v

        for a, b in zip(p.column("a").to_pylist(), p.column("b").to_pylist()):
            if a in sets and b in sets:
                z = np.concatenate([sets[a], sets[b]])
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                if both / (len(z) - both) >= threshold - 1e-12:
                    links[a] += many[b]
                    links[b] += many[a]
                    a, b = root(a), root(b)
                    if a != b:
                        if (doc[a], a) < (doc[b], b):
                            a, b = b, a
                        up[a] = b
        own = [s for s in sets if links[s]]
        return rows(own, [doc[s] for s in own], [many[s] for s in own], [links[s] for s in own], [doc[root(s)] for s in own])

    return homed.groupBy(*keys).cogroup(sent.groupBy("h1", "h2", "h3")).applyInArrow(verify, "s long, doc long, n long, links long, root long")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows of wanted (longs: s, and what goes with it), with doc and grams (packed) of documents with that set, of equal sets of a batch one. wanted is broadcast if it's small, else joined."""
    names = wanted.columns
    few = wanted.count() <= BROADCAST_SETS
    known = None
    if few:
        t = wanted.toArrow()
        known = np.stack([t[c].to_numpy().astype(np.int64) for c in names]) if len(t) else np.zeros((len(names), 0), np.int64)
        known = known[:, np.argsort(known[0], kind="stable")]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = shared.value
        for batch in batches:
            ids, seen = batch.column(0).to_numpy(), np.zeros(0, np.int64)
            buf, off = utf8(batch.column(1), lower=True)
            for i, j in chunks(off):
                x, at = grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
                s = set_hash(x, at)
                r = np.unique(s, return_index=True)[1]
                r = r[(at[r + 1] > at[r]) & ~np.isin(s[r], seen)]
                seen = np.append(seen, s[r])
                if known is not None:
                    lo, hi = np.searchsorted(known[0], s[r], "left"), np.searchsorted(known[0], s[r], "right")
                    many = hi - lo
                    row = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    r = np.repeat(r, many)
                if len(r):
                    extra = [pa.array(c[row]) for c in known[1:]] if known is not None else []
                    yield pa.RecordBatch.from_arrays([pa.array(s[r]), *extra, pa.array(ids[i:j][r]), pa.array([_narrow(x[at[k] : at[k + 1]]) for k in r], pa.binary())], names=["s", *(names[1:] if known is not None else []), "doc", "grams"])

    if few:
        return docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "doc"]) + ", grams binary")
    return docs.mapInArrow(run, "s long, doc long, grams binary").join(wanted, "s")


def _lookup(docs: DataFrame, sets: DataFrame, n: int, t: float) -> DataFrame:
    """Candidates (a, b) of the sets that lack units: all sets, no larger, that hold one of the grams that a partner can't all miss."""
    spark = docs.sparkSession
    wanted = checkpointed(sets.groupBy("s").agg(F.first("grams").alias("grams")))
    total = max(1, wanted.count())
    per = max(1, int(total * 400 // PROBES) + 1)
    out = None
    for k in range(per):
        got = (wanted if per == 1 else wanted.where(F.pmod(F.xxhash64("s"), F.lit(per)) == k)).toArrow()
        gram, owner, low, high = [], [], {}, {}
        for s, blob in zip(got["s"].to_pylist(), got["grams"].to_pylist()):
            x = _wide(blob)
            need = math.ceil(t * len(x) - 1e-9)
            x = x[: len(x) - need + 1]
            gram.append(x)
            owner.append(np.full(len(x), s, np.int64))
            low[s], high[s] = need, len(x) + need - 1
        gram, owner = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (gram, owner))
        order = np.argsort(gram)
        shared = spark.sparkContext.broadcast((gram[order], owner[order], low, high))

        def run(batches, shared=shared):
            gram, owner, low, high = shared.value
            for batch in batches:
                buf, off = utf8(batch.column(1), lower=True)
                for i, j in chunks(off):
                    x, at = grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
                    s, size = set_hash(x, at), np.diff(at)
                    x = x & np.uint64((1 << (8 * _GRAM)) - 1)
                    lo, hi = np.searchsorted(gram, x, "left"), np.searchsorted(gram, x, "right")
                    hit = np.flatnonzero(hi > lo)
                    if not len(hit):
                        continue
                    m = (hi - lo)[hit]
                    w = owner[np.repeat(lo[hit], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                    r = np.repeat(np.searchsorted(at, hit, "right") - 1, m)
                    pairs = {(min(a, b), max(a, b)) for a, b, z in zip(w.tolist(), s[r].tolist(), size[r].tolist()) if a != b and low[a] <= z <= high[a]}
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["a", "b"])

        one = docs.mapInArrow(run, "a long, b long")
        out = one if out is None else out.unionAll(one)
    return out


def _hot(stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sets that share hot entries (a, b, and w, the size of b): the hot group (root) of each set (doc), and the groups' blocks, see _verified()."""
    group = components(stars.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")))
    sized = group.join(stars.groupBy("b").agg(F.max("w").alias("w")), F.col("doc") == F.col("b")).select("doc", "root", "w")
    cut = sized.groupBy(F.col("root").alias("h1")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("w") / BLOCK_GRAMS)).alias("cut"))
    own = F.pmod(F.xxhash64("doc"), F.col("cut"))
    blocks = sized.join(cut, F.col("root") == F.col("h1")).select(F.col("doc").alias("s"), "h1", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("other"))
    return group, blocks.select("s", "h1", (-1 - F.least("own", "other")).alias("h2"), F.greatest("own", "other").alias("h3"), (F.col("own") > F.col("other")).cast("long").alias("side"))


def _similar_sets(docs: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What _verified() finds, and the documents (m) of each set (s) that several have."""
    spark = docs.sparkSession
    nb = max(1, -(-buckets(spark) // 2))  # entries are small: fewer buckets, and so fewer of them that find the same pair
    names = bucket_names(spark, buckets(spark))
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("t_"))
    bands, n = Bands(threshold), ngram
    sizes, popular, single = _statistics(d.select("t_"), n, bands)
    bands.allocate(sizes, single)
    shared = spark.sparkContext.broadcast(popular)

    def send(batches):
        popular = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, off = utf8(batch.column(1), lower=True)
            for lo, hi in chunks(off, SEND):
                for lo in range(lo, hi, 30000):  # rows are numbered by 15 bits
                    up = min(hi, lo + 30000)
                    part, got = off[lo : up + 1], []
                    for i, j in chunks(part):
                        x, at = grams(buf[part[i] : part[j]], part[i : j + 1] - part[i], n)
                        sig, row, looks, lacking = index(x, at, bands, popular)
                        got.append((sig, (row + i).astype(np.int32), looks, lacking, set_hash(x, at), np.diff(at)))
                    sig, row, looks, lacking, sets, size = (np.concatenate([g[k] for g in got]) for k in range(6))
                    del got
                    yield _send(sig, row, looks, lacking, ids[lo:up], sets, size, names[:nb])

    slices = _candidate_slices(threshold, bands, names, max(HOT, HOT_SHARE * int(sizes.sum())))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from slices(pa.Table.from_batches(batches))

    found = d.mapInArrow(send, PACKED).groupBy("bucket").applyInArrow(candidates, PACKED)
    raw = checkpointed(found.groupBy("bucket").applyInArrow(_agreed, "kind int, a long, b long, w long"))
    pairs = raw.where("kind = 0").select("a", "b")
    lacking = raw.where("kind = 2").select(F.col("b").alias("s")).distinct()
    if lacking.count():
        pairs = checkpointed(pairs.union(_lookup(d, _sets_of(d, lacking, n), n, threshold)).distinct())
    members = raw.where("kind = 1").select(F.col("b").alias("s"), F.col("a").alias("m"))
    copies = members.groupBy("s").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    stars, blocks = raw.where("kind = 3"), None
    if not stars.isEmpty():
        group, blocks = _hot(stars)
        # pairs within a hot group are verified there
        group_of = lambda c: group.select(F.col("doc").alias(f"{c}_set"), F.col("root").alias(f"{c}_group"))
        pairs = pairs.join(group_of("a"), F.col("a") == F.col("a_set"), "left").join(group_of("b"), F.col("b") == F.col("b_set"), "left").where("a_group is null or b_group is null or a_group <> b_group").select("a", "b")
        pairs = checkpointed(pairs)
    return _verified(pairs, blocks, d, copies, n, threshold), members


def _linked(docs: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float) -> DataFrame:
    """doc, class_id and links of the documents that have a link. An id that is repeated with other texts has a row for each set of grams."""
    found, members = _similar_sets(docs, id_col, text_col, ngram, threshold)
    found = checkpointed(found)
    near = found.groupBy("s").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.sum("links").alias("links"))
    copies = members.join(near.select(F.col("s").alias("s1"), F.col("links").alias("others")), F.col("s") == F.col("s1"), "left")
    own = members.groupBy(F.col("s").alias("s2")).agg(F.min("m").alias("doc"), F.count(F.lit(1)).alias("n"))
    copies = copies.join(own, F.col("s") == F.col("s2")).select("m", "doc", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    linked = copies.unionAll(near.where("n = 1").select(F.col("doc").alias("m"), "doc", "links"))
    # a document's class goes by the one whose id its set goes by
    roots = components(found.select(F.col("doc").alias("doc_id_a"), F.col("root").alias("doc_id_b"))).select(F.col("doc").alias("d1"), "root")
    return linked.join(roots, F.col("doc") == F.col("d1"), "left").select(F.col("m").alias("doc"), F.coalesce("root", "doc").alias("class_id"), "links")


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every id: doc_id; class_id, the smallest id of the documents that pairs of threshold at least join with it, step by step; and links, the number of other documents that are in such a pair with it.

    Every pair counts, of copies and of different texts; pairs are verified and counted where they meet and aren't emitted, so rows don't grow with them.
    Words are runs of letters and digits, in lower case; a text of 1 to ngram - 1 words has one gram, of all its words. A null or empty text, or one without words,
    has no links and is its own class. Rows with a null id have no row. Rows of equal id and text are one document; an id that is repeated with
    other texts has the smallest class of its texts, and the sum of their links. Whole texts are compared, whatever their length, by 48-bit hashes of their grams; equal sets by a 64-bit hash. Of equal ids in a tie
    nothing depends on order. An empty docs has no rows. Other columns are not looked at. Ids must be integers.
    """
    linked = _linked(docs, id_col, text_col, ngram, threshold).groupBy("doc").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return ids.join(linked, F.col("doc_id") == F.col("doc"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """doc and root, the smallest id of its group, for all documents in pairs (doc_id_a, doc_id_b).

    Every document takes the smallest root among its neighbours and then its root's root, until nothing changes: paths halve at each round.
    """
    edges = checkpointed(pairs.select(F.col("doc_id_a").alias("u"), F.col("doc_id_b").alias("v")).union(pairs.select("doc_id_b", "doc_id_a")).where("u <> v").distinct())
    roots = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("doc"), F.least("u", "m").alias("root")))
    while True:
        low = edges.join(roots, F.col("v") == F.col("doc")).groupBy("u").agg(F.min("root").alias("m"))
        step = roots.join(low, F.col("doc") == F.col("u")).select("doc", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = roots.select(F.col("doc").alias("d2"), F.col("root").alias("r2"))
        new = checkpointed(step.join(up, F.col("root") == F.col("d2"), "left").select("doc", "old", F.least("root", F.coalesce("r2", "root")).alias("root")))
        roots = new.select("doc", "root")
        if new.where("old <> root").isEmpty():
            return roots


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs with only the document of the smallest id of each class of similar ones, see similar_classes(). Rows with a null id or without words, and repeated rows of a document that stays, stay; an id
    that is repeated with other texts stays if it is the smallest of the class of one of them. Extra columns pass through."""
    linked = _linked(docs, id_col, text_col, ngram, threshold)
    gone = fresh(docs, "gone_id")[0]
    gone_rows = linked.groupBy(F.col("doc").alias(gone)).agg(F.min(F.col("class_id") != F.col("doc")).alias("later")).where("later").select(gone)
    return docs.join(gone_rows, F.col(id_col) == F.col(gone), "left_anti")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


def sql() -> str:
    n = NGRAM
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) END AS g FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(g) AS size, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS n, any_value(a.size) AS sa, any_value(b.size) AS sb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
q AS MATERIALIZED (SELECT i, j FROM p WHERE n / (sa + sb - n)::DOUBLE >= {THRESHOLD} - 1e-12),
ways AS MATERIALIZED (SELECT i, j FROM q UNION ALL SELECT j, i FROM q),
links AS (SELECT i, count(*) AS links FROM ways GROUP BY i),
reach AS (SELECT i, i AS j FROM ways UNION SELECT r.i, b.j FROM reach r JOIN ways b ON r.j = b.i),
class AS (SELECT i, min(j) AS class_id FROM reach GROUP BY i),
ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(links, 0) AS links FROM ids LEFT JOIN links ON doc_id = links.i LEFT JOIN class ON doc_id = class.i"""
