"""Nearest neighbours by cosine, with shifted space-filling curves.

Each of CURVES projects the vectors to DIMS random directions, shifts and quantises them, and orders them along a Hilbert curve. Spark
splits each order into ranges, at other places for every curve, so that what lies at the edge of one range is inside on the others.
In a range, every query is compared with WINDOW neighbours on both sides; the curves' lists merge and are reranked by exact similarity.

How often the curves find the same neighbours tells how complete a query's list is (as recapture does in a census). Queries whose lists aren't found again
by SETTLED of the curves, those in sparse surroundings, are compared with all vectors instead: they are broadcast in blocks of QUERY_BYTES, and every task gives its own best for them. No window
of a curve is wide enough where all distances are about equal. That part grows with the product of such queries and vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, mix, table

K = 10
CURVES, DIMS, BITS, WINDOW = 6, 8, 6, 96
#: Share of the curves that must find a query's neighbours, on average, for its list to be complete.
SETTLED = 0.5
#: Rows of a range; bytes of queries that are compared with all vectors in one pass; of which rows the query of the registry asks for neighbours: every so manieth id.
RANGE_ROWS, QUERY_BYTES, EVERY = 8192, 8 << 20, 20
SEED = 11
LISTS = "id long, curve int, found binary, cut boolean"
_HIT = np.dtype([("id", "<i8"), ("sim", "<f4")])


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of points (n, dims) with coordinates below 2^bits."""
    x = x.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(dims):
            up = (x[i] & q) > 0
            t = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[-1] & q) > 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.view(np.int64)


def curve_keys(v: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors (n, d) on one curve: its own directions, its own shift."""
    r = np.random.default_rng(SEED + curve)
    d = v.shape[1]
    basis = np.linalg.qr(r.normal(size=(max(d, DIMS), max(d, DIMS))))[0][:d, : min(DIMS, max(d, 1))]
    p = v @ basis * np.sqrt(d)  # about standard normal
    cell = (p + 3 + r.uniform(0, 1, p.shape[1])) / 7 * (1 << BITS)
    return hilbert(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def top(ids: np.ndarray, sims: np.ndarray, own: np.ndarray, k: int) -> list[bytes]:
    """For each row of sims (queries by candidates; ids: of all candidates, or of those of each row): the k best of the others, ties to the smaller id. Similarities below -1.5 are none."""
    ids = np.broadcast_to(ids, sims.shape)
    sims = np.where(ids == own[:, None], -2.0, sims).astype(np.float32)
    n = min(k, sims.shape[1])
    # all candidates that reach the k-th similarity, then cut by id
    part = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    floor = np.take_along_axis(sims, part, 1).min(1)
    out = []
    for r in range(len(sims)):
        c = part[r]
        if np.count_nonzero(sims[r] == floor[r]) > 1:
            c = np.flatnonzero(sims[r] >= floor[r])
        c = c[np.lexsort((ids[r, c], -sims[r, c]))][:n]
        c = c[sims[r, c] > -1.5]
        h = np.empty(len(c), _HIT)
        h["id"], h["sim"] = ids[r, c], sims[r, c]
        out.append(h.tobytes())
    return out


def _matrix(t: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    x = t.column(column)
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(len(x), -1)


def units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, and v, the packed unit vector. Rows with a null id, a null, empty or zero vector, or nulls or values in it that aren't finite are left out; of repeated ids the first vector in order stays."""
    d = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    d = d.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0)).groupBy("id").agg(F.min("x").alias("x"))

    def run(batches):
        for b in batches:
            rows = [np.array(x, np.float64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(x / np.linalg.norm(x)).astype(np.float32).tobytes() for x in rows], pa.binary())], names=["id", "v"])

    return d.mapInArrow(run, "id long, v binary")


def _windows(t: pa.Table, k: int, every: int) -> pa.Table:
    """The best of a range's queries; cut: the window ends amid vectors with the query's own key."""
    curve = t.column("curve")[0].as_py()
    ids, key = t.column("id").to_numpy(), t.column("key").to_numpy()
    # equal keys in another order on every curve
    order = np.lexsort((mix(ids.view(np.uint64) ^ mix(np.full(1, curve + 1, np.uint64))), key))
    ids, key, v = ids[order], key[order], _matrix(t, "v")[order]
    own, n, found = np.flatnonzero(ids % every == 0), len(ids), []
    cut = ((own - WINDOW > 0) & (key[np.maximum(own - WINDOW - 1, 0)] == key[own])) | ((own + WINDOW + 1 < n) & (key[np.minimum(own + WINDOW + 1, n - 1)] == key[own]))
    step = np.arange(-WINDOW, WINDOW + 1)
    for i in range(0, len(own), 256):
        q = own[i : i + 256]
        at = q[:, None] + step
        inside = (at >= 0) & (at < n)
        at = np.clip(at, 0, n - 1)
        sims = np.where(inside, np.matmul(v[at], v[q][:, :, None])[:, :, 0], -2.0)
        found += top(ids[at], sims, ids[q], k)
    return pa.table({"id": ids[own], "curve": pa.array(np.full(len(own), curve, np.int32)), "found": pa.array(found, pa.binary()), "cut": pa.array(cut, pa.bool_())})


def _merged(blobs: list[tuple[int, bytes]], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k best of all lists; and the share of curves that found them, on average."""
    h = [np.frombuffer(b, _HIT) for _, b in blobs]
    ids, sims = np.concatenate([x["id"] for x in h]), np.concatenate([x["sim"] for x in h])
    curve = np.repeat([c for c, _ in blobs], [len(x) for x in h])
    if not len(ids):
        return ids, sims, 0.0
    pairs = np.unique(np.stack([ids, curve], 1), axis=0)
    own, hits = np.unique(pairs[:, 0], return_counts=True)
    first = {i: s for i, s in zip(ids.tolist(), sims.tolist())}
    s = np.array([first[i] for i in own.tolist()], np.float32)
    best = np.lexsort((own, -s))[:k]
    return own[best], s[best], float(hits[best].mean()) / CURVES


def neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = 1) -> DataFrame:
    """id, neighbour, rank (from 1) and similarity (cosine, rounded to 5 digits) of the k nearest others of every vector whose id is divisible by every.

    All vectors are indexed and can be neighbours. Vectors with a null id, or null, empty, zero or not finite, are neither queries nor neighbours; of
    repeated ids one vector counts; equal vectors are each other's neighbours; ties go to the smaller id. Vectors must have one length: those that differ from the most frequent length are left out. With
    fewer than k others all of them are given; an empty table gives no rows. Other columns are not looked at. Ids must be integers.
    """
    spark = vectors.sparkSession
    u = checkpointed(units(vectors, id_col, vec_col))
    size = u.groupBy(F.octet_length("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "id long, neighbour long, rank int, similarity double")
    u = u.where(F.octet_length("v") == size["n"])
    total = size["count"]

    def keys(batches):
        for b in batches:
            v = _matrix(b, "v")
            if len(v):
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(curve_keys(v, c)), b.column(0), b.column(1)], names=["curve", "key", "id", "v"])

    keyed = u.mapInArrow(keys, "curve int, key long, id long, v binary")
    # bounds of ranges, for each curve at other quantiles
    parts = max(1, int(total // RANGE_ROWS))
    bounds = {c: np.zeros(0, np.int64) for c in range(CURVES)}
    if parts > 1:
        steps = [i / (CURVES * parts) for i in range(1, CURVES * parts)]
        q = keyed.groupBy("curve").agg(F.percentile_approx("key", F.array(*(F.lit(s) for s in steps)), F.lit(max(10000, 40 * parts))).alias("q")).collect()
        bounds = {r["curve"]: np.array(r["q"], np.int64)[r["curve"] :: CURVES] for r in q}
    shared = spark.sparkContext.broadcast(bounds)

    def place(batches):
        for b in batches:
            curve, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            part = np.zeros(len(key), np.int64)
            for c in np.unique(curve):
                part[curve == c] = np.searchsorted(shared.value[c], key[curve == c], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=["curve", "key", "id", "v", "part"])

    ranged = keyed.mapInArrow(place, "curve int, key long, id long, v binary, part long")
    lists = ranged.groupBy("curve", "part").applyInArrow(lambda t: _windows(t, k, every), LISTS)
    merged = lists.groupBy("id").agg(F.collect_list(F.struct("curve", "found")).alias("lists"), F.max("cut").alias("cut"))
    others = min(k, total - 1)

    def rerank(batches):
        for b in batches:
            rows, settled = [], []
            for x, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                i, s, share = _merged([(y["curve"], y["found"]) for y in x], k)
                h = np.empty(len(i), _HIT)
                h["id"], h["sim"] = i, s
                rows.append(h.tobytes())
                settled.append(share >= SETTLED and len(i) >= others and not cut)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), pa.array(settled, pa.bool_())], names=["id", "found", "settled"])

    first = checkpointed(merged.mapInArrow(rerank, "id long, found binary, settled boolean"))
    # the others are compared with all vectors, a block of them at a time
    sparse = u.join(first.where(~F.col("settled")).select("id"), "id", "left_semi")
    passes = -(-first.where(~F.col("settled")).count() * size["n"] // QUERY_BYTES)
    width, rest = size["n"] // 4, None
    for b in range(passes):
        got = (sparse if passes == 1 else sparse.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == b)).toArrow()
        block = spark.sparkContext.broadcast((got["id"].to_numpy(), _matrix(got, "v")))

        def scan(batches, block=block):
            """The best of a task's vectors for every query of the block."""
            q_ids, q = block.value
            best = [np.zeros(0, _HIT)] * len(q_ids)
            for b in batches:
                ids, v = b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, width)
                for i in range(0, len(q_ids) if len(ids) else 0, 512):
                    for r, x in enumerate(top(ids, q[i : i + 512] @ v.T, q_ids[i : i + 512], k), i):
                        h = np.concatenate([best[r], np.frombuffer(x, _HIT)])
                        best[r] = h[np.lexsort((h["id"], -h["sim"]))[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.zeros(len(q_ids), np.int32)), pa.array([x.tobytes() for x in best], pa.binary()), pa.array(np.zeros(len(q_ids), bool))], names=["id", "curve", "found", "cut"])

        one = u.mapInArrow(scan, LISTS)
        rest = one if rest is None else rest.unionAll(one)
    done = first.where("settled").select("id", F.array(F.struct(F.lit(0).alias("curve"), F.col("found"))).alias("lists"))
    if rest is not None:
        done = done.unionAll(rest.groupBy("id").agg(F.collect_list(F.struct("curve", "found")).alias("lists")))

    def spread(batches):
        for b in batches:
            for who, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i, s, _ = _merged([(y["curve"], y["found"]) for y in x], k)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), who, np.int64)), pa.array(i), pa.array(np.arange(1, len(i) + 1, dtype=np.int32)), pa.array(np.round(s.astype(np.float64), 5))], names=["id", "neighbour", "rank", "similarity"])

    return done.mapInArrow(spread, "id long, neighbour long, rank int, similarity double")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), every=EVERY).withColumnRenamed("id", "vec_id")
