"""What the operators share: column handling, byte-level tokens in numpy, and packed exchanges.

Texts reach Python as Arrow buffers and are worked on as one byte array per chunk of
whole rows, so that nothing loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once; a longer document is a chunk of its own.
CHUNK = 2 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_U32 = np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession) -> int:
    """Buckets of a packed exchange; they follow the cluster's own setting for shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_names(spark: SparkSession, nb: int) -> np.ndarray:
    """Names (integers) of nb buckets, at most as many as there are partitions of a shuffle, that the shuffle's hash puts into partitions of their own; by chance some would share one."""
    parts = buckets(spark)
    many = int(parts * (np.log(parts) + 12)) + 16
    ids = spark.range(many).select(F.col("id").cast("int").alias("name"))
    found = ids.groupBy(F.pmod(F.hash("name"), F.lit(parts)).alias("part")).agg(F.min("name").alias("name")).orderBy("part").collect()  # a row for each partition
    own = [r["name"] for r in found]
    return np.array((own + [many + k for k in range(parts - len(own))])[:nb])


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the folder shared by all executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None:  # a local session, as in tests
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(where)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its extra columns are called."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U32)
    x = x * _M2
    x ^= x >> _U32
    x *= _M2
    x ^= x >> _U32
    return x


def utf8(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows after each other, and len + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8, count=int(off[-1] - off[0]), offset=int(off[0])), off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK):
    """Ranges of whole rows of about limit bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes belong to words. "word": letters, digits and all beyond ASCII; "space": all but white space."""
    b = np.arange(256)
    if pattern == "word":
        return ((b >= 48) & (b < 58)) | ((b >= 97) & (b < 123)) | ((b >= 65) & (b < 91)) | (b >= 128)
    return ~np.isin(b, [9, 10, 13, 32])


def words(buf: np.ndarray, off: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each row where its words begin among them (len + 1)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = of[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    a, b = off[:-1], off[1:]
    some = b > a
    first[a[some]] = inside[a[some]]
    last[b[some] - 1] = inside[b[some] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, the same in any process."""
    size = ends - starts
    h = size.astype(np.uint64) * _M1
    if not len(starts):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    at, todo, k = starts, None, 0
    left = size
    while True:
        piece = eight[at] & masks[np.minimum(left, 8)]
        if todo is None:
            h ^= piece
            h *= _M2
            h ^= h >> _U32
            h *= _M1
            h ^= h >> np.uint64(29)
        else:
            x = (h[todo] ^ piece) * _M2
            x ^= x >> _U32
            x *= _M1
            h[todo] = x ^ (x >> np.uint64(29))
        keep = left > 8
        if not keep.any():
            return h
        todo = np.flatnonzero(keep) if todo is None else todo[keep]
        at, left = at[keep] + 8, left[keep] - 8


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words; the caller drops those that leave a row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    # doubling: a hash of 2k words comes from two of k words
    out, have, cur, width = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            part = cur[have : have + m]
            out = part.copy() if out is None else mix(out * _M1 + part)
            have += width
        left >>= 1
        if left:
            cur = mix(cur[: len(cur) - width] * _M1 + (cur[width:] ^ _M2))
            width *= 2
    return mix(out)


def split_by(bucket: np.ndarray, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and the nb + 1 bounds."""
    kind = np.uint16 if nb < 65536 else np.int64
    order = np.argsort(bucket.astype(kind), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=nb))])


def packed(rows: list[tuple[int, bytes]], names: np.ndarray) -> pa.RecordBatch:
    """A row for each blob, under its bucket's name."""
    rows = [(int(names[b]), x) for b, x in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])


PACKED = "bucket int, payload binary"


def ordinal(df: DataFrame, id_col: str) -> DataFrame:
    """Rows that an operator can tell apart: those with an id."""
    return df.where(F.col(id_col).isNotNull())
