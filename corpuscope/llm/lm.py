"""Language-model scoring by online logistic context mixing: bits per byte of every document.

A byte is coded bit by bit along a Huffman tree made from the corpus' bytes. At every bit, one
predictor for each of ORDERS has a probability from a hashed table of contexts: how often, after bytes
with that context, the corpus went left or right at that node of the tree. These tables are small and of a fixed size. Documents are
split in two halves by a hash of their text, and each half is scored with the counts of the other one, so that
no document (nor exact copy) predicts itself here.

One more predictor has contexts of the last WORDS words, kept in a table that is spread over the cluster and grows with the input: every
document sends each of its contexts once, with the first AHEAD bytes of the word that follows, to the context's
bucket. Back comes what followed most often in all other rows, copies too, and how sure that is. So a document that occurs
elsewhere costs fewer bits, but none learns from itself. As long as a word's bytes agree with the predicted ones, the next
one's bits are predicted.

The predictors' stretched probabilities are mixed by weights that are gated by the depth in the
tree and belong to the document: they start equal and are moved online, by the gradient of the coding cost, after
every block of the document (BLOCKS bytes, short ones first). The mix is refined by an
adaptive map from the mixed probability to what came true so far in the document. The cost of all bits over the bytes is the
score.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_names, buckets, byte_class, chunks, gram_hashes, table, utf8, word_hashes, words

#: Bytes of context, and bits of the number of hashed rows, of each predictor.
ORDERS = ((1, 8), (2, 13), (4, 15))
FOLDS = 2
#: Lengths of a document's blocks; the last one repeats.
BLOCKS = (32, 64, 128, 256, 512)
RATE, START = 0.02, 0.4
SCALE = 15.0  # of stretched probabilities kept as int8
APM_CELLS, APM_RATE, APM_SHARE = 24, 0.02, 0.3
PARTS = 32
#: Words of the long context, and how many bytes of the word after it are predicted.
WORDS, AHEAD = 3, 4
#: Bytes of text whose contexts travel together.
TRAVEL = 16 << 20
#: Entries of a bucket that are sorted at once.
SLICE = 1 << 20
SENT = "batch string, bucket int, payload binary"
GATHERED = "fold int, ord int, part int, payload binary"
_ROWS = [1 << bits for _, bits in ORDERS]


def rows_of(padded: np.ndarray, at: np.ndarray, row_start: np.ndarray) -> list[np.ndarray]:
    """Rows of the context tables at the byte positions at; bytes before row_start, the start of the document, count as 0.

    padded: the bytes after 8 zeros.
    """
    out = []
    depth = at - row_start
    c = np.zeros(len(at), np.uint32)
    k = 0
    for order, bits in ORDERS:
        while k < order:
            k += 1
            b = padded[at + (8 - k)].astype(np.uint32)
            b *= depth >= k
            c |= b << np.uint32(8 * (k - 1))
        if order == 1:
            out.append(c.astype(np.int32))
        else:
            h = c * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            out.append((h >> np.uint32(32 - bits)).astype(np.int32))
    return out


def fold_of(buf_hash: np.ndarray) -> np.ndarray:
    return (buf_hash & 1).astype(np.int64)


def count(buf: np.ndarray, off: np.ndarray, fold: np.ndarray, into: list[np.ndarray]) -> None:
    """Adds how often each byte came in each row of each table; a table of the second half follows that of the first."""
    if not len(buf):
        return
    padded = np.concatenate([np.zeros(8, np.uint8), buf])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    rows = rows_of(padded, np.arange(len(buf)), off[row])
    side = fold[row]
    one = np.int32(1)
    for k, r in enumerate(rows):
        np.add.at(into[k], (side * _ROWS[k] + r) * 256 + buf, one)


def huffman(freq: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Children of the 255 inner nodes in the order of their making (below 256: a byte, else 256 + node), and, for every byte: its code's length, its nodes and its bits by depth."""
    heap = [(int(f), s) for s, f in enumerate(freq)]
    heapq.heapify(heap)
    kids: list[tuple[int, int]] = []
    while len(heap) > 1:
        (fa, a), (fb, b) = heapq.heappop(heap), heapq.heappop(heap)
        kids.append((a, b))
        heapq.heappush(heap, (fa + fb, 255 + len(kids)))
    paths: dict[int, list[tuple[int, int]]] = {255 + len(kids): []}
    for n in range(len(kids) - 1, -1, -1):
        p = paths[256 + n]
        for bit, kid in enumerate(kids[n]):
            paths[kid] = [*p, (n, bit)]
    length = np.array([len(paths[s]) for s in range(256)], np.int32)
    node, bits = np.zeros((int(length.max()), 256), np.int32), np.zeros((int(length.max()), 256), np.uint8)
    for s in range(256):
        for d, (n, bit) in enumerate(paths[s]):
            node[d, s], bits[d, s] = n, bit
    return kids, length, node, bits


def stretched(counts: np.ndarray, kids: list[tuple[int, int]]) -> np.ndarray:
    """int8 of SCALE times ln(p / (1 - p)) for all rows (n, 256 bytes) and nodes, p: that the bit is 1."""
    n = len(counts)
    inner = np.zeros((256, n), np.int64)
    leaves = counts.T
    out = np.zeros((n, 256), np.int8)
    for k, (a, b) in enumerate(kids):
        left, right = (leaves[x] if x < 256 else inner[x - 256] for x in (a, b))
        inner[k] = left + right
        s = np.log((right + 0.3) / (left + 0.3)) * SCALE
        out[:, k] = np.clip(np.rint(s), -120, 120).astype(np.int8)
    return out.reshape(-1)


def long_contexts(buf: np.ndarray, off: np.ndarray, nb: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The long contexts of some rows.

    Starts of all words that have a context in their row; which of the entries each one is; and the entries, each row's distinct contexts in order of bucket and key: bucket, key of 32 bits, and the AHEAD bytes
    that follow first (as one number, the first byte lowest; 0 beyond the word).
    """
    starts, ends, of_row = words(buf, off, byte_class("space"))
    row = np.repeat(np.arange(len(off) - 1), np.diff(of_row))
    if len(starts) <= WORDS:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint32), z.astype(np.uint32)
    h = gram_hashes(word_hashes(buf, starts, ends), WORDS)[:-1]
    inside = np.flatnonzero(row[WORDS:] == row[:-WORDS])
    h, at, size, row = h[inside], starts[WORDS:][inside], (ends - starts)[WORDS:][inside], row[WORDS:][inside]
    bucket = ((h >> np.uint64(32)) % np.uint64(nb)).astype(np.int64)
    key = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | key, kind="stable")  # words are in order of their rows already
    b, k, r = bucket[order], key[order], row[order]
    first = np.ones(len(order), bool)
    first[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    entry = np.zeros(len(order), np.int64)
    entry[order] = np.cumsum(first) - 1
    lead = order[first]
    padded = np.concatenate([buf, np.zeros(AHEAD, np.uint8)])
    after = np.zeros(len(lead), np.uint32)
    for i in range(AHEAD):
        after |= np.where(size[lead] > i, padded[at[lead] + i], 0).astype(np.uint32) << np.uint32(8 * i)
    return at, entry, bucket[lead], key[lead], after


def followers(key: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry, what followed its key most often in the others (of equals the smaller number), and SCALE times the log-odds of that; 0 and 0 if there are no others."""
    n = len(key)
    both = (key.astype(np.uint64) << np.uint64(32)) | after
    order = np.argsort(both, kind="stable")
    s = both[order]
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int8)
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    many = np.diff(np.append(edge, n))
    k = s[edge] >> np.uint64(32)
    # each key's followers, the most frequent first
    rank = np.lexsort((s[edge], -many, k))
    kr = k[rank]
    head = np.flatnonzero(np.concatenate([[True], kr[1:] != kr[:-1]]))
    sizes = np.diff(np.append(head, len(kr)))
    group = np.empty(len(edge), np.int64)
    group[rank] = np.repeat(np.arange(len(head)), sizes)
    top = rank[head]
    second = np.where(sizes > 1, rank[np.minimum(head + 1, len(rank) - 1)], -1)
    total = np.bincount(group, weights=many).astype(np.int64)
    # a follower's own entries see one less of it
    mine = np.arange(len(edge))
    t, u = top[group], second[group]
    c_top = many[t] - (t == mine)
    c_second = np.where(u >= 0, many[u], 0)
    fall = (t == mine) & (u >= 0) & ((c_top < c_second) | ((c_top == c_second) & (s[edge][u] < s[edge][t])))
    best, c = np.where(fall, u, t), np.where(fall, c_second, c_top)
    others = total[group] - 1
    sure = np.clip(np.rint(np.log((c + 0.3) / (others - c + 0.3)) * SCALE), -120, 120)
    word = (s[edge][best] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    word, sure = np.where(c > 0, word, 0).astype(np.uint32), np.where(c > 0, sure, 0).astype(np.int8)
    out, strength = np.empty(n, np.uint32), np.empty(n, np.int8)
    out[order], strength[order] = np.repeat(word, many), np.repeat(sure, many)
    return out, strength


def guesses(buf: np.ndarray, at: np.ndarray, word: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The predicted byte and its strength (0: none) for every byte of buf. at: starts of words; word, sure: what is predicted there."""
    byte, strength = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.int8)
    for i in range(AHEAD):
        b = ((word >> np.uint32(8 * i)) & np.uint32(255)).astype(np.uint8)
        keep = (b > 0) & (sure != 0) & (at + i < len(buf))
        at, word, sure, b = at[keep], word[keep], sure[keep], b[keep]
        byte[at + i], strength[at + i] = b, sure
        same = buf[at + i] == b
        at, word, sure = at[same], word[same], sure[same]
    return byte, strength


def bits_of(buf: np.ndarray, off: np.ndarray, fold: np.ndarray, model: dict, byte: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Bits that each row costs. byte, strength: what the long contexts predict, see guesses."""
    rows, P, depths = len(off) - 1, len(ORDERS) + 1, model["node"].shape[0]
    cost = np.zeros(rows)
    size = np.diff(off)
    padded = np.concatenate([np.zeros(8, np.uint8), buf])
    other = 1 - fold
    # documents in order of length, so that those with a next block come first
    mine = np.flatnonzero(size > 0)
    mine = mine[np.argsort(-size[mine], kind="stable")]
    weights = np.full((depths, P, len(mine)), START, np.float32)
    apm = np.tile(((np.arange(APM_CELLS + 1) - APM_CELLS / 2) / 1.5).astype(np.float32), (len(mine), 1))
    apm = (1 / (1 + np.exp(-apm))).astype(np.float32)
    done, step, n = 0, 0, len(mine)
    while True:
        block = BLOCKS[min(step, len(BLOCKS) - 1)]
        n = int(np.searchsorted(-size[mine[:n]], -done, side="left"))  # longer than done
        if not n:
            break
        width = max(1, (1 << 16) // block)
        for i in range(0, n, width):
            j = min(n, i + width)
            doc = mine[i:j]
            length = np.minimum(block, size[doc] - done)
            lane = np.repeat(np.arange(j - i), length)
            at = np.arange(len(lane)) - np.repeat(np.cumsum(length) - length, length) + (off[doc] + done)[lane]
            cost[doc] += _block(padded, at, off[doc][lane], other[doc][lane], lane, j - i, model, weights[:, :, i:j], apm[i:j], byte[at], strength[at])
        done += block
        step += 1
    return cost


def _block(padded, at, row_start, side, lane, lanes, model, weights, apm, byte, strength) -> np.ndarray:
    """Costs a block of some documents, then moves their weights and adaptive maps (both in place)."""
    sym = padded[at + 8]
    rows = [(r + side * n) * 256 for r, n in zip(rows_of(padded, at, row_start), _ROWS)]
    tables = model["tables"]
    out = np.zeros(lanes)
    length = model["length"][sym]
    keep = None
    P = len(rows)
    # places with a guess whose path is still the one taken
    on = np.flatnonzero(strength)
    byte, strength = byte[on], strength[on].astype(np.float32)
    seen, true = np.zeros(lanes * (APM_CELLS + 1)), np.zeros(lanes * (APM_CELLS + 1))
    flat_apm = apm.reshape(-1)
    for d in range(int(length.max()) if len(length) else 0):
        if d:
            keep = np.flatnonzero(length > d)
            if not len(keep):
                break
            if len(keep) < len(sym):
                length_before = length
                sym, lane, length, rows = sym.take(keep), lane.take(keep), length.take(keep), [r.take(keep) for r in rows]
                place = np.full(len(length_before), -1)
                place[keep] = np.arange(len(keep))
                on = place[on]
                still = on >= 0
                on, byte, strength = on[still], byte[still], strength[still]
        node = model["node"][d].take(sym)
        ones = model["bits"][d].take(sym)
        bit = ones.astype(np.float32)
        st = [t.take(r + node).astype(np.float32) for t, r in zip(tables, rows)]
        w = weights[d]
        dot = st[0] * w[0].take(lane)
        for k in range(1, P):
            dot += st[k] * w[k].take(lane)
        if len(on):
            still = (model["node"][d][byte] == node[on]) & (model["length"][byte] > d)
            if not still.all():
                on, byte, strength = on[still], byte[still], strength[still]
            guess, who_on = strength * (2 * model["bits"][d][byte].astype(np.float32) - 1), lane[on]
            dot[on] += guess * w[P][who_on]
        dot *= np.float32(1 / SCALE)
        np.clip(dot, -11, 11, out=dot)
        p = np.exp(-dot)
        p += 1
        np.reciprocal(p, out=p)
        err = bit - p
        cell = np.rint(dot * np.float32(1.5)).astype(np.int32)
        cell += APM_CELLS // 2
        np.clip(cell, 0, APM_CELLS, out=cell)
        cell += lane.astype(np.int32) * (APM_CELLS + 1)
        refined = p * np.float32(1 - APM_SHARE)
        refined += flat_apm.take(cell) * np.float32(APM_SHARE)
        cell *= 2
        cell += ones
        fell = np.bincount(cell, minlength=2 * len(seen)).reshape(-1, 2)
        seen += fell.sum(1)
        true += fell[:, 1]
        # probability of the bit that came
        refined *= 2 * bit - 1
        refined += 1 - bit
        np.clip(refined, 1e-5, 1, out=refined)
        np.log2(refined, out=refined)
        edge = np.flatnonzero(np.diff(lane, prepend=-1))
        who = lane[edge]
        out[who] -= np.add.reduceat(refined, edge, dtype=np.float64)
        n = np.diff(np.append(edge, len(lane))).astype(np.float32)
        scale = RATE / SCALE * np.sqrt(n) / n * 8
        for k in range(P):
            w[k][who] += np.add.reduceat(err * st[k], edge) * scale
        if len(on):
            w[P][who] += np.bincount(who_on, err[on] * guess, minlength=lanes)[who].astype(np.float32) * scale
    moved = 1 - (1 - APM_RATE) ** seen
    flat = np.where(seen > 0, true / np.maximum(seen, 1), 0)
    apm += (moved * (flat - flat_apm) * (seen > 0)).reshape(apm.shape).astype(np.float32)
    return out


def _payload(counts: np.ndarray) -> bytes:
    cell = np.flatnonzero(counts)
    return np.concatenate([np.diff(cell, prepend=0).astype(np.uint32), counts[cell].astype(np.uint32)]).tobytes()


def _add(payload: bytes, into: np.ndarray) -> None:
    x = np.frombuffer(payload, np.uint32)
    half = len(x) // 2
    into[np.cumsum(x[:half], dtype=np.int64)] += x[half:]


def gather(docs: DataFrame) -> DataFrame:
    """Counts of the corpus by half, order and part of the table. docs: text, and fold."""

    def one(batches):
        into = [np.zeros(FOLDS * n * 256, np.int32) for n in _ROWS]
        for batch in batches:
            buf, off = utf8(batch.column(0))
            fold = fold_of(batch.column(1).to_numpy())
            for i, j in chunks(off, 6 << 20):
                count(buf[off[i] : off[j]], off[i : j + 1] - off[i], fold[i:j], into)
        got = []
        for f in range(FOLDS):
            for k in range(len(ORDERS)):
                for part, c in enumerate(np.split(np.split(into[k], FOLDS)[f], PARTS)):
                    if c.any():
                        got.append((f, k, part, _payload(c)))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["fold", "ord", "part", "payload"])

    def add(t: pa.Table) -> pa.Table:
        f, k, part = (t.column(c)[0].as_py() for c in ("fold", "ord", "part"))
        into = np.zeros(_ROWS[k] * 256 // PARTS, np.int64)
        for x in t.column("payload"):
            _add(x.as_py(), into)
        return pa.table({"fold": pa.array([f], pa.int32()), "ord": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "payload": pa.array([_payload(np.minimum(into, 2**32 - 1))], pa.binary())})

    return docs.mapInArrow(one, GATHERED).groupBy("fold", "ord", "part").applyInArrow(add, GATHERED)


def build(rows: list) -> dict:
    """The model from the gathered counts (rows of fold, ord, part, payload); tables have a fixed size whatever the corpus' size."""
    counts = [[np.zeros(n * 256, np.int64) for n in _ROWS] for _ in range(FOLDS)]
    for r in rows:
        size = _ROWS[r["ord"]] * 256 // PARTS
        _add(r["payload"], counts[r["fold"]][r["ord"]][r["part"] * size : (r["part"] + 1) * size])
    freq = sum(counts[f][0].reshape(-1, 256).sum(0) for f in range(FOLDS)) + 1
    kids, length, node, bits = huffman(freq)
    return {"tables": [np.concatenate([stretched(side[k].reshape(-1, 256), kids) for side in counts]) for k in range(len(ORDERS))], "length": length, "node": node, "bits": bits}


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (of UTF-8), lm_bits (rounded to 3 digits) and lm_bpb, bits per byte (rounded to 6 digits).

    All of docs are both corpus and scored. A null or empty text has 0 bytes, 0 bits and a null bpb. Ids may be null or repeated: every
    row is a document, and of what follows a long context each sees the other rows; equal texts have equal scores. Whole texts are scored, whatever their length. Of bytes that are equally frequent the smaller value gets the place in the code that the heap gives it first, so
    the code is the same in any run. Counts of a byte after a context stay below 2^32: more count as so many. Long contexts are told apart by 32 bits within a bucket. An empty docs gives no rows. docs is read three times and must give the same
    rows in the same order, as files do; if it doesn't, the job fails. Other columns are not looked at.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    d = docs.select(F.col(id_col), F.col(text_col).alias("t_"), F.xxhash64(F.col(text_col)).alias("h_"))
    model = build(gather(d.select("t_", "h_")).collect())
    shared = spark.sparkContext.broadcast(model)
    nb = buckets(spark)
    names = bucket_names(spark, nb)

    def pieces(batches):
        """Pieces of about TRAVEL bytes of text; their names follow from where and what they are, so they are the same whenever the rows are read."""
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, off = utf8(batch.column(1))
            h = batch.column(2).to_numpy().view(np.uint64)
            for i, j in chunks(off, TRAVEL):
                yield f"{task}-{seq}-{int(gram_hashes(h[i:j], j - i)[0]):x}", batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
                seq += 1

    def texts(batches):
        for name, piece, _, _ in pieces(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(piece)
            yield _sent([(name, -1, sink.getvalue().to_pybytes())])

    def contexts(batches):
        for name, _, buf, off in pieces(batches):
            _, _, bucket, key, after = long_contexts(buf, off, nb)
            cuts = np.searchsorted(bucket, np.arange(nb + 1))
            yield _sent([(name, int(names[b]), _pressed(np.diff(key[a:z], prepend=np.uint32(0)), after[a:z])) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a])

    def predict(t: pa.Table) -> pa.Table:
        got = [_unpressed(x.as_py()) for x in t.column("payload")]
        size = np.cumsum([0] + [len(g[0]) for g in got])
        keys, after = [np.cumsum(g[0], dtype=np.uint32) for g in got], [g[1] for g in got]
        del got
        word, sure = np.empty(size[-1], np.uint32), np.empty(size[-1], np.int8)
        bounds = np.linspace(0, 1 << 32, int(size[-1]) // SLICE + 2).astype(np.int64)
        cuts = [np.searchsorted(k.astype(np.int64), bounds) for k in keys]
        for s in range(len(bounds) - 1):
            spans = [(c[s], c[s + 1]) for c in cuts]
            w, u = followers(np.concatenate([k[a:z] for k, (a, z) in zip(keys, spans)]), np.concatenate([x[a:z] for x, (a, z) in zip(after, spans)]))
            at = np.cumsum([0] + [z - a for a, z in spans])
            for i, (a, z) in enumerate(spans):
                word[size[i] + a : size[i] + z], sure[size[i] + a : size[i] + z] = w[at[i] : at[i + 1]], u[at[i] : at[i + 1]]
        rows = [(n.as_py(), b.as_py(), _pressed(word[size[i] : size[i + 1]], sure[size[i] : size[i + 1]].astype(np.int32).view(np.uint32))) for i, (n, b) in enumerate(zip(t.column("batch"), t.column("bucket")))]
        return pa.Table.from_batches([_sent(rows)])

    def finish(own: pa.Table, t: pa.Table) -> pa.Table:
        parts = {b.as_py(): x.as_py() for b, x in zip(t.column("bucket"), t.column("payload"))}
        if own.num_rows != 1:
            raise ValueError("docs gave other rows when read again; write them first")
        batch = pa.ipc.open_stream(own.column("payload")[0].as_py()).read_all().combine_chunks()
        buf, off = utf8(batch.column(1))
        at, entry, bucket, _, _ = long_contexts(buf, off, nb)
        got = [_unpressed(parts[int(b)]) for b in names if int(b) in parts]
        word = np.concatenate([np.zeros(0, np.uint32)] + [g[0] for g in got])
        sure = np.concatenate([np.zeros(0, np.uint32)] + [g[1] for g in got]).view(np.int32).astype(np.int8)
        if len(word) != len(bucket):
            raise ValueError("docs gave other rows when read again; write them first")
        bits = bits_of(buf, off, fold_of(batch.column(2).to_numpy()), shared.value, *guesses(buf, at, word[entry], sure[entry]))
        size = np.diff(off)
        bpb = np.round(bits / np.maximum(size, 1), 6)
        return pa.table([batch.column(0), pa.array(size.astype(np.int64)), pa.array(np.round(bits, 3)), pa.array(bpb, mask=size == 0)], names=[id_col, "n_bytes", "lm_bits", "lm_bpb"])

    many = 4 * nb
    guessed = d.mapInArrow(contexts, SENT).repartition(nb, "bucket").groupBy("bucket").applyInArrow(predict, SENT).repartition(many, "batch")
    scored = d.mapInArrow(texts, SENT).repartition(many, "batch").groupBy("batch").cogroup(guessed.groupBy("batch"))
    return scored.applyInArrow(finish, f"`{id_col}` {kind}, n_bytes long, lm_bits double, lm_bpb double")


def _pressed(*columns: np.ndarray) -> bytes:
    """Columns of 32 bits and equal length, compressed, after their number of bytes."""
    raw = np.concatenate([c.view(np.uint8).reshape(-1, 4).T.reshape(-1) for c in map(np.ascontiguousarray, columns)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpressed(x: bytes) -> list[np.ndarray]:
    """The two columns of _pressed."""
    size = int.from_bytes(x[:8], "little")
    raw = np.frombuffer(pa.decompress(x[8:], size, "zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(half.reshape(4, -1).T).view(np.uint32).reshape(-1) for half in np.split(raw, 2)]


def _sent(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["batch", "bucket", "payload"])


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
