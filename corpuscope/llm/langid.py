"""Language ID by a bidirectional gated recurrent network over bytes.

Both directions read segments of SEGMENT bytes, many segments side by side; the forward and
backward states at a byte give the probabilities of its label, and a document's
probability of a language is the mean over its letters. The network is trained here, in numpy,
by backpropagation through time on a bounded sample of labelled rows (LABEL_ROWS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import chunks, fresh, table, utf8

HIDDEN = 6
SEGMENT = 128
#: Bounds of the training sample: distinct labelled texts of each label, characters of each text, and labels, of which the most frequent are learned (bounds of training only; whole texts are scored).
LABEL_ROWS, TRAIN_CHARS, LABELS = 300, 1536, 200
STEPS, LANES, RATE = 160, 192, 0.02
#: A document is rejected where no language reaches this mean probability, or where it has no letters.
MIN_CONFIDENCE = 0.35
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def init(classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    r, h = np.random.default_rng(seed), HIDDEN
    p = {}
    for d in "fb":
        p[d + "x"] = r.normal(0, 0.3, (3 * h, 256))  # update, reset, candidate
        p[d + "u"] = r.normal(0, 0.3, (3 * h, h))
        p[d + "o"] = r.normal(0, 0.3, (classes, h))
    p["c"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _soft(a: np.ndarray) -> np.ndarray:
    """a / (1 + |a|), in place: the squashing function, whose slope is (1 - |s|)^2 at the value s."""
    d = np.abs(a)
    d += 1
    a /= d
    return a


def _gates(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: gates are 0.5 (1 + soft), the new state mixes the old one and the candidate."""
    k = len(h)
    g = u[: 2 * k] @ h
    g += x[: 2 * k]
    _soft(g)
    g += 1
    g *= 0.5
    z, r = g[:k], g[k:]
    rh = r * h
    n = u[2 * k :] @ rh
    n += x[2 * k :]
    _soft(n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, rh


def gradients(p: dict[str, np.ndarray], x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross entropy of the letters' labels, and its gradients by backpropagation through time. x: bytes (T, B) of segments, length and label of each.

    As in scoring, the backward direction starts at a segment's own end.
    """
    T, B = x.shape
    k, kind = len(p["fu"][0]), p["c"].dtype
    inside = np.arange(T)[:, None] < length
    letters = (_LETTER[x] & inside).astype(kind)
    tape, logits = {}, np.zeros((T, len(p["c"]), B), kind) + p["c"]
    for d in "fb":
        h, rows = np.zeros((k, B), kind), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            new, z, r, n, rh = _gates(p[d + "x"][:, x[t]], p[d + "u"], h)
            if d == "b":
                new *= inside[t]
            rows.append((t, h, z, r, n, rh, new))
            h = new
            logits[t] += p[d + "o"] @ h
        tape[d] = rows
    logits -= logits.max(1, keepdims=True)
    e = np.exp(logits)
    e /= e.sum(1, keepdims=True)
    many = max(1.0, float(letters.sum()))
    loss = -float((np.log(e[:, y, np.arange(B)] + 1e-30) * letters).sum()) / many
    e[:, y, np.arange(B)] -= 1
    e *= (letters / many)[:, None, :]
    g = {q: np.zeros_like(v) for q, v in p.items()}
    g["c"] = e.sum((0, 2))[:, None]
    for d in "fb":
        u, dh, dxs, at = p[d + "u"], np.zeros((k, B), kind), [], []
        for t, h, z, r, n, rh, new in reversed(tape[d]):
            g[d + "o"] += e[t] @ new.T
            dh = dh + p[d + "o"].T @ e[t]
            if d == "b":
                dh = dh * inside[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            drh = u[2 * k :].T @ dn
            dz, dr = (q * 0.5 * (1 - np.abs(2 * v - 1)) ** 2 for q, v in ((dh * (h - n), z), (drh * h, r)))
            dg = np.concatenate([dz, dr, dn])
            g[d + "u"][: 2 * k] += dg[: 2 * k] @ h.T
            g[d + "u"][2 * k :] += dn @ rh.T
            dh = dh * z + drh * r + u[: 2 * k].T @ dg[: 2 * k]
            dxs.append(dg)
            at.append(x[t])
        flat, idx = np.concatenate(dxs, 1), np.concatenate(at)
        for row in range(3 * k):
            g[d + "x"][row] = np.bincount(idx, flat[row], 256)
    return loss, g


def train(texts: list[bytes], labels: list[int], classes: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the mean cross entropy of all letters' labels. Texts are cut into segments; a short text, and the rest of a long one, are short segments."""
    p, rng, T = init(classes, seed), np.random.default_rng(seed + 1), 64
    segs = [(t[i : i + T], y) for t, y in zip(texts, labels) for i in range(0, len(t), T) if i == 0 or len(t) - i >= T // 4]
    segs = [(np.frombuffer(t, np.uint8), y) for t, y in segs if _LETTER[np.frombuffer(t, np.uint8)].any()]
    if not segs:
        return p
    X = np.stack([np.pad(t, (0, T - len(t))) for t, _ in segs]).T.copy()
    size, Y = np.array([len(t) for t, _ in segs]), np.array([y for _, y in segs])
    by = [np.flatnonzero(Y == c) for c in range(classes)]
    by = [b for b in by if len(b)]
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    lanes = max(1, LANES // len(by))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, lanes) for b in by])
        _, g = gradients(p, X[:, pick], size[pick], Y[pick])
        rate = RATE * (0.5 if step > steps * 0.6 else 1) * (0.4 if step > steps * 0.85 else 1)
        for q in p:
            m1[q] = 0.9 * m1[q] + 0.1 * g[q]
            m2[q] = 0.99 * m2[q] + 0.01 * g[q] ** 2
            p[q] = (p[q] - rate * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def _lanes(p: dict[str, np.ndarray], seg: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits (T, C, B) of segments (T, B); a lane's bytes beyond its length are ignored.

    The backward direction starts at a lane's own end: its state is kept at zero until then.
    """
    T, B = seg.shape
    logits = np.empty((T, len(p["c"]), B), np.float32)
    h, x = np.zeros((HIDDEN, B), np.float32), np.empty((3 * HIDDEN, B), np.float32)
    for t in range(T):
        np.take(p["fx"], seg[t], axis=1, out=x, mode="clip")
        h = _gates(x, p["fu"], h)[0]
        np.matmul(p["fo"], h, out=logits[t])
    h = np.zeros((HIDDEN, B), np.float32)
    shortest = int(length.min())
    for t in range(T - 1, -1, -1):
        np.take(p["bx"], seg[t], axis=1, out=x, mode="clip")
        h = _gates(x, p["bu"], h)[0]
        if t >= shortest:
            h *= length > t
        logits[t] += p["bo"] @ h
    logits += p["c"]
    return logits


def score(p: dict[str, np.ndarray], buf: np.ndarray, off: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: mean probabilities (rows, C), positions by label (rows, C), letters."""
    rows, classes, T = len(off) - 1, len(p["c"]), SEGMENT
    pooled, counts, letters = np.zeros((rows, classes)), np.zeros((rows, classes), np.int64), np.zeros(rows, np.int64)
    segs = -(-np.diff(off) // T)
    row = np.repeat(np.arange(rows), segs)
    first = np.repeat(np.cumsum(segs) - segs, segs)
    start = off[row] + (np.arange(len(row)) - first) * T
    length = np.minimum(T, off[row + 1] - start)
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(T, np.uint8)]), T)
    for i in range(0, len(row), lanes):
        r, n = row[i : i + lanes], length[i : i + lanes]
        seg = window[start[i : i + lanes]].T.astype(np.intp, order="C")
        e = _lanes(p, seg, n)
        use = _LETTER[seg]
        use &= np.arange(T)[:, None] < n
        letters += np.bincount(r, use.sum(0), rows).astype(np.int64)
        top = e.max(1)
        free = use.copy()
        for c in range(classes):  # of equal labels the first counts
            is_c = (e[:, c] == top) & free
            free &= ~is_c
            counts[:, c] += np.bincount(r, np.count_nonzero(is_c, axis=0), rows).astype(np.int64)
        e -= top[:, None]
        np.exp(e, out=e)
        weight = e.sum(1)
        np.divide(use, weight, out=weight)
        for c in range(classes):
            pooled[:, c] += np.bincount(r, np.einsum("tb,tb->b", e[:, c], weight), rows)
    pooled /= np.maximum(letters, 1)[:, None]
    return pooled, counts, letters


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rows: int = LABEL_ROWS, chars: int = TRAIN_CHARS, steps: int = STEPS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages in order, and the network. Of each label a bounded number of distinct texts is learned from, those of the smallest hashes, so that rare labels have theirs and copies count once.

    Rows with a null label, or a null or empty text or one without letters in its first chars, are no examples. With no examples there are no languages, and detect() rejects all. Of texts that have several labels each is an example.
    """
    t, y = F.substring(F.col(text_col), 1, chars), F.col(lang_col)
    own = labelled.select(y.alias("y"), t.alias("t")).where(F.col("y").isNotNull() & F.col("t").rlike(r"[A-Za-z]|[^\x00-\x7F]")).withColumn("k", F.xxhash64("t"))
    seen = own.groupBy("y").agg(F.approx_count_distinct("k").alias("n")).orderBy(F.desc("n"), "y").limit(LABELS).collect()
    if not seen:
        return [], init(1)
    # hashes below a cut, about three times as many as are taken: where there are fewer texts than that, all
    cut = {r.y: 2.0**63 if r.n <= 3 * rows else 3 * rows / r.n * 2.0**64 - 2.0**63 for r in seen}
    bound = F.create_map(*(F.lit(v) for pair in cut.items() for v in pair))
    near = own.where(F.col("k") <= F.coalesce(F.try_element_at(bound, F.col("y")), F.lit(-(2.0**64)))).dropDuplicates(["y", "k"])
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("k"))).where(F.col("r") <= rows)
    sample = sorted(first.select("t", "y").collect(), key=lambda r: (r.t, r.y))
    langs = sorted({r.y for r in sample})
    at = {k: i for i, k in enumerate(langs)}
    return langs, train([r.t.encode() for r in sample], [at[r.y] for r in sample], max(1, len(langs)), steps)


def detect(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], *, text_col: str = "text", prefix: str = "lid_") -> DataFrame:
    """docs with <prefix>lang, <prefix>confidence (rounded to 4 digits), <prefix>letters and <prefix>positions (labelled positions by language, in the model's order).

    A null or empty text, or one without letters, has a null language, confidence 0 and 0 positions. Ties go to the language that comes
    first in the alphabet. Equal rows get equal results. Whole texts are read, in segments of SEGMENT bytes. Extra
    columns pass through; where they clash with the added names, those get underscores. A model with no languages rejects all; an empty table gives none.
    """
    langs, net = model
    names = fresh(docs, *(prefix + n for n in ("lang", "confidence", "letters", "positions")))
    shared = docs.sparkSession.sparkContext.broadcast((langs, net))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.LongType(), T.ArrayType(T.LongType()))))])
    where = docs.columns.index(text_col)

    def run(batches):
        langs, net = shared.value
        for batch in batches:
            buf, off = utf8(batch.column(where))
            rows = len(off) - 1
            pooled, counts, letters = np.zeros((rows, max(1, len(langs)))), np.zeros((rows, max(1, len(langs))), np.int64), np.zeros(rows, np.int64)
            if langs:
                for i, j in chunks(off, 1 << 20):
                    pooled[i:j], counts[i:j], letters[i:j] = score(net, buf[off[i] : off[j]], off[i : j + 1] - off[i])
            best = pooled.argmax(1)
            some = letters > 0
            lang = pa.array([langs[b] if s else None for b, s in zip(best, some)], pa.string())
            conf = pa.array(np.where(some, np.round(pooled.max(1), 4), 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, conf, pa.array(letters), pa.array(list(counts), pa.list_(pa.int64()))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs.select("doc_id", "text"), fit(docs)).drop("text")


def keep_known(docs: DataFrame, model: tuple, *, text_col: str = "text", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of docs whose language is known with min_confidence, in docs' own columns."""
    d = detect(docs, model, text_col=text_col, prefix="lid_")
    lang, conf = d.columns[len(docs.columns)], d.columns[len(docs.columns) + 1]
    return d.where(F.col(lang).isNotNull() & (F.col(conf) >= min_confidence)).select(*docs.columns)
