"""Quality classifier: a byte-level convolutional network in numpy.

A text is laid out as half-chunks of 128 bytes. Bytes are embedded; learned filters of eight
bytes slide over them in steps of four; a filter's response is max-pooled over each chunk,
that is over two neighbouring half-chunks, so chunks overlap by half and cover the whole text
however long it is. A small dense layer reads every chunk; the mean and the maximum over all
chunks make one probability.

The network is trained on the driver from a bounded, documented sample: the whole texts of at
most ``train_rows`` labelled rows of each class, those with the smallest hashes of their ids.
Training is balanced between the classes; the score is set back to the true odds of the labels,
which are counted over all learnable rows. Texts are worked off in slabs, forward and backward,
so memory does not grow with the longest of them by more than its own size.

Defined results: null and empty texts are one chunk of padding, scored like any other; with
labels of one class only, or none (texts over the bound in bytes teach nothing), every text has that class's smoothed share as its score and
the model is ``constant``: nothing was learned. Repeated rows are each scored; of rows that share
a labelled id the smallest text is learned from, of its labels the larger one. An empty table gives
an empty table. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, discard, materialize, prepare, smallest_hashes, table, utf8_of

TRAIN_ROWS, STEPS, BATCH, CUT = 1500, 500, 32, 0.7
TRAIN_BYTES = 64 << 20  # of texts of each class
HALF, GROUP, EMBED, FILTERS, HIDDEN = 128, 4, 8, 24, 16
SLAB = 512  # half-chunks at a time


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A buffer, where each half-chunk starts in it, and how many half-chunks each text has."""
    n = np.array([max(1, -(-len(t) // HALF)) for t in texts], np.int64)
    size = n * HALF + GROUP
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    buf = bytearray(int(size.sum()))
    for t, s in zip(texts, start.tolist()):
        buf[s : s + len(t)] = t
    halves = np.repeat(start, n) + HALF * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    return np.frombuffer(buf, np.uint8), halves, n


def chunks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two half-chunks of each chunk, and how many chunks each text has."""
    first = np.cumsum(n) - n
    m = np.maximum(1, n - 1)
    a = np.repeat(first, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    b = np.minimum(a + 1, np.repeat(first + n - 1, m))
    return a, b, m


class Cnn:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1, s).astype(np.float32)
        self.p = {
            "e": g(256, EMBED) * 0.5, "w": g(GROUP * EMBED, 2 * FILTERS) * 0.18, "b": np.zeros(FILTERS, np.float32),
            "v": g(FILTERS, HIDDEN) * 0.25, "d": np.zeros(HIDDEN, np.float32), "u": g(2 * HIDDEN) * 0.2, "c": np.zeros(1, np.float32),
        }
        self.shift = 0.0
        self.constant: float | None = None

    def halves(self, buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filters max-pooled over each half-chunk, and the place of each maximum."""
        p, width = self.p, HALF + GROUP
        pooled = np.empty((len(start), FILTERS), p["w"].dtype)
        place = np.empty((len(start), FILTERS), np.int8)
        for i in range(0, len(start), SLAB):
            x = buf[start[i : i + SLAB, None] + np.arange(width)]
            y = p["e"][x].reshape(len(x), width // GROUP, GROUP * EMBED) @ p["w"]
            a = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
            at = a.argmax(axis=1)
            pooled[i : i + SLAB] = np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + p["b"], 0)
            place[i : i + SLAB] = at
        return pooled, place

    def head(self, pooled: np.ndarray, n: np.ndarray):
        p = self.p
        a, b, m = chunks(n)
        c = np.maximum(pooled[a], pooled[b])
        h = np.maximum(c @ p["v"] + p["d"], 0)
        first = np.cumsum(m) - m
        mean = np.add.reduceat(h, first, axis=0) / m[:, None]
        peak = np.maximum.reduceat(h, first, axis=0)
        z = np.concatenate([mean, peak], 1) @ p["u"] + p["c"][0]
        return z, (a, b, m, c, h, mean, peak)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        buf, start, n = layout(texts)
        return self.head(self.halves(buf, start)[0], n)[0].astype(np.float64)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) + self.shift, -60, 60)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        buf, start, n = layout(texts)
        pooled, place = self.halves(buf, start)
        z, (a, b, m, c, h, mean, peak) = self.head(pooled, n)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {"c": np.array([dz.sum()], np.float32), "u": dz @ np.concatenate([mean, peak], 1)}
        text = np.repeat(np.arange(len(m)), m)
        top = h == peak[text]
        ways = np.add.reduceat(top, np.cumsum(m) - m, axis=0)
        dh = dz[text, None] * (p["u"][:HIDDEN] / m[text, None] + p["u"][HIDDEN:] * top / ways[text])
        dh = (dh * (h > 0)).astype(np.float32)
        g["v"], g["d"] = c.T @ dh, dh.sum(0)
        dc = dh @ p["v"].T
        left = pooled[a] >= pooled[b]
        dp = np.zeros_like(pooled)
        dp[a] += dc * left  # a and b name each half-chunk once
        dp[b] += dc * ~left
        dp *= pooled > 0
        g["b"] = dp.sum(0)
        # only the winning place of each filter in each half-chunk gets a gradient
        gw, ge = np.zeros_like(p["w"]), np.zeros_like(p["e"])
        for i in range(0, len(start), SLAB):
            d, k = dp[i : i + SLAB], place[i : i + SLAB].astype(np.int64)
            for side in (0, 1):
                x = buf[(start[i : i + SLAB, None] + (k + side) * GROUP)[:, :, None] + np.arange(GROUP)]
                rows = p["e"][x].reshape(*k.shape, GROUP * EMBED)
                w = p["w"][:, side * FILTERS : (side + 1) * FILTERS]
                gw[:, side * FILTERS : (side + 1) * FILTERS] += np.matmul(rows.transpose(1, 2, 0), d.T[:, :, None])[:, :, 0].T
                de = (d[:, :, None] * w.T).reshape(-1, EMBED)
                for c in range(EMBED):
                    ge[:, c] += np.bincount(x.ravel(), de[:, c], 256)
        return g | {"w": gw, "e": ge}

    def train(self, texts: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> "Cnn":
        y = np.array(labels, np.float32)
        sides = [np.flatnonzero(y == k) for k in (0, 1)]
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            at = np.concatenate([r.choice(s, batch // 2) for s in sides])
            g = self.gradients([texts[i] for i in at], y[at])
            rate = 0.006 * (1 - t / (steps + 1)) + 1e-5
            for k, v in self.p.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                v -= (rate * m1[k] / (1 - 0.9**t) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def within(rows: list, most: int) -> list:
    """The rows (doc_id, quality, n) of each class, in order, whose sizes fit into ``most`` together."""
    used, out = {}, []
    for r in rows:
        if used.get(r.quality, 0) + r.n <= most:
            used[r.quality] = used.get(r.quality, 0) + r.n
            out.append(r)
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, steps: int = STEPS, train_bytes: int = TRAIN_BYTES) -> Cnn:
    """Train on the texts of ``docs`` that ``labels`` (doc_id, quality) marks.

    The sample is chosen among the labels, without their texts: at most ``2 * train_rows`` ids,
    a bound that makes them fit to broadcast, so texts outside the sample are never shuffled.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    model = Cnn()
    if min(n.get(0, 0), n.get(1, 0)) == 0:
        model.constant = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return model
    ids = docs.sparkSession.createDataFrame(smallest_hashes(rows, "quality", train_rows).collect(), rows.schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    texts = materialize(texts, "sample")
    sizes = texts.select("doc_id", "quality", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("at")).collect()
    fitting = {r.doc_id for r in within(sorted(sizes, key=lambda r: (r.at, r.doc_id)), train_bytes)}
    chosen = texts if len(fitting) == len(sizes) else texts.where(F.col("doc_id").isin(*fitting)) if fitting else texts.limit(0)
    found = sorted((r.doc_id, r.quality, r.text.encode()) for r in chosen.toLocalIterator())
    discard(texts)
    if len({q for _, q, _ in found}) < 2:
        model.constant = (n[1] + 1) / (n[0] + n[1] + 2)
        return model
    model.train([t for _, _, t in found], [q for _, q, _ in found], steps)
    model.shift = float(np.log(n[1] / n[0]))
    return model


def score_quality(docs: DataFrame, model: Cnn, cut: float = CUT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score and predicted (1 where the score reaches ``cut``)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType().add("score", "double").add("predicted", T.IntegerType())

    def make():
        model = sent.value

        def f(b):
            s = model.scores([t or b"" for t in utf8_of(b)])
            return pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32), pa.int32())

        return f

    return add_columns(docs, make, fields, keep)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_quality(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")
