"""Language ID by prediction by partial matching (PPM).

Training builds, per language, a variable-order tree of byte contexts (up to ``order`` bytes)
from a bounded, documented sample of labelled texts: the whole texts of at most ``train_docs``
documents of each language, those with the smallest hashes of their ids. Runs are counted in tasks and
summed by Spark, so no text comes to the driver, only distinct runs. The statistics are then frozen. A byte costs -log2 of its PPM probability (method C with exclusion left out): in a context
of n bytes seen before, with d distinct successors, a known successor has c / (n + d) and the
escape d / (n + d), which moves on to the context one byte shorter, down to 1/256 for any byte. A
whole text's code length under each language is exact; the shortest wins.

Since the statistics are frozen, what a known successor costs, and what an escape costs, are
constants. Each task puts them into sparse tables, one row for each successor that any language
knows in a context and one for each context, with the bits of all languages; a text is scored by
looking its bytes up order by order, those that are not known going on to the next shorter context.
Tables grow with the distinct strings of the sample, not with the alphabet.

Defined results: null text, or text with no letter, is ``und`` with score 0; equal code
lengths go to the smaller language name; with nothing to learn from, all are ``und``. Repeated rows
are each answered; of rows that share an id and a language the smallest text is learned from. An
empty table gives an empty table. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, prepare, smallest_hashes, table, utf8_of

ORDER, TRAIN_DOCS = 3, 400


def sample_of(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The bounded training sample: ``train_docs`` ids of each language are chosen without
    their texts, and so few ids are fit to broadcast, so texts are never shuffled."""
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ids = smallest_hashes(docs.select("doc_id", "lang"), "lang", train_docs)
    ids = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)
    return docs.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def packed(x: np.ndarray, n: int) -> np.ndarray:
    """Every run of ``n`` bytes, at most eight, as a number."""
    out = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for i in range(n):
        out = out << np.uint64(8) | x[i : i + len(out)].astype(np.uint64)
    return out


#: Bytes of which the runs are counted at once.
AT_ONCE = 4 << 20


def counts_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``n`` bytes of texts, sorted, and how often they occur. Long texts are counted
    in pieces that overlap by n - 1 bytes, so each run is counted once."""
    keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    pieces = [(i, lo) for i, text in enumerate(texts) for lo in range(0, len(text), AT_ONCE)]
    for j, (i, lo) in enumerate(pieces):
        held.append(packed(np.frombuffer(texts[i], np.uint8)[lo : lo + AT_ONCE + n - 1], n))
        size += len(held[-1])
        if size >= AT_ONCE or j == len(pieces) - 1:
            new, times = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, times]), len(both)).astype(np.int64)
            keys, held, size = both, [], 0
    return keys, counts


class Ppm:
    """Frozen counts of all languages: ``counts[lang][k]`` has the runs of k + 1 bytes, a context
    and its successor, as sorted numbers, and how often they occur."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        counts = {lang: [counts_of(texts[lang], k + 1) for k in range(order + 1)] for lang in sorted(texts)}
        self.freeze(counts, order)

    def freeze(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int) -> "Ppm":
        if order > 7:
            raise ValueError("a context has at most 7 bytes")
        self.langs, self.order, self.counts = sorted(counts), order, counts
        return self

    def bits(self, lang: str, context: bytes, byte: int) -> float:
        """The cost of a byte after a context, straight from the definition."""
        p = 1.0
        for k in range(min(self.order, len(context)), -1, -1):
            c = int.from_bytes(context[len(context) - k :])
            own = {int(g) & 255: int(n) for g, n in zip(*self.counts[lang][k]) if int(g) >> 8 == c}
            if own:
                n, d = sum(own.values()), len(own)
                if byte in own:
                    return float(-np.log2(p * own[byte] / (n + d)))
                p *= d / (n + d)
        return float(-np.log2(p / 256))

    def unfold(self) -> "Tables":
        return Tables(self)


class Lookup:
    """Places of numbers in a sorted array, by an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.place = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        rest, at = np.arange(len(keys)), self.slots(keys)
        while len(rest):
            free = self.place[at] < 0
            self.place[at[free]] = rest[free]  # of several the last stays
            own = self.place[at] == rest
            self.keys[at[own]] = keys[rest[own]]
            rest, at = rest[~own], (at[~own] + 1) & (size - 1)

    def slots(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((x * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.intp)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that are not there."""
        at = self.slots(x)
        out = self.place[at]
        rest = np.flatnonzero((out >= 0) & (self.keys[at] != x))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.place) - 1)
            out[rest] = found = self.place[at]
            again = (found >= 0) & (self.keys[at] != x[rest])
            rest, at = rest[again], at[again]
        return out


class Tables:
    """The trees as sparse tables: per order, the bits of each language for known successors and
    for the escape from known contexts. A language that does not know a successor which another one
    knows has the cost of its own way down there, so one row always settles a byte for all."""

    def __init__(self, m: Ppm):
        self.langs, self.order = m.langs, m.order
        n, self.successors, self.costs, self.contexts, self.escapes = len(m.langs), [], [], [], []
        for k in range(m.order + 1):
            keys = np.unique(np.concatenate([m.counts[lang][k][0] for lang in m.langs] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(keys >> np.uint64(8))
            escape, cost = np.zeros((len(contexts), n)), np.empty((len(keys), n))
            shorter = self.lengths_of(keys & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.full((len(keys), n), 8.0)
            where = np.searchsorted(contexts, keys >> np.uint64(8))
            for j, lang in enumerate(m.langs):
                own, times = m.counts[lang][k]
                at = np.searchsorted(contexts, own >> np.uint64(8))
                total, d = np.bincount(at, times, len(contexts)), np.bincount(at, minlength=len(contexts))
                known = d > 0
                escape[known, j] = -np.log2(d[known] / (total[known] + d[known]))
                cost[:, j] = shorter[:, j] + escape[where, j]
                cost[np.searchsorted(keys, own), j] = -np.log2(times / (total[at] + d[at]))
            self.successors.append(Lookup(keys))
            self.costs.append(cost.astype(np.float32))
            self.contexts.append(Lookup(contexts))
            self.escapes.append(escape.astype(np.float32))

    def lengths_of(self, runs: np.ndarray, k: int) -> np.ndarray:
        """The bits of the last byte of each run of ``k`` + 1 bytes, for each language."""
        out, rest = np.zeros((len(runs), len(self.langs))), np.arange(len(runs))
        for j in range(k, -1, -1):
            if not len(rest):
                return out
            runs = runs & np.uint64((1 << 8 * (j + 1)) - 1)
            at = self.successors[j].find(runs)
            known = at >= 0
            out[rest[known]] += self.costs[j][at[known]]
            runs, rest = runs[~known], rest[~known]
            if len(rest):
                at = self.contexts[j].find(runs >> np.uint64(8))
                out[rest[at >= 0]] += self.escapes[j][at[at >= 0]]
        out[rest] += 8.0
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, one row per text and one column per language."""
        out, step = np.zeros((len(texts), len(self.langs))), 1 << 18
        all_ = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for lo in range(0, len(all_), step):
            hi = min(lo + step, len(all_))
            place = np.arange(lo, hi)
            text = np.searchsorted(ends, place, "right")
            have = np.minimum(place - first[text], self.order)  # context bytes inside the text
            x = np.concatenate([np.zeros(max(0, self.order - lo), np.uint8), all_[max(0, lo - self.order) : hi]])
            runs, bits = packed(x, self.order + 1), np.empty((hi - lo, len(self.langs)))
            full = have == self.order
            bits[full] = self.lengths_of(runs[full], self.order)
            for k in range(self.order):
                if len(own := np.flatnonzero(have == k)):
                    bits[own] = self.lengths_of(runs[own], k)
            cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[cut]] += np.add.reduceat(bits, cut, axis=0)
        return out


def has_letter(text: bytes) -> bool:
    return text.translate(_NO_LETTERS) != text or (not text.isascii() and any(ch.isalpha() for ch in text.decode("utf-8", "replace")))


#: ASCII letters become NUL.
_NO_LETTERS = bytes(0 if chr(b).isalpha() and b < 128 else b for b in range(256))


def predict(tables: Tables, texts: list[bytes | None]) -> list[tuple[str, float]]:
    out = [("und", 0.0)] * len(texts)
    if not tables.langs:
        return out
    at = [i for i, t in enumerate(texts) if t and has_letter(t)]
    bits = tables.lengths([texts[i] for i in at])
    for i, row in zip(at, bits):
        k = int(row.argmin())
        out[i] = (tables.langs[k], float(1 / np.exp2(np.clip(row[k] - row, -1000, 0)).sum()))
    return out


def learned(sample: DataFrame, order: int = ORDER) -> Ppm:
    """The model of a sample (text, lang). Runs are counted where the texts are and summed by Spark; what
    comes to the driver are distinct runs and their counts, never a text."""

    def run(batches):
        for b in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(b.schema.get_field_index("lang")).to_pylist(), utf8_of(b)):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                # a language is known even if its texts are empty: k = -1
                found = [(-1, np.zeros(1, np.uint64), np.zeros(1, np.int64))] + [(k, *counts_of(own, k + 1)) for k in range(order + 1)]
                for k, keys, n in found:
                    cols = [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "k", "run", "n"])

    parts = sample.select("lang", "text").mapInArrow(run, "lang string, k int, run long, n long")
    t = parts.groupBy("lang", "k", "run").agg(F.sum("n").alias("n")).toArrow()
    code, k = t["lang"].combine_chunks().dictionary_encode(), t["k"].to_numpy()
    run_, n = t["run"].to_numpy().view(np.uint64), t["n"].to_numpy()
    which, counts = code.indices.to_numpy(), {}
    for i, lang in sorted(enumerate(code.dictionary.to_pylist()), key=lambda x: x[1]):
        counts[lang] = []
        for j in range(order + 1):
            own = np.flatnonzero((which == i) & (k == j))
            own = own[np.argsort(run_[own])]
            counts[lang].append((run_[own], n[own]))
    return Ppm.__new__(Ppm).freeze(counts, order)


def identify(docs: DataFrame, labelled: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, after learning from ``labelled`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    prepare(spark)
    model = learned(sample_of(labelled, train_docs), order)
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    fields = T.StructType().add("lang_pred", "string").add("score", "double")

    def make():
        tables = unfolded(sent, key)

        def f(b):
            got = predict(tables, utf8_of(b))
            return pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())

        return f

    return add_columns(docs, make, fields, keep)


_LAST: tuple = (None, None)


def unfolded(sent, key: str) -> Tables:
    """The tables of a broadcast model; a worker keeps those of the last one, by the model's own key (an
    object's address may be used again)."""
    global _LAST
    if _LAST[0] != key:
        _LAST = (key, sent.value.unfold())
    return _LAST[1]


def op9_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    docs = docs.withColumn("held_out", held)
    return identify(docs, docs.where(~F.col("held_out")), keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
