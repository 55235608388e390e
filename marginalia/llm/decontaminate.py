"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A benchmark item is cut into windows of ``window`` consecutive words; an item of fewer words
is one window. A document contains a window only if it contains all of its word shingles, so
for full containment one shingle per window is a sufficient prefix. Shingles are ordered by
rarity (documents that have them, counted over the whole corpus) and each window is indexed
under its rarest. A document's shingles probe that index; the position of the shingle fixes
where the window would begin, the length and position bounds drop what cannot fit, and the
rest is compared word by word.

The benchmark is read in blocks of about ``block_bytes`` of text, whatever its size: one block at a
time is on the driver and broadcast. With one block, documents are answered in one pass without a
shuffle. With several, each block writes marks only: a bit for each word and the items of every text that
it hits, under the text's 128-bit digest; texts themselves are never written. A last pass counts words
and joins the merged marks by digest. Counts are collected for one block's shingles at a time.

Defined results: a null or empty text has no words, is never hit; items with a null id, null
text or no words have no windows; items that share an id are one item; identical windows of
several items count for each. Repeated document rows are each answered. An empty table of
documents gives an empty one, an empty benchmark marks nothing. Input columns named like an output
column are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialize, prepare, table, utf8_of

WINDOW, SHINGLE, BLOCK_BYTES = 10, 5, 4 << 20
#: Bytes of merged marks that may be broadcast; beyond, over how many keys the copies of a text are dealt.
FEW_BYTES, SALTS = 16 << 20, 32

_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words: runs of 0-9, a-z and non-ASCII characters, after lower-casing A-Z."""
    return text.translate(_FOLD).split() if text else []


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit value of each run of ``k`` ids; 0 where a run has an unknown word (id -1)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = (ids + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = u[:n].copy()
        known = ids[:n] >= 0
        for i in range(1, k):
            h = h * _MULT + u[i : n + i]
            known &= ids[i : n + i] >= 0
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h[h == 0] = 1
    h[~known] = 0
    return h


class Block:
    """The windows of some items, and their shingles, over a vocabulary of their own words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            if ids:
                n = min(window, len(ids))
                for i in range(len(ids) - n + 1):
                    found[tuple(ids[i : i + n])].add(item)
        self.windows = [np.array(w, np.int32) for w in found]
        self.items = [sorted(v) for v in found.values()]
        self.shingle = shingle
        self.sizes = sorted({min(shingle, len(w)) for w in self.windows})
        self.of_window = [rolling(w, min(shingle, len(w))) for w in self.windows]
        self.keys = np.unique(np.concatenate(self.of_window)) if self.windows else np.zeros(0, np.uint64)
        self.index: dict[int, list[tuple[int, int]]] = {}

    def by_rarity(self, n_docs: dict[int, int]) -> "Block":
        """Index each window under its rarest shingle; a window with a shingle that no
        document has cannot occur and is left out."""
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for w, own in enumerate(self.of_window):
            rare = [(n_docs.get(int(h), 0), int(h), i) for i, h in enumerate(own)]
            n, h, i = min(rare)
            if n:
                at[h].append((w, i))
        self.index = dict(at)
        self.keys = np.array(sorted(at), np.uint64)
        del self.of_window
        return self

    def prober(self):
        """A function from a document's word ids to the places of indexed shingles."""
        keys = self.keys
        small = np.zeros(1 << 20, bool)
        small[(keys >> np.uint64(44)).astype(np.int64)] = True

        def probe(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            places, which = [], []
            for k in self.sizes:
                h = rolling(ids, k)
                at = np.flatnonzero(small[(h >> np.uint64(44)).astype(np.int64)])
                if len(at) and len(keys):
                    j = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                    same = keys[j] == h[at]
                    places.append(at[same])
                    which.append(j[same])
            if not places:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            return np.concatenate(places), np.concatenate(which)

        return probe

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def occurrences(self, ids: np.ndarray, places: np.ndarray, which: np.ndarray, hit: np.ndarray) -> set[str]:
        """Mark the words of every occurring window in ``hit``; the items that they belong to."""
        items: set[str] = set()
        for j in np.unique(which):
            at = places[which == j]
            for w, offset in self.index[int(self.keys[j])]:
                window = self.windows[w]
                start = at - offset
                start = start[(start >= 0) & (start + len(window) <= len(ids))]
                for i in range(len(window)):  # verify word by word
                    start = start[ids[start + i] == window[i]]
                    if not len(start):
                        break
                else:
                    items.update(self.items[w])
                    for i in range(len(window)):
                        hit[start + i] = True
        return items


def blocks_of(benchmark: DataFrame, window: int, shingle: int, block_bytes: int):
    """The benchmark as blocks of bounded size, dealt by a hash of the item's id; with each, whether it
    is the last. A block is made when it is asked for."""
    b = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield Block([(r.item, r.text.encode()) for r in part.toLocalIterator()], window, shingle), i == n - 1


def document_counts(docs: DataFrame, block: Block) -> dict[int, int]:
    """For each shingle of the block, the number of documents that have it."""
    if not len(block.keys):
        return {}
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        block = sent.value
        probe, n = block.prober(), np.zeros(len(block.keys), np.int64)
        for b in batches:
            for text in utf8_of(b):
                if text:
                    _, which = probe(block.ids(words_of(text)))
                    n[np.unique(which)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["i", "n"])

    rows = docs.select("text").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    sent.unpersist()
    return {int(block.keys[r.i]): r.n for r in rows}


def marks_of(docs: DataFrame, sent) -> DataFrame:
    """(key, hit, items) of the texts that a broadcast block marks: the text's digest, a bit for each
    of its words, and the items. Texts without a hit give no row, so texts are never copied."""

    def run(batches):
        block = sent.value
        probe = block.prober()
        for b in batches:
            rows = []
            for text in utf8_of(b):
                if text:
                    ids = block.ids(words_of(text))
                    places, which = probe(ids)
                    hit = np.zeros(len(ids), bool)
                    if len(places) and (items := block.occurrences(ids, places, which, hit)):
                        rows.append((_digest(text), np.packbits(hit).tobytes(), sorted(items)))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.list_(pa.string())))], names=["key", "hit", "items"])

    return docs.select("text").mapInArrow(run, "key binary, hit binary, items array<string>")


def merged_marks(marks: list[DataFrame]) -> DataFrame:
    """One row (key, n_hit, item_ids) for each text that any block marks. Copies of a text are
    marked alike, so a group holds one entry for each block at most."""
    every = reduce(DataFrame.unionByName, marks)
    grouped = every.groupBy("key").agg(F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))

    def run(batches):
        for b in batches:
            n = [int(np.bitwise_count(np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in hits])).sum()) for hits in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2)], names=["key", "n_hit", "item_ids"])

    return grouped.mapInArrow(run, "key binary, n_hit long, item_ids array<string>")


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted as strings) and contaminated."""
    spark = docs.sparkSession
    prepare(spark)
    fields = T.StructType().add("n_words", "long").add("n_hit", "long").add("item_ids", T.ArrayType(T.StringType())).add("contaminated", "boolean")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in fields.names]
    marks: list[DataFrame] = []
    for block, last in blocks_of(benchmark, window, shingle, block_bytes):
        sent = spark.sparkContext.broadcast(block.by_rarity(document_counts(docs, block)))
        if last and not marks:
            return _marked_at_once(docs, sent, fields, keep)
        marks.append(materialize(marks_of(docs, sent), "marks"))
        sent.unpersist()
    return _marked_by_text(docs, materialize(merged_marks(marks), "merged"), fields, keep)


def _marked_at_once(docs: DataFrame, sent, fields: T.StructType, keep: list[str]) -> DataFrame:
    """The columns of a benchmark of one block, in one pass without a shuffle."""

    def make():
        block = sent.value
        probe = block.prober()

        def f(b):
            words, hits, items = [], [], []
            for text in utf8_of(b):
                ids = block.ids(words_of(text))
                places, which = probe(ids)
                hit = np.zeros(len(ids), bool)
                items.append(sorted(block.occurrences(ids, places, which, hit)) if len(places) else [])
                words.append(len(ids))
                hits.append(int(hit.sum()))
            return pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([n > 0 for n in hits], pa.bool_())

        return f

    return add_columns(docs, make, fields, keep)


def _marked_by_text(docs: DataFrame, merged: DataFrame, fields: T.StructType, keep: list[str]) -> DataFrame:
    """The columns from the marks of several blocks, joined by the texts' digests. Few marks are
    broadcast; else copies of one text are dealt over ``SALTS`` keys by their doc_id."""

    def make():
        def f(b):
            texts = utf8_of(b)
            return pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array([_digest(t) if t else None for t in texts], pa.binary())

        return f

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) if "doc_id" in docs.columns else F.lit(0)
    own = add_columns(docs.withColumn("__salt", salt), make, T.StructType().add("n_words", "long").add("__key", "binary"), [*keep, "__salt"])
    marks = merged.withColumnRenamed("key", "__key")
    size = marks.agg(F.sum(F.octet_length(F.array_join("item_ids", ",")) + F.lit(64))).first()[0] or 0
    if size <= FEW_BYTES:
        out = own.join(F.broadcast(marks), "__key", "left")
    else:
        out = own.join(marks.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__key", "__salt"], "left")
    n = F.coalesce("n_hit", F.lit(0))
    return out.select(*keep, "n_words", n.cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any window of the benchmark, with the columns they came with."""
    columns = docs.columns
    marked = mark_contaminated(docs.select("*", F.struct(*columns).alias("__row")), benchmark, keep=["__row"], **options)
    return marked.where(~F.col("contaminated")).select("__row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contaminated(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """What :func:`op1_decontaminate` must return, by comparing every window everywhere."""
    out = []
    for doc_id, text in docs:
        w = words_of(text.encode() if text is not None else None)
        hit, got = set(), set()
        for item, t in items:
            v = words_of(t.encode() if t is not None else None)
            n = min(window, len(v))
            if item is None or not n:
                continue
            for i in range(len(v) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        got.add(str(item))
        sha = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(got), sha, bool(hit)))
    return out


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
h AS (SELECT doc_id, item_id, i, k FROM dw JOIN win USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
