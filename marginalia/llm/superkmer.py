"""Substring dedup: words covered by a window that an earlier document holds too.

Words are runs of anything but white space; a window is ``k`` consecutive words of one document. Neighbouring
windows share most words, so they travel together (super-k-mers): each window has a minimiser, the smallest
hash of the ``m``-word pieces in it; consecutive windows with one minimiser are one packed string, which
belongs to the minimiser's bucket. Equal windows have equal minimisers, so they meet in one bucket.

1. One pass over the texts writes, for every packed string, its document, place, minimiser and 128-bit
   hash, and not the string itself.
2. Equal strings are counted as one, with the smallest and largest document; copies of a passage are combined
   before they are shuffled. Where a bucket has one string only, that is all there is to know.
3. For buckets of several strings and documents, each distinct string is fetched once, from its first
   document. In the bucket its windows are sorted by their words; of equal ones the smallest document
   counts for all. A bucket of more than ``HOT`` windows is not sorted in one task: its windows are
   spread by 128-bit hashes over all tasks and counted there.
4. Places learn from their string which windows an earlier document has; each document's stretches are gathered
   and its words cut.

Documents are told apart by id and a hash of their text. Defined results: a null or empty text has no words;
a document with a null id is neither earlier nor later than any other, so it loses nothing and takes nothing;
rows that repeat one id do not take from each other; input columns named like an output column are replaced;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, few, materialize, table, utf8_of
from .shingles import WordHashes, forget, mix

WINDOW, PIECE = 50, 8
#: Windows that one packed string may hold, and that one task may sort as a bucket.
LONGEST, HOT = 512, 1 << 17

_WORDS = WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def minimisers(words: list[bytes], k: int, m: int) -> np.ndarray:
    """The smallest hash of the ``m``-word pieces of each window."""
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(w) - m + 1
    with np.errstate(over="ignore"):
        h = w[:n].copy()
        for i in range(1, m):
            h = h * _ODD + w[i : n + i]
    low, width, want = mix(h), 1, k - m + 1
    while 2 * width <= want:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    rest = want - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def packed(words: list[bytes], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The super-k-mers of a document: first window, number of windows, minimiser, and the string."""
    low = minimisers(words, k, m)
    n = len(low)
    new = np.ones(n, bool)
    new[1:] = low[1:] != low[:-1]
    at = np.arange(n)
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    text = b" ".join(words)
    off = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.where(first > 0, off[first - 1], 0).tolist()
    end = (off[first + count + k - 2] - 1).tolist()
    return first, count, low[first].view(np.int64), [text[a:b] for a, b in zip(start, end)]


PLACES = "d long, tag long, pos int, count int, mini long, h1 long, h2 long"


def places(docs: DataFrame, k: int, m: int) -> DataFrame:
    """A row per super-k-mer of each document (d, tag, text)."""

    def run(batches):
        for b in batches:
            ds, tags, parts = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for d, tag, text in zip(ds, tags, utf8_of(b)):
                words = text.split() if text else []
                if len(words) < k:
                    continue
                first, count, mini, strings = packed(words, k, m)
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), np.int64).reshape(-1, 2)
                parts.append((np.full(len(first), d), np.full(len(first), tag), first, count, mini, h[:, 0], h[:, 1]))
            if parts:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), types)], names=["d", "tag", "pos", "count", "mini", "h1", "h2"])
        _WORDS.clear()
        forget()

    return docs.select("d", "tag", "text").mapInArrow(run, PLACES)


STRINGS = "mini long, h1 long, h2 long, lo long, hot boolean, string binary"


def fetched(docs: DataFrame, k: int) -> DataFrame:
    """The strings at the places ``want`` of each document (d, text, want)."""

    def run(batches):
        for b in batches:
            out = []
            for d, text, want in zip(b.column(0).to_pylist(), utf8_of(b), b.column(2).to_pylist()):
                words = text.split()
                out += [(w["mini"], w["h1"], w["h2"], d, w["hot"], b" ".join(words[w["pos"] : w["pos"] + w["count"] + k - 1])) for w in want]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["mini", "h1", "h2", "lo", "hot", "string"])

    return docs.select("d", "text", "want").mapInArrow(run, STRINGS)


def windows(string: bytes, k: int) -> Iterator[bytes]:
    """The windows of a packed string, each by its words."""
    ends = [i for i, c in enumerate(string) if c == 32] + [len(string)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    return (string[a:b] for a, b in zip(starts, ends[k - 1 :]))


def earlier(strings: list[tuple[int, bytes]], k: int) -> dict[int, list[tuple[int, int, int]]]:
    """Of the distinct strings (first document, string) of a bucket: which windows, from a to b, an earlier
    document m has, by string number. All windows are sorted, then equal ones are neighbours."""
    every = sorted((w, lo, i, j) for i, (lo, s) in enumerate(strings) for j, w in enumerate(windows(s, k)))
    found: dict[int, list[tuple[int, int, int]]] = {}
    last, least = None, 0
    for w, lo, i, j in every:
        if w != last:
            last, least = w, lo
        elif lo > least:
            found.setdefault(i, []).append((j, j, least))
    for i, own in found.items():
        own.sort()
        joined = own[:1]
        for a, b, low in own[1:]:
            x, y, z = joined[-1]
            if a == y + 1 and low == z:
                joined[-1] = (x, b, z)
            else:
                joined.append((a, b, low))
        found[i] = joined
    return found


EXTRA = "h1 long, h2 long, extra array<struct<a: int, b: int, m: long>>"


def sorted_buckets(strings: DataFrame, k: int) -> DataFrame:
    """Buckets that one task can sort: a row per string that shares windows with an earlier one."""

    def run(batches):
        names = ("mini", "h1", "h2", "lo", "string")
        mini, held = None, []

        def flush():
            got = earlier([(lo, s) for _, lo, s in held], k)
            cols = list(zip(*[(*held[i][0], [{"a": a, "b": b, "m": m} for a, b, m in own]) for i, own in got.items()]))
            if cols:
                kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], names=["h1", "h2", "extra"])

        for b in batches:
            for bucket, h1, h2, lo, s in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names)):
                if bucket != mini:
                    yield from flush()
                    mini, held = bucket, []
                if not held or held[-1][0] != (h1, h2):  # rows that repeat a document send its strings again
                    held.append(((h1, h2), lo, s))
        yield from flush()

    own = strings.where("not hot").select("mini", "h1", "h2", "lo", "string")
    return own.repartition("mini").sortWithinPartitions("mini", "h1", "h2").mapInArrow(run, EXTRA)


def spread_buckets(strings: DataFrame, k: int) -> DataFrame:
    """The same for buckets of any size: windows are counted by hash, over all tasks."""

    def run(batches):
        for b in batches:
            for h1, h2, lo, s in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("h1", "h2", "lo", "string"))):
                w = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, windows(s, k))), np.int64).reshape(-1, 2)
                n = len(w)
                cols = [np.full(n, h1), np.full(n, h2), np.full(n, lo), np.arange(n, dtype=np.int32), w[:, 0].copy(), w[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "lo", "j", "w1", "w2"])

    every = strings.where("hot").select("h1", "h2", "lo", "string").mapInArrow(run, "h1 long, h2 long, lo long, j int, w1 long, w2 long")
    every = materialize(every, "windows")
    shared = every.groupBy("w1", "w2").agg(F.min("lo").alias("m"), F.max("lo").alias("most")).where("m < most").select("w1", "w2", "m")
    late = every.join(materialize(shared, "shared"), ["w1", "w2"]).where("lo > m")
    return late.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct(F.col("j").alias("a"), F.col("j").alias("b"), "m"))).alias("extra"))


KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])


def cut(docs: DataFrame) -> DataFrame:
    """Documents (text, __gone: stretches of words) without those words."""

    def make():
        def run(batch):
            n, gone, kept = [], [], []
            for text, own in zip(utf8_of(batch), batch.column(batch.schema.get_field_index("__gone")).to_pylist()):
                words = (text or b"").split()
                n.append(len(words))
                if own:
                    keep = np.ones(len(words), bool)
                    for r in own:
                        keep[r["a"] : r["b"]] = False
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

        return run

    return add_columns(docs, make, KEPT, keep=[c for c in docs.columns if c not in ("text", "__gone")], needs=("text", "__gone"))


def drop_repeated_windows(docs: DataFrame, k: int = WINDOW, m: int = PIECE, hot: int = HOT) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the words that are left, joined by one space, as ``text``;
    adds n_words and n_removed."""
    if not 0 < m <= k:
        raise ValueError("a piece has at least one word and at most a window's")
    keep = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    own = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("tag"), "text").where("d is not null and text is not null")
    p = materialize(places(own, k, m), "places")
    sids = p.groupBy("mini", "h1", "h2").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("count").alias("count"))
    sids = materialize(sids, "strings")
    several = sids.groupBy("mini").agg(F.count("*").alias("n"), F.min("lo").alias("x"), F.max("hi").alias("y"), F.sum("count").alias("windows"))
    several = materialize(several.where("n > 1 and x < y").select("mini", (F.col("windows") > hot).alias("hot")), "buckets")
    reps = materialize(sids.join(several, "mini").select("mini", "h1", "h2", F.col("lo").alias("d"), "hot"), "wanted")
    want = p.join(reps, ["mini", "h1", "h2", "d"]).groupBy("d", "tag").agg(F.collect_set(F.struct("pos", "count", "mini", "h1", "h2", "hot")).alias("want"))
    want = materialize(want, "places_wanted")
    # only documents that are asked for are shuffled with their texts
    asked = own.join(few(want.select("d", "tag")), ["d", "tag"], "left_semi")
    strings = materialize(fetched(asked.join(want, ["d", "tag"]), k), "fetched")
    extra = sorted_buckets(strings, k)
    if not several.where("hot").isEmpty():
        extra = extra.unionByName(spread_buckets(strings, k))
    extra = materialize(extra, "extra")
    known = sids.select("mini", "h1", "h2", "lo", "hi").join(extra, ["h1", "h2"], "left").where("lo < hi or extra is not null")
    known = materialize(known.select("mini", "h1", "h2", "lo", "extra"), "known")
    whole = F.array(F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("count") + (k - 1)).alias("b")))
    part = F.transform(F.filter("extra", lambda x: x["m"] < F.col("d")), lambda x: F.struct((F.col("pos") + x["a"]).alias("a"), (F.col("pos") + x["b"] + k).alias("b")))
    late = p.join(known, ["mini", "h1", "h2"]).select("d", "tag", F.inline(F.when(F.col("d") > F.col("lo"), whole).otherwise(part)))
    gone = late.groupBy(F.col("d").alias("__d"), F.col("tag").alias("__tag")).agg(F.collect_set(F.struct("a", "b")).alias("__gone"))
    met = (F.col("doc_id").cast("long") == F.col("__d")) & (F.xxhash64("text") == F.col("__tag"))
    return cut(docs.join(materialize(gone, "gone"), met, "left").select(*keep, "text", "__gone"))


def brute(docs: list[tuple[int | None, str | None]], k: int = WINDOW) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) by the definition; for tests."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    least: dict[tuple, int] = {}
    for d, w in split:
        for i in range(len(w) - k + 1 if d is not None else 0):
            key = tuple(w[i : i + k])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = {i + o for i in range(len(w) - k + 1 if d is not None else 0) if least[tuple(w[i : i + k])] < d for o in range(k)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def op12_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(a[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT r, doc_id, a, unnest(range(1, len(a) - {WINDOW - 2})) AS i FROM w)
), least AS (
  SELECT k, min(doc_id) AS m FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT r, i + o AS p FROM win JOIN least USING (k), range({WINDOW}) t(o) WHERE doc_id > m
), word AS (
  SELECT r, unnest(a) AS word, generate_subscripts(a, 1) AS p FROM w
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(len(a) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
