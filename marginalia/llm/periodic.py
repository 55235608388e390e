"""Periodic runs in word sequences, by longest previous factors.

A run is a stretch of words with smallest period q, of at least ``min_length`` words and ``min_exponent``
periods, that no neighbouring word extends. Documents are independent, so nothing is shuffled: a task
takes a bounded number of words at a time, many short documents together, and gives words of
different documents different symbols, so that nothing matches across documents. Then:

1. names of all stretches of 1, 2, 4, ... words by prefix doubling: the last ones order the suffixes, and the
   names of one length tell in O(1) whether two stretches are equal (LCP, to the right and to the left);
2. the longest previous factor of each place, from its nearest neighbours in suffix order that start
   earlier;
3. LZ blocks from the factors. A run that meets a block's border is found by extending a pair of
   equal words at the border both ways (Main). Of a run [i, e) with period p, every block that starts at i + p or
   later reaches e, so the border at which it is found lies between blocks of more than (min_exponent - 1) p
   words together: only such periods are tried, less than one for each word;
4. all other runs lie inside one block, and the block's earlier copy has them too: they are copied
   from buckets of runs by their start.

Defined results: a null or empty text has no words and no runs; rows that repeat an id are rows like
any other; input columns named like an output column are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, table, utf8_of

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words taken together; a longer document is taken alone.
CHUNK = 1 << 17


def names(s: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... symbols from each place, until all differ. A name is the
    place of its first bearer in sorted order; only places that still share a name are sorted again."""
    n = len(s)
    active = np.argsort(s, kind="stable")
    rank, key, old = np.zeros(n, np.int64), s[active], np.zeros(n, np.int64)
    levels, h = [], 1
    while True:
        m = len(active)
        fresh, group, at = np.ones(m, bool), np.ones(m, bool), np.arange(m)
        fresh[1:], group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = old + first - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        size = np.diff(np.append(np.flatnonzero(fresh), m))
        active = active[np.repeat(size, size) > 1]
        if not len(active):
            return levels
        after = active + h
        key = rank[active] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old, h = rank[active], 2 * h


def ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are the same (i < j)."""
    n, i, j, got = len(levels[0]), i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for h in range(len(levels) - 1, -1, -1):
        step = ((j < n) & (levels[h][np.minimum(i, n - 1)] == levels[h][np.minimum(j, n - 1)])).astype(np.int64) << h
        i, j, got = i + step, j + step, got + step
    return got


def behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before i and before j are the same (i < j)."""
    i, j, got = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for h in range(len(levels) - 1, -1, -1):
        a, b = i - (1 << h), j - (1 << h)
        step = ((a >= 0) & (levels[h][np.maximum(a, 0)] == levels[h][np.maximum(b, 0)])).astype(np.int64) << h
        i, j, got = i - step, j - step, got + step
    return got


def previous_factors(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The length of the longest factor from each place that also starts earlier, and where it does."""
    n = len(levels[0])
    sa = np.empty(n, np.int64)
    sa[levels[-1]] = np.arange(n)
    first = levels[0][sa]  # suffixes that begin with other symbols share nothing
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for step in (-1, 1):
        near = np.arange(n) + step
        edge = np.ones(n, bool)
        if step < 0:
            edge[1:] = first[1:] != first[:-1]
        else:
            edge[:-1] = first[1:] != first[:-1]
        near[edge] = -1
        open_ = np.flatnonzero(near >= 0)
        while len(open_):  # a later neighbour passes on to its own candidate
            open_ = open_[sa[near[open_]] > sa[open_]]
            near[open_] = near[near[open_]]
            open_ = open_[near[open_] >= 0]
        at = np.flatnonzero(near >= 0)
        i, j = sa[near[at]], sa[at]
        got = ahead(levels, i, j)
        better = got > length[j]
        length[j[better]], source[j[better]] = got[better], i[better]
    return length, source


def runs_of(s: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of an array of non-negative symbols, by start and period."""
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    n = len(s)
    if n < min_length:
        return []
    levels = names(s)
    length, source = previous_factors(levels)
    borders, i, step = [], 0, np.maximum(length, 1).tolist()
    while i < n:
        borders.append(i)
        i += step[i]
    b = np.append(np.array(borders, np.int64), n)
    size = np.diff(b)
    both = np.append(size, 0) + np.insert(size, 0, 0)
    most = np.maximum(both - 1, 0) // (min_exponent - 1)
    at = np.repeat(b, most)
    p = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
    i = np.concatenate([at, at - 1 - p])  # the words at and p after the border, or p before and at its left
    p = np.concatenate([p, p])
    ok = (i >= 0) & (i + p < n)
    i, p = i[ok], p[ok]
    ok = s[i] == s[i + p]
    i, p = i[ok], p[ok]
    start, end = i - behind(levels, i, i + p), i + p + ahead(levels, i, i + p)
    ok = end - start >= np.maximum(min_length, min_exponent * p)
    smallest: dict[tuple[int, int], int] = {}
    for x, y, q in zip(start[ok].tolist(), end[ok].tolist(), p[ok].tolist()):
        smallest[x, y] = min(q, smallest.get((x, y), q))
    if not smallest:
        return []
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (x, y), q in smallest.items():
        buckets.setdefault(x, []).append((y, q))
    for k in np.flatnonzero(size >= min_length + 2).tolist():
        here, there, long = borders[k], int(source[borders[k]]), int(size[k])
        for x in range(there + 1, there + long - min_length):
            for y, q in buckets.get(x, ()):
                if y < there + long:
                    buckets.setdefault(x + here - there, []).append((y + here - there, q))
    return sorted(((x, y, q) for x, own in buckets.items() for y, q in own), key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic tail: in every tenth document, by the hash of its id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


FIELDS = T.StructType([
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()), T.StructField("runs", T.StringType()),
    T.StructField("collapsed", T.StringType()),
])


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The values of :data:`FIELDS` for one document."""
    best = (None, None, None, None)
    keep = np.ones(len(words), bool)
    top = None
    for x, y, q in runs:
        keep[x + q : y] = False
        # exact ratios: a / b > c / d is a d > c b
        if top is None or (y - x) * top[2] > top[1] * q:
            top = (x, y - x, q)
    if top:
        best = (*top, 1000 * top[1] // top[2])
    text = b" ".join(words) if keep.all() else b" ".join(w for w, k in zip(words, keep.tolist()) if k)
    return (len(runs), *best, "".join(f"{x},{y - x},{q}\n" for x, y, q in runs), text)


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, change=None, digests: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with their runs: n_runs; start, length, period and exponent_milli of the
    run with the most periods (ties: the first); ``runs``, a line ``start,length,period`` for each; and
    ``collapsed``, the words without what follows a run's first period. ``change(doc_id, words)`` may
    replace the words first. With ``digests`` the two texts are SHA-256 sums (for texts that need not be kept)."""

    def make():
        def flush(held, out):
            s, base = [], 0
            for words in held:
                own: dict[bytes, int] = {}
                s.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words)) + base)
                base += len(own)
            runs = runs_of(np.concatenate(s) if s else np.zeros(0, np.int64), min_length, min_exponent)
            at, k = 0, 0
            for words in held:
                end, first = at + len(words), k
                while k < len(runs) and runs[k][0] < end:
                    k += 1
                row = described(words, [(x - at, y - at, q) for x, y, q in runs[first:k]])
                if digests:
                    row = (*row[:5], hashlib.sha256(row[5].encode()).hexdigest(), hashlib.sha256(row[6]).hexdigest())
                out.append(row)
                at = end

        def run(batch):
            out, held, n = [], [], 0
            for doc_id, text in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), utf8_of(batch)):
                words = (text or b"").split()  # exactly space and \t to \r
                if change:
                    words = change(doc_id, words)
                if held and n + len(words) > CHUNK:
                    flush(held, out)
                    held, n = [], 0
                held.append(words)
                n += len(words)
            flush(held, out)
            cols = list(zip(*out)) or [()] * 7
            last = pa.array(cols[6], pa.string() if digests else pa.binary()).cast(pa.string())
            return [*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string()), last]

        return run

    return add_columns(docs, make, FIELDS, needs=("doc_id", "text"))


def brute(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """The definition, period by period; for tests."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        x = 0
        while x + q < n:
            y = x + q
            while y < n and words[y] == words[y - q]:
                y += 1
            if y - x >= max(min_length, min_exponent * q) and not (x and words[x - 1] == words[x - 1 + q]):
                found.setdefault((x, y), q)
            x = max(x + 1, y - q)
    return sorted(((x, y, q) for (x, y), q in found.items()), key=lambda r: (r[0], r[2]))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs, change=planted, digests=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.col("runs").alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
