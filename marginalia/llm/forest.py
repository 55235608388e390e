"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Hash strings. A tree gives every vector a string of ``SYMBOLS`` symbols. A symbol names the
direction, of ``FAN`` (half of them random and orthogonal, and their opposites), that the vector
points along most, after the usual step from inner products to angles: one more coordinate that
gives all vectors one length. A tree is the array of its strings, sorted by their first ``SORTED``
symbols; it is cut into nodes by the first symbols of the strings (as many as hold a node to about
``CHUNK`` strings, two at most), and a node that is larger still into chunks. Nodes are written once.

Bands. The step to angles lets the longest vector hide how the others differ: beside one of 1,000 times
their length they all point along the added coordinate. So vectors are dealt into bands by length, each at
most half as long as the one before (``BANDS``; the last takes all that are shorter still), and every band has
a forest of its own, lifted to its own longest vector. A query searches all bands of its dimension at once,
and the exact scores of what they name are compared.

Search. In every tree a query descends along its own string. All trees then ascend together, in
steps: from an own prefix to its siblings, those of the ``WIDTHS`` closest next symbols, at last to
the whole parent. A query stops at the first step at which all trees together hold ``wanted(n)``
strings; steps above the nodes are counted from the nodes' sizes, those below in the nodes. Each
chunk then compares the whole strings of that stretch with the query's projections and names the
``shortlist(n, k)`` closest; what any tree names is scored exactly, on the original vectors.

So strings are compared for a number of entries that grows as n^0.6, and scores computed for about
n^0.5 vectors, at every size; no table is scanned because it is small. Equal vectors are one entry,
with the ``k`` + 1 smallest of its ids, so a group of copies takes one place.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null id, take no part; only vectors of equal length are compared; of rows that
share an id the one with the smallest vector counts; ties go to the smaller id; empty tables give
an empty table; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, table

K, TREES, SYMBOLS, SORTED, FAN = 20, 16, 18, 9, 128
CHUNK, FLUSH, SENT = 1 << 18, 1 << 14, 32 << 20
#: How many sibling symbols a step takes in; the last symbols first. ``FAN`` is the whole parent.
WIDTHS = np.array([128, 96, 64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2])
STEPS = len(WIDTHS)
#: Bands of length: a group ``g`` is a dimension and a band, g = dimension * BANDS + band.
BANDS = 16
NODE = ["g", "tree", "node"]


def wanted(n: int) -> int:
    """Strings, over all trees, that an ascent gathers for a query."""
    return int(30 * n**0.6) + 1


def shortlist(n: int, k: int) -> int:
    """Vectors that a chunk of a tree names for a query."""
    return k + 1 + int(0.25 * n**0.5)


# --- hash strings ---------------------------------------------------------------------------


@lru_cache(2)
def planes(d: int) -> np.ndarray:
    """Directions of every tree and symbol for vectors of ``d`` components and one more."""
    r, half = np.random.default_rng(11), FAN // 2
    out = np.empty((TREES, d + 1, SYMBOLS, half), np.float32)
    for t in range(TREES):
        for s in range(SYMBOLS):
            g = r.normal(size=(d + 1, half))
            out[t, :, s] = np.linalg.qr(g)[0] if d + 1 >= half else g / np.sqrt((g**2).sum(0))
    return out.reshape(TREES, d + 1, SYMBOLS * half)


def lifted(x: np.ndarray, longest: float | None = None) -> np.ndarray:
    """Vectors with one more coordinate: what they lack of the longest one's length; 0 for queries."""
    wide = x.astype(np.float64)
    rest = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(0, longest**2 - (wide**2).sum(1)))
    return (np.concatenate([wide, rest[:, None]], 1) / (longest or 1)).astype(np.float32)


def symbols(x: np.ndarray, tree: int) -> np.ndarray:
    """The symbols of each lifted vector in a tree."""
    out, half = np.empty((len(x), SYMBOLS), np.uint8), FAN // 2
    p = planes(x.shape[1] - 1)[tree]
    for i in range(0, len(x), 2048):
        y = (x[i : i + 2048] @ p).reshape(-1, SYMBOLS, half)
        at = np.abs(y).argmax(2)
        out[i : i + 2048] = at + half * (np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] < 0)
    return out


def word(s: np.ndarray) -> np.ndarray:
    """Symbols as one number that sorts like them."""
    out = np.zeros(len(s), np.uint64)
    for i in range(s.shape[1]):
        out = out << np.uint64(7) | s[:, i].astype(np.uint64)
    return out


def closeness(q: np.ndarray, tree: int) -> np.ndarray:
    """How far each lifted query points along each direction of each symbol of a tree."""
    y = (q @ planes(q.shape[1] - 1)[tree]).reshape(len(q), SYMBOLS, -1)
    return np.concatenate([y, -y], 2)


# --- tables ---------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (rep, d, raw, long) per distinct vector, ``long`` its length, ``raw`` its components as 64-bit numbers or, where
    they come so, as 32-bit ones; and (rep, vec_id) for every id."""
    one = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    one = materialize(one.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("v"), F.col("embedding")).alias("h2")), "vectors")
    classes = one.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.min_by("embedding", "vec_id").alias("embedding"))

    def pack(batches):
        for b in batches:
            e = b.column(3)
            flat, at = e.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(e.value_lengths().to_numpy(zero_copy_only=False)))
            raw = [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
            wide = flat.astype(np.float64)
            long = np.sqrt(np.add.reduceat(wide * wide, at[:-1])) if len(raw) else np.zeros(0)  # none is empty
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at), pa.int32()), pa.array(raw, pa.binary()), pa.array(long, pa.float64())], names=["h1", "h2", "rep", "d", "raw", "long"])

    classes = materialize(classes.mapInArrow(pack, "h1 long, h2 long, rep long, d int, raw binary, long double"), "classes")
    ids = one.select("h1", "h2", "vec_id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "vec_id")
    ids = materialize(ids, "ids")
    discard(one)
    return classes.select("rep", "d", "raw", "long"), ids


def matrix(b: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    """A column of packed vectors of one length, in double precision."""
    raw = b"".join(b.column(b.schema.get_field_index(name)).to_pylist())
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * d * len(b) else np.float64).reshape(len(b), d).astype(np.float64)


def column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def by_length(b: pa.RecordBatch, name: str = "d"):
    """The parts of a batch whose vectors have one dimension (or are of one group)."""
    d = column(b, name)
    for n in np.unique(d):
        yield int(n), b.filter(pa.array(d == n)) if (d != n).any() else b


def nodes_of(s: np.ndarray, depth: int) -> np.ndarray:
    return word(s[:, :depth]).astype(np.int64) if depth else np.zeros(len(s), np.int64)


def banded(classes: DataFrame) -> DataFrame:
    """``classes`` with their group: dimension and band."""
    top = classes.groupBy("d").agg(F.max("long").alias("__top"))
    ratio = F.least(F.try_divide("__top", "long"), F.lit(2.0 ** (BANDS - 1)))  # null or not a number: squares under- or overflow
    band = F.when(F.isnan(ratio) | ratio.isNull(), F.when(F.col("long") > 0, 0).otherwise(BANDS - 1)).otherwise(F.floor(F.log2(ratio)))
    return classes.join(F.broadcast(top), "d").withColumn("g", (F.col("d") * BANDS + band).cast("int")).drop("__top")


def plant(classes: DataFrame, longest: dict[int, float], depth: dict[int, int]) -> DataFrame:
    """The forests as rows of sorted chunks: g, tree, node, chunks, ids, keys, tails."""
    spark = classes.sparkSession

    def strings(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        for g, b in by_length(pa.Table.from_batches(held).combine_chunks().to_batches()[0], "g") if sum(map(len, held)) else ():
            ids, x = column(b, "rep"), lifted(matrix(b, "raw", g // BANDS), longest[g])
            for t in range(TREES):
                s = symbols(x, t)
                node, keys, tails = nodes_of(s, depth[g]), word(s[:, :SORTED]), word(s[:, SORTED:])
                order = np.argsort(node, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], np.diff(node[order]) != 0]))
                parts = [order[i:j] for i, j in zip(cut, np.append(cut[1:], len(order)))]
                cols = [[g] * len(parts), [t] * len(parts), [node[p[0]] for p in parts], [len(p) for p in parts]]
                raw = [[v[p].tobytes() for p in parts] for v in (ids, keys, tails)]
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *(pa.binary(),) * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols + raw, types)], names=[*NODE, "n", "ids", "keys", "tails"])

    rows = materialize(classes.select("rep", "g", "raw").mapInArrow(strings, "g int, tree int, node long, n long, ids binary, keys binary, tails binary"), "strings")
    large = [(*r[:3], -(-r.n // CHUNK)) for r in rows.groupBy(*NODE).agg(F.sum("n").alias("n")).where(F.col("n") > CHUNK).collect()]
    large = spark.createDataFrame(large, "g int, tree int, node long, chunks int")  # nodes are bounded in number
    dealt = rows.join(F.broadcast(large), NODE, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("ids"), F.col("chunks")))

    def sort(t: pa.Table) -> pa.Table:
        ids, keys, tails = (np.frombuffer(b"".join(t[c].to_pylist()), ty) for c, ty in (("ids", np.int64), ("keys", np.uint64), ("tails", np.uint64)))
        order = np.lexsort((ids, keys))
        head = t.select([*NODE, "chunks"]).slice(0, 1)
        for name, v in (("ids", ids), ("keys", keys), ("tails", tails)):
            head = head.append_column(name, pa.array([v[order].tobytes()], pa.binary()))
        return head

    schema = "g int, tree int, node long, chunks int, ids binary, keys binary, tails binary"
    forest = materialize(dealt.groupBy(*NODE, "chunk").applyInArrow(sort, schema), "forest")
    discard(rows)
    return forest


# --- the ascent -----------------------------------------------------------------------------


def bounds(keys: np.ndarray, own: np.ndarray, level: int) -> np.ndarray:
    """Where the children of each own prefix of ``level`` symbols begin, and where the last ends."""
    shift = np.uint64(7 * (SORTED - level - 1))
    prefix = own >> shift >> np.uint64(7) << np.uint64(7)
    marks = (prefix[:, None] + np.arange(FAN + 1, dtype=np.uint64)) << shift
    if not level:
        return np.broadcast_to(np.searchsorted(keys, marks[0]), marks.shape)
    return np.searchsorted(keys, marks.ravel()).reshape(marks.shape)


def by_step(sizes: np.ndarray, close: np.ndarray) -> np.ndarray:
    """The strings under the closest children of a prefix, for each of the ``WIDTHS``."""
    order = np.argsort(-close, axis=1, kind="stable")
    return np.cumsum(np.take_along_axis(sizes, order, 1), axis=1)[:, WIDTHS - 1]


def deep_counts(keys: np.ndarray, q: np.ndarray, tree: int, depth: int, least: float):
    """For each level below the nodes: the level, the queries, and their counts by step. A chunk does
    not go below a prefix with fewer strings than ``least``."""
    close = closeness(q, tree)
    own = word(close[:, :SORTED].argmax(2))
    alive = np.arange(len(q))
    for level in range(depth, SORTED):
        at = bounds(keys, own[alive], level)
        total = at[:, -1] - at[:, 0]
        alive, at = alive[total >= least], at[total >= least]
        if not len(alive):
            return
        yield level, alive, by_step(np.diff(at, axis=1), close[alive, level])


def closest(ids: np.ndarray, keys: np.ndarray, tails: np.ndarray, q: np.ndarray, steps: np.ndarray, tree: int, depth: int, most: int):
    """For each query the vectors that this chunk names."""
    close = closeness(q, tree)
    own = word(close[:, :SORTED].argmax(2))
    shifts = np.uint64(7) * np.arange(SORTED - 1, -1, -1, dtype=np.uint64)
    flat = np.concatenate([(w[:, None] >> shifts & np.uint64(FAN - 1)).astype(np.intp) for w in (keys, tails)], 1)
    flat += FAN * np.arange(SYMBOLS)
    level, width = steps // STEPS, WIDTHS[steps % STEPS]
    for n in np.unique(level):
        some = np.flatnonzero(level == n)
        at = bounds(keys, own[some], int(n))
        order = np.argsort(-close[some, n], axis=1, kind="stable")
        for i, k in enumerate(some.tolist()):
            if n < depth:  # a node that the step takes in whole
                rows = np.arange(len(keys))
            elif width[k] == FAN:
                rows = np.arange(at[i, 0], at[i, -1])
            else:
                rows = np.concatenate([np.arange(at[i, c], at[i, c + 1]) for c in order[i, : width[k]]])
            if len(rows) > most:
                score = close[k].ravel().take(flat[rows]).sum(1)
                rows = rows[np.argpartition(-score, most)[:most]]
            yield k, ids[rows]


def outer_step(q: np.ndarray, sizes: list[np.ndarray], depth: int, want: int) -> np.ndarray:
    """The step of each query if it lies above the nodes, from the nodes' sizes; else -1."""
    totals = np.zeros((len(q), depth * STEPS), np.int64)
    own_total = np.zeros(len(q), np.int64)
    for t in range(TREES):
        close = closeness(q, t)
        own = close[:, :depth].argmax(2)
        node = np.zeros(len(q), np.int64)
        for level in range(depth):
            under = sizes[t].reshape(FAN**level, FAN, -1).sum(2)[node]
            totals[:, level * STEPS : (level + 1) * STEPS] += by_step(under, close[:, level])
            node = node * FAN + own[:, level]
        own_total += sizes[t].reshape(-1)[node]
    reached = totals >= want
    step = np.where(reached.any(1), totals.shape[1] - 1 - reached[:, ::-1].argmax(1), 0) if depth else np.zeros(len(q), np.int64)
    return np.where(own_total >= want, -1, step)


def routes(q: np.ndarray, steps: np.ndarray, tree: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a tree that each query's step touches, as (query, node) places."""
    if not depth:
        return np.arange(len(q)), np.zeros(len(q), np.int64)
    close = closeness(q, tree)
    own = close[:, :depth].argmax(2)
    who, where = [], []
    for i, s in enumerate(steps.tolist()):
        level = s // STEPS if 0 <= s < depth * STEPS else depth
        node = np.array([0])
        for j in range(depth):
            if j < level:
                nxt = own[i, j : j + 1]
            elif j == level:
                nxt = np.argsort(-close[i, j], kind="stable")[: WIDTHS[s % STEPS]]
            else:
                nxt = np.arange(FAN)
            node = (node[:, None] * FAN + nxt).ravel()
        who.append(np.full(len(node), i))
        where.append(node)
    return np.concatenate(who), np.concatenate(where)


# --- the operator ---------------------------------------------------------------------------


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of each query's nearest other vectors."""
    prepare(vectors.sparkSession)
    classes, ids = classes_of(vectors)
    q_classes, q_ids = classes_of(queries)

    own = materialize(banded(classes), "bands")
    stats = own.groupBy("g").agg(F.count("*").alias("n"), F.max("long").alias("longest")).collect()
    size, longest = {r.g: r.n for r in stats}, {r.g: r.longest for r in stats}
    depth = {g: next((i for i in range(2) if n <= CHUNK * FAN**i), 2) for g, n in size.items()}
    forest = plant(own, longest, depth)
    dims = sorted({g // BANDS for g in size})
    q_classes = q_classes.where(F.col("d").isin(dims)) if dims else q_classes.limit(0)
    groups = vectors.sparkSession.createDataFrame([(g // BANDS, g) for g in size], "d int, g int")  # BANDS for each dimension
    asked = q_classes.join(F.broadcast(groups), "d").select("rep", "g", "raw")
    steps = settle(asked, forest, size, depth)
    pairs = named(asked.join(steps, ["rep", "g"]), forest, size, depth, k)
    pairs = materialize(pairs.distinct(), "pairs")
    discard(forest)
    best = materialize(scored(pairs, classes, q_classes, k), "scored")
    # ids for vectors: a class has as many as count
    first = Window.partitionBy("rep").orderBy("vec_id")
    few = ids.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).select("rep", "vec_id")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = best.join(few, "rep").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k + 1).select("q", "vec_id", "score")
    each = found.join(q_ids.select(F.col("rep").alias("q"), F.col("vec_id").alias("query_id")), "q").where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def routed(asked: DataFrame, depth: dict[int, int]) -> DataFrame:
    """Queries (rep, g, raw, step) packed for each node that they touch."""

    def run(batches):
        for whole in batches:
            for g, b in by_length(whole, "g"):
                reps, step = column(b, "rep"), column(b, "step").astype(np.int64)
                q = lifted(matrix(b, "raw", g // BANDS))
                for t in range(TREES):
                    who, where = routes(q, step, t, depth[g])
                    order = np.argsort(where, kind="stable")
                    cut = np.flatnonzero(np.concatenate([[True], np.diff(where[order]) != 0]))
                    parts = [who[order[i:j]] for i, j in zip(cut, np.append(cut[1:], len(order)))]
                    cols = [[g] * len(parts), [t] * len(parts), [where[order[i]] for i in cut]]
                    raw = [[v[p].tobytes() for p in parts] for v in (reps, step, q)]
                    types = (pa.int32(), pa.int32(), pa.int64(), *(pa.binary(),) * 3)
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols + raw, types)], names=[*NODE, "reps", "steps", "q"])

    return asked.select("rep", "g", "raw", "step").mapInArrow(run, "g int, tree int, node long, reps binary, steps binary, q binary")


def unpacked(b: pa.RecordBatch):
    """The rows of a join of chunks and queries."""
    for r in b.to_pylist():
        q = np.frombuffer(r["q"], np.float32).reshape(-1, r["g"] // BANDS + 1)
        yield r, q, np.frombuffer(r["reps"], np.int64), np.frombuffer(r["keys"], np.uint64)


def settle(asked: DataFrame, forest: DataFrame, size: dict, depth: dict) -> DataFrame:
    """(rep, g, step): how far up each query's trees of a group ascend together."""
    spark = asked.sparkSession
    sizes = {g: [np.zeros(FAN ** depth[g], np.int64) for _ in range(TREES)] for g in size}
    if any(depth.values()):
        for r in forest.groupBy(*NODE).agg(F.sum(F.octet_length("ids") / 8).cast("long").alias("n")).collect():
            sizes[r.g][r.tree][r.node] = r.n
    else:
        sizes = {g: [np.array([n])] * TREES for g, n in size.items()}
    sent = spark.sparkContext.broadcast(sizes)

    def outer(batches):
        for whole in batches:
            for g, b in by_length(whole, "g"):
                step = outer_step(lifted(matrix(b, "raw", g // BANDS)), sent.value[g], depth[g], wanted(size[g]))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("rep", "g")), pa.array(step, pa.int32())], names=["rep", "g", "step"])

    first = materialize(asked.select("rep", "g", "raw").mapInArrow(outer, "rep long, g int, step int"), "steps")
    deep = asked.join(first.where("step < 0"), ["rep", "g"])

    def count(batches):
        for b in batches:
            for r, q, reps, keys in unpacked(b):
                g = r["g"]
                for level, who, n in deep_counts(keys, q, r["tree"], depth[g], wanted(size[g]) / (8 * TREES * r["chunks"])):
                    rep, step = np.repeat(reps[who], STEPS), np.tile(level * STEPS + np.arange(STEPS), len(who))
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.full(len(rep), g, np.int32)), pa.array(step, pa.int32()), pa.array(n.ravel(), pa.int64())], names=["rep", "g", "step", "n"])

    met = forest.select(*NODE, "chunks", "keys").join(routed(deep, depth), NODE).select("g", "tree", "chunks", "keys", "reps", "q")
    counted = met.mapInArrow(count, "rep long, g int, step int, n long").groupBy("rep", "g", "step").agg(F.sum("n").alias("n"))
    want = F.element_at(F.create_map(*(F.lit(x) for g, n in size.items() for x in (g, wanted(n)))), F.col("g")) if size else F.lit(0)
    inner = counted.where(F.col("n") >= want).groupBy("rep", "g").agg(F.max("step").alias("inner"))
    root = F.element_at(F.create_map(*(F.lit(x) for g, n in depth.items() for x in (g, n * STEPS))), F.col("g")) if size else F.lit(0)
    both = asked.select("rep", "g").join(first, ["rep", "g"]).join(inner, ["rep", "g"], "left")
    return materialize(both.select("rep", "g", F.when(F.col("step") >= 0, F.col("step")).otherwise(F.coalesce("inner", root)).cast("int").alias("step")), "settled")


def named(asked: DataFrame, forest: DataFrame, size: dict, depth: dict, k: int) -> DataFrame:
    """Pairs (q, rep): the vectors that the chunks name for the queries."""

    def run(batches):
        for b in batches:
            for r, q, reps, keys in unpacked(b):
                ids, tails, steps = (np.frombuffer(r[c], ty) for c, ty in (("ids", np.int64), ("tails", np.uint64), ("steps", np.int64)))
                who, got = [], []
                for i, own in closest(ids, keys, tails, q, steps, r["tree"], depth[r["g"]], shortlist(size[r["g"]], k)):
                    who.append(np.full(len(own), reps[i]))
                    got.append(own)
                if who:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(got))], names=["q", "rep"])

    met = forest.join(routed(asked, depth), NODE).select("g", "tree", "ids", "keys", "tails", "reps", "steps", "q")
    return met.mapInArrow(run, "q long, rep long")


def scored(pairs: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, rep, score): exact inner products of each query's ``k`` + 1 best vectors."""
    q = asked.select(F.col("rep").alias("q"), F.col("d"), F.col("raw").alias("q_raw"))
    if (q.agg(F.sum(F.col("d") * 8)).first()[0] or 0) <= SENT:
        q = F.broadcast(q)  # else vectors are shuffled along with the pairs
    both = pairs.join(classes.select("rep", "raw"), "rep").join(q, "q")

    def run(batches):
        for whole in batches:
            for d, b in by_length(whole):
                score = np.einsum("ij,ij->i", matrix(b, "raw", d), matrix(b, "q_raw", d))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("q")), b.column(b.schema.get_field_index("rep")), pa.array(score)], names=["q", "rep", "score"])

    w = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = both.select("q", "rep", "d", "raw", "q_raw").mapInArrow(run, "q long, rep long, score double")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k + 1).drop("__n")


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
