"""N-gram Jaccard join by parity sketches, and its connected components.

A document is the set of its 5-word shingles, as 64-bit hashes; equal sets are one class. For
sizes a <= b, a similarity of at least t = 3/4 needs a >= 3b/4 and a symmetric difference of
at most d = (a + b) / 7.

Blocks. The sizes fall into bands [4^f, 4^(f+1)); a pair belongs to the band of its larger
set, so a class takes part in its own band and, if it may be the smaller one, in the next. In
a band, shingles are dealt by hash over K = 16 * 4^f blocks (2^14 at least) and XOR-ed together in each: the
class's sketch. A shingle of the symmetric difference spoils one block, so the number of
blocks that differ (the Hamming distance of the sketches) is at most d: of any d + 1 non-empty
blocks one is equal in both (pigeonhole). Each class sends its d + 1 rarest blocks; rarity is
one order for all, from a table of counts of all shingles of the corpus (of as many cells as
``cells_for`` its bytes, 2^23 at most; beyond, a cell holds many shingles by chance, and only what stands out
of the median cell counts as frequent), so passages that many documents share come last. It cannot lose a pair: the blocks that two classes share
are at least max(blocks) - d, and prefixes of length d + 1 of one order meet. Prefixes of
length d + ``SHARED`` even meet in ``SHARED`` blocks (or in all that must be shared, where
that is less), which rules out most chance hits for a few more blocks. A class with fewer
than d + 1 non-empty blocks would void this; if there is any, the pass is repeated with more
blocks. Blocks are equi-joined by a shuffle of packed arrays.

Position. Blocks of one shingle are bounded more tightly: each that two sets do not share
spoils its own part of the symmetric difference, so those before a shared block, in both sets
together and less the blocks shared before it, are at most d too. With d = a / 7 + b / 7 each set has
its own part of that bound: how many such blocks come before a block, less a seventh of the set,
is its lateness there. At each of the first ``SHARED`` blocks that a linked pair shares the two
latenesses add up to ``LATE`` at most, so at least one is ``LATE / 2`` at most. What a common form gives to
documents that are alike but not linked comes late in all of them, and meets nobody.

Candidates. A block shared by at most ``SMALL`` classes counts for its pairs (a constant bound);
one shared by more only ties classes into a cluster, by a star around the least late of them. Blocks
that are frequent in the corpus or in one task are reduced before the shuffle: a task ties its own
classes, and only the centre of their star goes on; classes that are too late for it are
dealt over as many parts of the block as its count asks for, and centres go to every part.

Verification. A parity sketch of m bits (each shingle flips one) goes first: its Hamming
distance is a lower bound of the symmetric difference too, and what exceeds d is dropped.
What is left is compared set by set, exactly up to 64-bit hashes.

Clusters. The ties themselves are verified as pairs first, which joins most of a group of near
copies at the cost of its size. What may be missing are links between different components of a
cluster. Its classes are dealt into blocks of at most ``SQUARE`` classes and ``SQUARE_BYTES`` of sets, by
size and, where a component is large, by component; two blocks form a square unless their sizes
cannot link or both lie in one component. Squares get sketches alone, and return pairs that
would join the components that they hold, never all pairs; those pairs are verified. Only squares of
which some pair fails get the sets too and are settled by them.

Defined results: null or empty text has no shingles, links with nothing, and is its own
component; a null doc_id takes no part and has a null component_id; repeated rows of an id
are answered each; an empty table gives an empty table; other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, prepare, table, utf8_of
from .components import components
from .shingles import common, forget, mix, shingle_set

SHINGLE, PERCENT = 5, 75
SMALL, SQUARE, SQUARE_BYTES = 8, 256, 8 << 20
CELLS, MOST_CELLS, CHUNK = 1 << 20, 1 << 23, 1 << 14
FLUSH, PER_BUCKET, OFTEN = 1_000_000, 1_500_000, 256
SPREAD, LEAST_BLOCKS, SIZE_STEPS = 16, 1 << 14, 6
SHARED = 6
LATE = 2 * (SHARED - 1)
#: A block is dealt over parts from SPLIT^2 occurrences in the corpus on: their root over SPLIT.
SPLIT, TIES = 128, 1 << 16


def linked(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= PERCENT * (a + b - inter) and inter > 0


def fits(a, b):
    """Whether sizes alone allow a link."""
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def most_apart(a, b):
    """The largest symmetric difference of linked sets of these sizes: (1 - t) / (1 + t) of their sum."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def band(n: int) -> int:
    return (n.bit_length() - 1) // 2


# --- pass 1: classes and counts ---------------------------------------------------------


def cells_for(size: int) -> int:
    """Cells of the table of counts for a corpus of a size in bytes: about one for 512 bytes."""
    return min(MOST_CELLS, max(CELLS, 1 << (size // 512).bit_length()))


def survey(docs: DataFrame, k: int, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Each row's set size and fingerprint, and partial counts of the corpus's shingles."""

    def run(batches):
        counts = np.zeros(cells, np.uint32)
        for b in batches:
            rows = []
            for text in utf8_of(b):
                s = shingle_set(text, k)
                raw = s.tobytes()
                rows.append((len(s), *(_signed(h) for h in (xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw)))))
                if len(s):
                    _count(counts, s)
            n = len(rows)
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        forget()
        used = [(i, zlib.compress(c.tobytes(), 1)) for i in range(cells // CHUNK) if (c := counts[i * CHUNK : (i + 1) * CHUNK]).any()]
        n = len(used)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 4 + [pa.array([i for i, _ in used], pa.int32()), pa.array([c for _, c in used], pa.binary())], names=names)

    names = ["doc_id", "n", "fp", "fp2", "chunk", "counts"]
    both = materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp long, fp2 long, chunk int, counts binary"), "survey")
    return both.where("chunk is null").drop("chunk", "counts"), both.where("chunk is not null").select("chunk", "counts")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _cell(s: np.ndarray, cells: int) -> np.ndarray:
    return (s >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _count(counts: np.ndarray, s: np.ndarray) -> None:
    at, n = np.unique(_cell(s, len(counts)), return_counts=True)  # sorted already
    counts[at] += n.astype(np.uint32)


def counted(partial: DataFrame, cells: int = CELLS) -> np.ndarray:
    """The summed counts less those of the median cell: one table of bounded size, whatever the corpus.

    What a cell holds by chance grows with the corpus once the table does not; without the median
    every block would look frequent. The order of the cells stays as it is.
    """

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64)
                total[i] = total[i] + c if i in total else c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(cells, np.int64)
    for r in partial.repartition(max(16, cells // CHUNK // 4), "chunk").mapInArrow(run, "chunk int, counts binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return np.clip(out - int(np.median(out)), -(2**31), 2**31 - 1).astype(np.int32)


# --- pass 2: blocks and candidates --------------------------------------------------------


def packed_lateness(before: np.ndarray, n: int) -> np.ndarray:
    """Lateness in a byte, rounded down, as a fraction of the size class; -128 if unknown."""
    size = _size_class(n)
    if size == 255:
        return np.full(len(before), -128, np.int8)
    return np.clip(np.floor((before - n / 7) * 512 / _EDGES[size]), -127, 127).astype(np.int8)


def lateness(packed: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(packed == -128, -np.inf, packed * _EDGES[size] / 512)


def parts_of(count: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.sqrt(np.maximum(count, 0)).astype(np.int64) // SPLIT)


def part_token(token: np.ndarray, part: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The token of a part of a block."""
    with np.errstate(over="ignore"):
        return np.where(parts > 1, mix(token + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), token)


def blocks_of(s: np.ndarray, counts: np.ndarray, spread: int) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """The d + ``SHARED`` rarest blocks of a set in each band that it takes part in, as 64-bit
    tokens, and how many of them a linked set must share, below 1 if a band had too few; the blocks'
    packed lateness, and their parts."""
    n, out = len(s), []
    rare = counts[_cell(s, len(counts))]
    largest = n * 100 // PERCENT
    for f in [band(n)] + [band(n) + 1] * (band(largest) > band(n)):
        d = int(most_apart(n, min(largest, 4 ** (f + 1) - 1)))
        block = s & np.uint64(min(max(LEAST_BLOCKS * spread // SPREAD, spread * 4**f), 1 << 62) - 1)
        order = np.argsort(block, kind="stable")
        b = block[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        token = mix(np.bitwise_xor.reduceat(s[order], first) + np.uint64(f * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        count = np.maximum.reduceat(rare[order], first)
        rarest = np.lexsort((token, count))[: d + SHARED]
        single = (np.diff(np.append(first, n)) == 1)[rarest]
        before = np.cumsum(single) - single
        out.append((token[rarest], min(SHARED, len(token) - d), packed_lateness(before, n), parts_of(count[rarest])))
    return out


def candidates(docs: DataFrame, counts: np.ndarray, total: int, k: int, spread: int = SPREAD) -> DataFrame:
    """Rows (kind, u, v) of fingerprints: 0 a pair to compare, 1 a tie of a cluster, 2 poor."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_BUCKET))
    sent = spark.sparkContext.broadcast(counts)

    def pack(tokens, lates, parts, fps, sizes, needs):
        """One row per bucket: its classes, how many tokens each has there, the tokens and their
        lateness; and the ties of frequent blocks."""
        t, late, parts = np.concatenate(tokens), np.concatenate(lates), np.concatenate(parts)
        doc = np.repeat(np.arange(len(fps)), [len(x) for x in tokens])
        fp, size, need = np.array(fps, np.int64), np.array(sizes, np.uint8), np.array(needs, np.uint8)
        own = lateness(late, size[doc])
        order = np.lexsort((fp[doc], own, t))
        first = np.flatnonzero(np.concatenate([[True], t[order][1:] != t[order][:-1]]))
        length, head = np.diff(np.append(first, len(t))), order[first]
        centre = ((parts[head] > 1) | (length > OFTEN)) & (own[head] <= LATE // 2)
        tied = np.repeat(centre, length) & (own[order] + np.repeat(own[head], length) <= LATE)
        ties = np.stack([np.repeat(fp[doc[head]], length)[tied], fp[doc[order]][tied]])
        keep = np.ones(len(t), bool)
        keep[order[tied]] = False
        # a centre needs no block to count for it: the mark of a tie
        head = head[centre]
        n = parts[head]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        head = np.repeat(head, n)
        marks = part_token(t[head], nth, parts[head])
        t = np.concatenate([part_token(t, fp[doc].view(np.uint64) % parts.astype(np.uint64), parts)[keep], marks])
        late = np.concatenate([late[keep], late[head]])
        doc, more = np.concatenate([doc[keep], np.arange(len(fp), len(fp) + len(head))]), doc[head]
        fp, size, need = np.concatenate([fp, fp[more]]), np.concatenate([size, size[more]]), np.concatenate([need, np.zeros(len(more), np.uint8)])
        bucket = (t % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        t, late, doc, bucket = t[order] // np.uint64(buckets), late[order], doc[order], bucket[order]
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rows = []
        for a, b in zip(start, np.append(start[1:], len(t))):
            own, n = np.unique(doc[a:b], return_counts=True)
            part = t[a:b]
            rows.append((int(bucket[a]), b"".join([np.int64(len(own)).tobytes(), fp[own].tobytes(), size[own].tobytes(), need[own].tobytes(), n.astype(np.uint32).tobytes(), part.astype(np.uint32).tobytes(), (part >> np.uint64(32)).astype(np.uint8).tobytes(), late[a:b].tobytes()])))
        ties = np.sort(ties[:, ties[0] != ties[1]], axis=0)
        ties = ties[:, np.lexsort(ties)]
        ties = ties[:, np.append(True, (ties[:, 1:] != ties[:, :-1]).any(0))[: ties.shape[1]]]
        for a in range(0, ties.shape[1], TIES):
            rows.append((-1 - int(ties[0, a]) % buckets, ties[:, a : a + TIES].tobytes()))
        return rows

    def emit(batches):
        counts = sent.value
        seen, n, poor = set(), 0, 0
        held = tokens, lates, parts, fps, sizes, needs = [], [], [], [], [], []

        def flush():
            rows = pack(*held) if tokens else []
            for a in held:
                a.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "data"])

        for b in batches:
            for text in utf8_of(b):
                s = shingle_set(text, k)
                if not len(s):
                    continue
                fp = _signed(xxhash.xxh3_64_intdigest(s.tobytes()))
                if fp in seen:
                    continue
                if len(seen) < 1_000_000:  # equal sets of one task are sent once; the rest meet in their bucket
                    seen.add(fp)
                for x, need, late, part in blocks_of(s, counts, spread):
                    poor += need < 1
                    tokens.append(x)
                    lates.append(late)
                    parts.append(part)
                    needs.append(max(1, need))
                    fps.append(fp)
                    sizes.append(_size_class(len(s)))
                    n += len(x)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        yield flush()
        forget()
        if poor:
            yield pa.RecordBatch.from_arrays([pa.array([2**31 - 1], pa.int32()), pa.array([b""], pa.binary())], names=["bucket", "data"])

    def meet(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket == 2**31 - 1:
                    yield _rows([(2, 0, 0, 0, 0)])
                elif bucket < 0:
                    x = np.frombuffer(data, np.int64).reshape(2, -1)
                    yield _rows_of(1, x[0], x[1])
                else:
                    held.setdefault(bucket, []).append(data)
        pairs: dict[tuple[int, int], list[int]] = {}
        for bucket in list(held):
            yield from _join(held.pop(bucket), pairs)
        if pairs:
            yield _rows([(0, a, b, c, need) for (a, b), (c, need) in pairs.items()])

    dealt = docs.select("text").mapInArrow(emit, "bucket int, data binary").repartition(buckets, "bucket")
    met = dealt.mapInArrow(meet, "kind int, u long, v long, c int, need int").groupBy("kind", "u", "v").agg(F.sum("c").alias("c"), F.min("need").alias("need"))
    return materialize(met.where("kind <> 0 or c >= need").select("kind", "u", "v"), "candidates")


def _size_class(n: int) -> int:
    """1 to 255; sizes more than ``SIZE_STEPS`` classes apart cannot link, as log(4/3) * 20 < 6."""
    return min(255, 1 + int(np.log(n) * 20))


#: About the smallest size of each size class.
_EDGES = np.exp((np.arange(256) - 1) / 20)


_PAIR = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("c", pa.int32()), ("need", pa.int32())])


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PAIR.types)], schema=_PAIR)


def _rows_of(kind: int, u: np.ndarray, v: np.ndarray):
    same = [pa.array(np.full(len(u), x, np.int32)) for x in (kind, 0, 0)]
    return pa.RecordBatch.from_arrays([same[0], pa.array(u), pa.array(v), *same[1:]], schema=_PAIR)


def _join(parts: list[bytes], pairs: dict):
    """The equal blocks of one bucket: small groups into ``pairs`` with the number of blocks
    they share and must share, the ties of others yielded."""
    fps, sizes, needs, tokens, lates = [], [], [], [], []
    for data in parts:
        m = int(np.frombuffer(data, np.int64, 1)[0])
        fp = np.frombuffer(data, np.int64, m, 8)
        size = np.frombuffer(data, np.uint8, m, 8 + 8 * m)
        need = np.frombuffer(data, np.uint8, m, 8 + 9 * m)
        n = np.frombuffer(data[8 + 10 * m : 8 + 14 * m], np.uint32).astype(np.int64)
        total, at = int(n.sum()), 8 + 14 * m
        lo = np.frombuffer(data[at : at + 4 * total], np.uint32).astype(np.uint64)
        hi = np.frombuffer(data, np.uint8, total, at + 4 * total).astype(np.uint64)
        fps.append(np.repeat(fp, n))
        sizes.append(np.repeat(size, n))
        needs.append(np.repeat(need, n))
        tokens.append(lo | hi << np.uint64(32))
        lates.append(np.frombuffer(data, np.int8, total, at + 5 * total))
    fp, size, need, token, late = (np.concatenate(x) for x in (fps, sizes, needs, tokens, lates))
    late = lateness(late, size)
    order = np.argsort(token, kind="stable")
    t = token[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    length = np.diff(np.append(first, len(t)))
    ties: set[tuple[int, int]] = set()
    for a, n in zip(first[length > 1].tolist(), length[length > 1].tolist()):
        own = order[a : a + n]
        group = dict(zip(fp[own].tolist(), zip(size[own].tolist(), need[own].tolist(), late[own].tolist())))  # equal sets of several tasks are one class
        if len(group) < 2:
            continue
        if len(group) > SMALL or not need[own].all():  # the mark of any entry counts, also where a copy of its class has none
            least, centre = min((x[2], c) for c, x in group.items())
            ties.update((min(centre, c), max(centre, c)) for c, x in group.items() if x[2] + least <= LATE and c != centre)
            continue
        ids = sorted(group)
        for i, x in enumerate(ids):
            for y in ids[i + 1 :]:
                if abs(group[x][0] - group[y][0]) <= SIZE_STEPS and group[x][2] + group[y][2] <= LATE:
                    least = min(group[x][1], group[y][1])
                    c = pairs.setdefault((x, y), [0, least])
                    c[0] += 1
                    c[1] = min(c[1], least)
    if ties:
        yield _rows([(1, a, b, 0, 0) for a, b in ties])


# --- verification -------------------------------------------------------------------------


def bits_for(n: int) -> int:
    """The parity sketch's bits: a power of two, at least four for each shingle of the band."""
    return 16 * 4 ** (band(n) + 1) // 4


def parity(s: np.ndarray) -> bytes:
    """A bit sketch: each shingle flips the bit that its hash names."""
    m = bits_for(len(s))
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1, bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch with fewer bits: XOR of its parts (in bytes, along the last axis)."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def apart(a: bytes, b: bytes) -> int:
    """The Hamming distance of two sketches: at most the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    m = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, m) ^ fold(y, m)).sum())


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Size, parity sketch and set of each wanted class (fp), computed from its first document."""
    first = materialize(classes.join(wanted, "fp", "left_semi").select("rep").distinct(), "wanted")

    def run(batches):
        for b in batches:
            rows = []
            for text in utf8_of(b):
                s = shingle_set(text, k)
                if len(s):
                    raw = s.tobytes()
                    rows.append((_signed(xxhash.xxh3_64_intdigest(raw)), len(s), parity(s), raw))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["fp", "n", "sketch", "hashes"])
        forget()

    own = docs.select("doc_id", "text").join(few(first.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
    sets = own.mapInArrow(run, "fp long, n long, sketch binary, hashes binary")
    return materialize(sets, "sets")  # a class may come twice where rows repeat an id; that does no harm


def verified_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of ``pairs`` (u, v): sketches are compared first, then sets."""
    side = lambda x, *cols: sets.select(F.col("fp").alias(x), *(F.col(c).alias(c[0] + x) for c in cols))
    # where pairs are few they are broadcast, and sketches and sets stream past them
    near = side("u", "n", "sketch").join(few(pairs), "u").join(side("v", "n", "sketch"), "v")

    def sift(batches):
        for b in batches:
            u, v, nu, su, nv, sv = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("u", "v", "nu", "su", "nv", "sv"))
            ok = [bool(fits(a, c)) and apart(x, y) <= most_apart(a, c) for a, x, c, y in zip(nu, su, nv, sv)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(c, ok) if y], pa.int64()) for c in (u, v)], names=["u", "v"])

    near = materialize(near.mapInArrow(sift, "u long, v long"), "near")
    second = materialize(near.select("v").distinct(), "second")
    both = side("u", "hashes").join(few(near), "u").join(side("v", "hashes").join(few(second), "v", "left_semi"), "v")

    def verify(batches):
        for b in batches:
            out = []
            for u, v, x, y in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("u", "v", "hu", "hv"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if linked(common(x, y), len(x), len(y)):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return both.mapInArrow(verify, "u long, v long")


def placed_in_blocks(clusters: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, comp, label, g, own, block) of each class of a cluster with several components: ``g`` its
    size class, so that only neighbours can link; ``own`` its component if that fills blocks alone."""
    sizes = sets.groupBy("fp").agg(F.max("n").alias("n"))
    m = clusters.join(comp.withColumnRenamed("label", "comp"), F.col("fp") == F.col("node"), "left").join(sizes, "fp")
    g = F.least(F.floor(F.floor(F.log("n") * 20) / SIZE_STEPS), F.lit(255)).cast("int")
    m = materialize(m.select("fp", "label", F.coalesce("comp", "fp").alias("comp"), g.alias("g"), (F.col("n") * 8).alias("bytes")), "members")
    several = materialize(m.groupBy("label").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("label"), "several")
    m = m.join(several, "label", "left_semi")
    many = lambda n, size: F.ceil(F.greatest(n / F.lit(SQUARE), size / F.lit(SQUARE_BYTES))).cast("int")
    per = m.groupBy("label", "g", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    per = materialize(per.withColumn("large", F.col("n") * 2 >= SQUARE), "per")
    rest = per.where("not large").groupBy("label", "g").agg(many(F.sum("n"), F.sum("size")).alias("blocks"))
    alone = per.where("large").select("label", "g", F.col("comp").alias("own"), many(F.col("n"), F.col("size")).alias("blocks"))
    counts = materialize(rest.withColumn("own", F.lit(None).cast("long")).unionByName(alone), "blocks")
    m = m.join(per.select("label", "g", "comp", "large"), ["label", "g", "comp"]).withColumn("own", F.when(F.col("large"), F.col("comp")))
    c = counts.select(F.col("label").alias("__l"), F.col("g").alias("__g"), F.col("own").alias("__o"), "blocks")
    m = m.join(c, (F.col("label") == F.col("__l")) & (F.col("g") == F.col("__g")) & F.col("own").eqNullSafe(F.col("__o")))
    b = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    return materialize(m.select("fp", "comp", "label", "g", "own", F.xxhash64("label", "g", F.coalesce("own", F.lit(0)), F.col("own").isNull(), b).alias("block")), "placed")


def squares(ties: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join what ``links`` leaves apart inside the clusters of ``ties``."""
    placed = placed_in_blocks(components(ties).withColumnRenamed("node", "fp"), components(links), sets)
    blocks = materialize(placed.select("label", "g", "own", "block").distinct(), "distinct")
    one, two = (blocks.select(*(F.col(c).alias(x + c) for c in blocks.columns)) for x in "ab")
    near = (F.col("bg") == F.col("ag") + 1) | ((F.col("bg") == F.col("ag")) & (F.col("bblock") >= F.col("ablock")))
    apart_ = F.col("aown").isNull() | ~F.col("aown").eqNullSafe(F.col("bown"))
    square = one.join(two, F.col("alabel") == F.col("blabel")).where(near & apart_).select(F.xxhash64("ablock", "bblock").alias("square"), "ablock", "bblock")
    square = materialize(square, "squares")
    sides = square.select("square", F.col("ablock").alias("block"), F.lit(0).alias("side")).unionByName(square.where("ablock <> bblock").select("square", F.col("bblock").alias("block"), F.lit(1).alias("side")))
    rows = sides.join(placed.select("fp", "comp", "block"), "block").select("square", "side", "fp", "comp")

    def compare(t: pa.Table, exact: bool) -> pa.Table:
        fp, n, side, comp = (t[c].to_numpy() for c in ("fp", "n", "side", "comp"))
        sketch, both = t["sketch"].to_pylist(), len(np.unique(side)) > 1
        bits = np.array([len(x) for x in sketch])
        stacks = {m: np.stack([np.frombuffer(sketch[x], np.uint8) for x in np.flatnonzero(bits == m)]) for m in np.unique(bits)}
        where = {m: np.flatnonzero(bits == m) for m in stacks}
        found = []  # pairs of different components that the sketches allow, and how much they leave
        for x in np.argsort(n, kind="stable").tolist():
            mine = np.frombuffer(sketch[x], np.uint8)
            for m, at in where.items():
                if m < bits[x]:
                    continue  # larger sets have sketches as long or longer
                ok = fits(n[x], n[at]) & ((n[at] > n[x]) | ((n[at] == n[x]) & (at > x))) & (comp[at] != comp[x])
                if both:
                    ok &= side[at] != side[x]
                ok = np.flatnonzero(ok)
                if len(ok):
                    d = np.bitwise_count(fold(stacks[m][ok], len(mine)) ^ mine).sum(axis=1, dtype=np.int64)
                    left = most_apart(n[x], n[at[ok]]) - d
                    y = at[ok[left >= 0]]
                    found.append(np.stack([np.full(len(y), x), y, left[left >= 0]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        pairs = pairs[:2, np.argsort(-pairs[2], kind="stable")]
        root = {c: c for c in comp.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        hashes = t["hashes"] if exact else None
        for x, y in pairs.T.tolist():
            a, b = find(int(comp[x])), find(int(comp[y]))
            if a != b:
                if exact:
                    p, q = (np.frombuffer(hashes[i].as_py(), np.uint64) for i in (x, y))
                    if not linked(common(p, q), len(p), len(q)):
                        continue
                root[a] = b
                out.append((fp[x], fp[y]))
        cols = [pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)]
        return pa.table({"square": pa.array([t["square"][0].as_py()] * len(out), pa.int64()), "u": cols[0], "v": cols[1]})

    schema = "square long, u long, v long"
    maybe = rows.join(sets.select("fp", "n", "sketch"), "fp").groupBy("square").applyInArrow(lambda t: compare(t, False), schema)
    maybe = materialize(maybe, "maybe")
    good = materialize(verified_pairs(maybe.select("u", "v").distinct(), sets), "good")
    open_ = materialize(maybe.join(good, ["u", "v"], "left_anti").select("square").distinct(), "open")
    left = rows.join(few(open_), "square", "left_semi").join(sets.select("fp", "n", "sketch", "hashes"), "fp")
    return good.unionByName(left.groupBy("square").applyInArrow(lambda t: compare(t, True), schema).select("u", "v"))


# --- the operator -------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    prepare(docs.sparkSession)
    cells = cells_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows, partial = survey(docs, k, cells)
    classes = materialize(rows.where("n > 0 and doc_id is not null").groupBy("fp", "fp2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    counts = counted(partial, cells)
    total = (classes.agg(F.sum("n")).first()[0] or 0) // 2
    named = docs.where("doc_id is not null")
    spread = SPREAD
    while True:
        found = candidates(named, counts, total, k, spread)
        if found.where("kind = 2").isEmpty():
            break
        spread *= 16  # some set had too few blocks
    pairs, ties = found.where("kind = 0").select("u", "v"), found.where("kind = 1").select("u", "v")
    wanted = found.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    sets = sets_of(named, classes, wanted, k)
    # a class may have been sent by several tasks, so a pair or a tie may come twice
    links = materialize(verified_pairs(pairs.unionByName(ties).distinct(), sets), "links")
    if not ties.isEmpty():
        links = materialize(links.unionByName(squares(ties, links, sets)), "joined")
    label = components(links)
    known = classes.join(label, classes.fp == label.node, "left").select("fp", "fp2", "n", "rep", F.coalesce("label", "fp").alias("label"))
    known = materialize(known, "known")
    smallest = materialize(known.groupBy("label").agg(F.min("rep").alias("component_id")), "smallest")
    known = materialize(known.join(smallest, "label").select("fp", "fp2", "n", "component_id"), "labelled")
    full = rows.join(known, ["fp", "fp2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute(docs: list[tuple], k: int = SHINGLE) -> list[tuple]:
    """What :func:`op6_parity_join` must return, by comparing all pairs word by word."""
    fold_case = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets, label = {}, {}
    for doc_id, text in docs:
        words = [w for w in re.split(r"[ \t-\r]+", (text or "").translate(fold_case)) if w]
        n = min(k, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        label[doc_id] = doc_id
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and fits(len(x), len(y)) and linked(len(x & y), len(x), len(y)) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if c == old else c for d, c in label.items()}
    return [(d, len(sets[d]), label[d]) for d in ids]


OP6_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
