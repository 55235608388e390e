"""Best-fit packing of token sequences by a linear grouping scheme.

All lengths lie between 1 and ``capacity``, so the whole bin packing problem is a histogram
of at most ``capacity`` counts, whatever the number of documents; only that reaches the
driver. There:

1. lengths over ``capacity / large`` are large (a few bounds are tried, the best is kept); sorted, they are dealt into ``groups`` groups
   of equal cardinality, each rounded up to its largest length;
2. with so few sizes, the configurations (multisets of sizes that fit a sequence) are
   optimised by column generation: a linear programme whose columns come from a knapsack on
   its dual prices, rounded down, the rest filled largest first;
3. actual lengths are substituted for the rounded ones, which leaves gaps;
4. small lengths, largest first, go where they fit best, in runs of equal sequences.

The outcome is a list of patterns with multiplicities. Each piece gets its rank among the
pieces of its length, by a salted window so that one very common length is spread over many
tasks, and the rank determines sequence and offset. Tables that are broadcast grow with
``capacity``, not with the documents.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an
empty table gives an empty one. Input columns named like an output column are not carried.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table

CAPACITY, END_ID, GROUPS, LARGE, SALT_ROWS = 4096, 1, 128, (2, 3, 6), 512
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the tokenizer splits lower-cased Latin-1 text that holds no white space.
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


#: The visible character of each byte: itself where it is one, else the next free one from 256.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
VISIBLE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space before anything else and none of its tokens or
    normalisations reaches across it, so the ids of white-space separated chunks are cached.
    New Latin-1 chunks are put together from cached words, and new words go to
    its model directly; other chunks are encoded one by one. Texts where ``str.split`` and the tokenizer
    differ on what white space is, or that hold the text of a special token, are encoded whole.
    """

    MOST = 400_000  # cached chunks in a worker, about 100 MB

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.special = "\x1c\x1d\x1e\x1f"

    def raw(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_words(self, new: set[str]) -> None:
        """Words as the tokenizer's model sees them: a visible character for each UTF-8 byte."""
        model, pack = self.tok.model, struct.pack
        for w in new:
            seen = w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(VISIBLE)
            ids = [t.id for t in model.tokenize(seen)]
            self.cache[w] = pack(f"<{len(ids)}I", *ids)

    def learn(self, new: set[str]) -> None:
        """A word is a chunk too, so words and chunks share the cache."""
        cache = self.cache
        if len(cache) + len(new) > self.MOST:
            cache.clear()
        latin = []
        for w in new:
            if w.isascii() or max(w) <= "\xff":
                latin.append((w, LATIN_WORDS.findall(w.lower())))
            else:
                cache[w] = self.raw(w)
        self.learn_words({x for _, parts in latin for x in parts if x not in cache})
        get = cache.__getitem__
        for w, parts in latin:
            if w not in cache:
                cache[w] = b"".join(map(get, parts))

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif "<|" in text or any(ch in text for ch in self.special):
                out.append(self.raw(text))
            else:
                chunks = text.split()
                try:
                    out.append(b"".join(map(self.cache.__getitem__, chunks)))
                except KeyError:
                    own = set(chunks)
                    self.learn({w for w in own if w not in self.cache})
                    if not own <= self.cache.keys():  # the cache was emptied meanwhile
                        self.learn(own)
                    out.append(b"".join(map(self.cache.__getitem__, chunks)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenized_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    prepare(docs.sparkSession)
    path = path or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            rows = []
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            for i, ids in enumerate(enc.encode_many(texts)):
                ids += end
                rows += [(i, k, 4 * capacity * k, ids[4 * capacity * k : 4 * capacity * (k + 1)]) for k in range(-(-len(ids) // (4 * capacity)))]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")).take(at),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] // 4 for r in rows], pa.int64()),
                    pa.array([len(r[3]) // 4 for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r[3]) for r in rows], pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[Counter, int]]:
    """Few sizes, each needed so many times: configurations and how often each is used."""
    sizes, left = list(sizes), np.array(need, np.int64)
    n = len(sizes)
    out: list[tuple[Counter, int]] = []
    if n:
        # the simplex method on: minimise sum(x), columns @ x = need, columns by knapsack
        basis = np.diag([float(max(1, min(capacity // s, max(1, c)))) for s, c in zip(sizes, need)])
        x = np.linalg.solve(basis, left.astype(float))
        for _ in range(40 * n + 200):
            price = np.linalg.solve(basis.T, np.ones(n))
            value, column = knapsack(sizes, price, capacity)
            if value <= 1 + 1e-9:
                break
            d = np.linalg.solve(basis, column)
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            out_row = int(ratio.argmin())
            step = ratio[out_row]
            x = np.maximum(x - step * d, 0)
            x[out_row] = step
            basis[:, out_row] = column
        for j in np.argsort(-x):
            column = np.rint(basis[:, j]).astype(np.int64)
            used = column > 0
            times = min(int(x[j] + 1e-6), int((left[used] // column[used]).min()))
            if times > 0:
                out.append((Counter({k: int(column[k]) for k in np.flatnonzero(used)}), times))
                left -= times * column
    while left.any():  # the rounded-down rest, largest first
        room, config = capacity, Counter()
        for k in sorted(range(n), key=lambda k: -sizes[k]):
            q = min(room // sizes[k], int(left[k]))
            if q:
                config[k] = q
                room -= q * sizes[k]
        times = min(int(left[k]) // q for k, q in config.items())
        out.append((config, times))
        for k, q in config.items():
            left[k] -= times * q
    return out


def knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the largest total price."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for k in np.argsort([-s for s in sizes]):
        s, v = sizes[k], price[k]
        if v <= 0:
            continue
        for lo in range(s, capacity + 1, s):  # blocks of s: earlier results of this size count
            hi = min(lo + s, capacity + 1)
            new = best[lo - s : hi - s] + v
            better = new > best[lo:hi] + 1e-12
            best[lo:hi][better] = new[better]
            last[lo:hi][better] = k
    column, c = np.zeros(len(sizes)), int(best.argmax())
    value = best[c]
    while c > 0 and last[c] >= 0:
        column[last[c]] += 1
        c -= sizes[last[c]]
    return float(value), column


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[int, ...] = LARGE) -> list[tuple[Counter, int]]:
    """The best of the schemes with each bound of what is large, or the first that is optimal."""
    best, n = [], None
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    for bound in large:
        found = scheme(histogram, capacity, groups, bound)
        used = sum(times for _, times in found)
        if n is None or used < n:
            best, n = found, used
        if n == least:
            break
    return best


def scheme(histogram: dict[int, int], capacity: int, groups: int, large: int) -> list[tuple[Counter, int]]:
    """Patterns (length -> how many) and how many sequences have each."""
    patterns: list[tuple[Counter, int]] = []
    big = sorted((n for n in histogram if n * large > capacity), reverse=True)
    total = sum(histogram[n] for n in big)
    if total:
        # equal cardinality: the i-th group ends at rank (i + 1) * total / groups
        members: list[list[list[int]]] = []
        k = min(groups, total)
        ends = [(i + 1) * total // k for i in range(k)]
        at, queue = 0, [[n, histogram[n]] for n in big]
        i = 0
        for end in ends:
            own = []
            while at < end:
                take = min(queue[i][1], end - at)
                own.append([queue[i][0], take])
                queue[i][1] -= take
                at += take
                i += queue[i][1] == 0
            members.append(own)
        sizes = [own[0][0] for own in members]
        merged: dict[int, list[int]] = defaultdict(list)  # groups of one rounded size are one size
        for g, s in enumerate(sizes):
            merged[s].append(g)
        few = sorted(merged, reverse=True)
        stock = [[list(x) for g in merged[s] for x in members[g]] for s in few]
        for config, times in configurations(few, [sum(c for _, c in own) for own in stock], capacity):
            slots = [k for k, q in config.items() for _ in range(q)]
            # actual lengths for rounded ones: each slot of all copies takes a run of its group
            cuts, runs = {0, times}, []
            for k in slots:
                own, done = [], 0
                while done < times:
                    n, c = stock[k][0]
                    take = min(c, times - done)
                    own.append((done, n))
                    done += take
                    cuts.add(done)
                    stock[k][0][1] -= take
                    if stock[k][0][1] == 0:
                        stock[k].pop(0)
                runs.append(own)
            cuts_ = sorted(cuts)
            for a, b in zip(cuts_, cuts_[1:]):
                patterns.append((Counter(own[bisect_left(own, (a, capacity + 1)) - 1][1] for own in runs), b - a))
    room: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    for p, times in patterns:
        room[capacity - sum(n * q for n, q in p.items())].append((p, times))
    free = sorted(room)

    def put(r: int, p: Counter, times: int) -> None:
        if r not in room or not room[r]:
            if r not in free[bisect_left(free, r) : bisect_left(free, r) + 1]:
                insort(free, r)
        room[r].append((p, times))

    for n in sorted((n for n in histogram if n * large <= capacity), reverse=True):
        left = histogram[n]
        while left:
            i = bisect_left(free, n)
            if i < len(free):
                r = free[i]
                p, times = room[r].pop()
                if not room[r]:
                    free.pop(i)
            else:
                r, p, times = capacity, Counter(), left
            q = min(r // n, left)
            used = min(times, left // q)
            if used < times and p:
                put(r, p, times - used)
            put(r - q * n, p + Counter({n: q}), used)
            left -= q * used
    return [x for r in sorted(room) for x in room[r]]


class Layout:
    """Where the rank-th piece of a length goes, as sorted arrays."""

    def __init__(self, patterns: list[tuple[Counter, int]]):
        at, first = defaultdict(int), 0
        rows = []
        for p, times in patterns:
            offset = 0
            for n in sorted(p, reverse=True):
                rows.append((n, at[n], p[n], first, offset))
                at[n] += p[n] * times
                offset += n * p[n]
            first += times
        rows.sort()
        self.sequences = first
        a = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.rank, self.per, self.first, self.offset = a.T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        lo, hi = np.searchsorted(self.length, length, "left"), np.searchsorted(self.length, length, "right")
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            a, b = lo[own[0]], hi[own[0]]
            i = a + np.searchsorted(self.rank[a:b], rank[own], "right") - 1
            d = rank[own] - self.rank[i]
            sequence[own] = self.first[i] + d // self.per[i]
            offset[own] = self.offset[i] + d % self.per[i] * n
        return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[int, ...] = LARGE) -> DataFrame:
    """``pieces`` (length, ...) with sequence_id and offset; ``pieces`` must be stable on disk."""
    spark = pieces.sparkSession
    prepare(spark)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(Layout(plan(histogram, capacity, groups, large)))
    # ranks: a common length is dealt over many buckets, whose counts are then summed up
    salts = [max(1, -(-histogram.get(n, 0) // SALT_ROWS)) for n in range(1, capacity + 1)]
    salts = F.lit(salts) if len(set(salts)) > 1 else F.lit([salts[0]] * capacity)
    key = pieces.columns
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(salts, F.col("length").cast("int"))))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__rank", F.row_number().over(own) - 1).join(starts, ["length", "__salt"]).select(*key, (F.col("__rank") + F.col("__before")).alias("__rank"))

    def run(batches):
        layout = sent.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            sequence, offset = layout.place(length, rank)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in key] + [pa.array(sequence), pa.array(offset)], names=[*key, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(materialize(tokenized_pieces(docs, path, capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
