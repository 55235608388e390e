"""Merkle manifest of a dataset: leaves per row, a subtree per source, one root, and proofs.

A node is the SHA-256 of its at most ``ARITY`` children, in hexadecimal. Rows are hashed where they are read; from
there on only digests travel. They are range-sorted by (tree, order), and each partition counts its rows of each
tree; running sums of those counts over the partitions give every row its place in its tree without
bringing a tree together. A partition then hashes all complete aligned runs it holds, level by level; runs that
reach over its ends (two a level at most) are sent off piece by piece, meet by coordinate (tree,
level, run), and are hashed a level at a time up to the root: a tree that holds a third of all rows is
work for all tasks. Subroots are the leaves of one more tree, built the same way.

Proofs are made where the leaves are: each partition hashes its runs again, and gets the runs it lacks on
the way up from its own leaves, which are two for each level of a tree.

Order: trees by source (null first, else by bytes), leaves by id (null first), then by digest, so rows that repeat
an id have a place too. Defined results: a null value is ``-``; a null id is never tampered with; an empty table
gives an empty one; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .line_dedup import LOWER, UPPER, lower_ascii

ARITY = 16
#: Rows that a partition of the sort may have: a task takes one partition's digests at a time.
ROWS = 250_000
#: Rows below which a partition is not worth having.
LEAST = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    """The SHA-256 of values, each with its length in front of it, or ``-`` for a null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def key_of(source: Column) -> Column:
    """A tree's key, never null, that sorts as the source does."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit(""))


def ranged(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (tree, ...) in range-sorted partitions, with ``part`` and ``row``; and for each partition's share
    of a tree: tree, part, first (row), n, start (the place of its first leaf) and total of the tree."""
    n, spark = rows.count(), rows.sparkSession
    parts = max(1, min(-(-n // LEAST), max(3 * spark.sparkContext.defaultParallelism, -(-n // ROWS))))
    by = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    at = by.withColumn("__at", F.monotonically_increasing_id())  # partition << 33 | row
    at = at.withColumn("part", F.shiftright("__at", 33).cast("int")).withColumn("row", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")
    at = materialize(at, "sorted")
    share = at.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    one = Window.partitionBy("tree")
    # a tree has at most one row for each partition here
    share = share.withColumn("start", F.sum("n").over(one.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(one))
    return at, materialize(share, "shares")


def node(run: bytes) -> bytes:
    return sha256(run).hexdigest().encode()


def climb(nodes: list[bytes], start: int, total: int):
    """The runs of a stretch of a tree's leaves, level by level, as (level, run number, place in the
    run of the first node that is here, nodes, whether the run is whole, nodes in the level); last, where the
    stretch is the whole tree, its root as a level of one node."""
    level = 0
    while nodes:
        if total == 1:
            yield level, 0, 0, nodes, True, 1
            return
        up, first = [], None
        for run in range(start // ARITY, (start + len(nodes) - 1) // ARITY + 1):
            low = max(run * ARITY, start)
            own = nodes[low - start : (run + 1) * ARITY - start]
            whole = len(own) == min(ARITY, total - run * ARITY)
            yield level, run, low - run * ARITY, own, whole, total
            if whole:
                up.append(node(b"".join(own)))
                first = run if first is None else first
        nodes, start, total, level = up, first or 0, -(-total // ARITY), level + 1


def levels(total: Column) -> Column:
    """How many levels of runs a tree of so many leaves has: the hexadecimal digits of total - 1."""
    return F.when(total == 1, 0).otherwise(F.length(F.hex(total - 1)))


PIECES = "tree string, level int, run long, at int, nodes string, kind string, total long"


def build(at: DataFrame, shares: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trees over ``at`` (part, row, leaf) with its ``shares``: the runs (tree, level, run, nodes) that no partition
    holds alone (``every``: all runs), and the roots (tree, root)."""

    def local(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        leaves = [x.hex().encode() for x in rows.column("leaf").to_pylist()]
        out = []
        for s in own.to_pylist():
            for level, run, place, nodes, whole, total in climb(leaves[s["first"] : s["first"] + s["n"]], s["start"], s["total"]):
                kind = "root" if total == 1 else "whole" if whole else "piece"
                if kind != "whole" or every:
                    out.append((s["tree"], level, run, place, b"".join(nodes).decode(), kind, total))
        cols = list(zip(*out)) or [()] * 7
        types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["tree", "level", "run", "at", "nodes", "kind", "total"])

    digests = at.select("part", "row", "leaf")
    pieces = digests.groupBy("part").cogroup(shares.groupBy("part")).applyInArrow(local, PIECES)
    pieces = materialize(pieces, "pieces")
    roots, runs = pieces.where("kind = 'root'").select("tree", "nodes"), pieces.where("kind = 'whole'").select("tree", "level", "run", "nodes")
    low = pieces.where("kind = 'piece'").agg(F.min("level"), F.max(levels(F.col("total")) + F.col("level"))).first()
    up = None
    for level in range(*low) if low[0] is not None else ():
        now = pieces.where((F.col("kind") == "piece") & (F.col("level") == level)).select("tree", "run", "at", "nodes", "total")
        now = now.unionByName(up) if up is not None else now
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nodes"))), lambda x: x["nodes"]), "")  # at most ARITY
        met = materialize(now.groupBy("tree", "run", "total").agg(joined.alias("nodes")), f"level{level}")
        runs = runs.unionByName(met.select("tree", F.lit(level).alias("level"), "run", "nodes"))
        left = F.expr(f"(total + {ARITY - 1}) div {ARITY}")
        up = met.select("tree", F.expr(f"run div {ARITY}").alias("run"), (F.col("run") % ARITY).cast("int").alias("at"), F.sha2("nodes", 256).alias("nodes"), left.alias("total"))
        roots = roots.unionByName(up.where("total = 1").select("tree", "nodes"))
        up = up.where("total > 1")
    return runs, materialize(roots.withColumnRenamed("nodes", "root"), "roots")


PROOFS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def proofs(at: DataFrame, given: DataFrame, top: int) -> DataFrame:
    """A row per leaf, from the leaves of each partition and what :func:`manifest` gives it; the
    upper tree has ``top`` leaves."""

    def local(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        hexed = lambda name: [x and x.hex().encode() for x in rows.column(name).to_pylist()]
        leaves, tampered, ids = hexed("leaf"), hexed("tampered"), rows.column("doc_id").to_pylist()
        shares, lacking, upper = [], {}, {}
        for r in own.to_pylist():
            if r["kind"] == "share":
                shares.append(r)
            else:
                (lacking if r["kind"] == "run" else upper)[r["tree"], r["level"], r["run"]] = r["nodes"].encode()
        out = []
        for s in sorted(shares, key=lambda r: r["first"]):
            mine = leaves[s["first"] : s["first"] + s["n"]]
            runs = {(level, run): b"".join(nodes) for level, run, _, nodes, whole, total in climb(mine, s["start"], s["total"]) if whole and total > 1}

            def path(place: int, total: int, level: int, runs_at):
                while total > 1:
                    place, within, total = place // ARITY, place % ARITY, -(-total // ARITY)
                    yield runs_at(level, place), within * 64
                    level += 1

            above = list(path(s["rank"], top, 0, lambda level, run: upper["", level, run]))
            inside = lambda level, run: runs.get((level, run)) or lacking[s["tree"], level, run]
            last = None
            for i, leaf in enumerate(mine):
                place, k = s["start"] + i, s["first"] + i
                if s["total"] > 1 and place // ARITY != last:  # the leaves of one run share what is above it
                    last = place // ARITY
                    base = inside(0, last)
                    chain = list(path(last, -(-s["total"] // ARITY), 1, inside)) + above
                    rest = b"".join(run[:w] + run[w + 64 :] for run, w in chain)
                    folded = {}
                elif i == 0:
                    base, chain, folded = None, above, {}
                    rest = b"".join(run[:w] + run[w + 64 :] for run, w in chain)
                w = place % ARITY * 64
                h = sha256()
                if base is not None:
                    h.update(base[:w])
                    h.update(base[w + 64 :])
                h.update(rest)
                start = tampered[k] or leaf
                got = node(base[:w] + start + base[w + 64 :]) if base is not None else start
                if got not in folded:
                    x = got
                    for run, v in chain:
                        x = node(run[:v] + x + run[v + 64 :])
                    folded[got] = x
                out.append((ids[k], leaf.decode(), s["nodes"], h.hexdigest(), folded[got].decode()))
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 4))], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    rows = at.select("part", "row", "doc_id", "leaf", "tampered")
    return rows.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(local, PROOFS)


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (source, doc_id, leaf, tampered: another digest to fold instead, or null; digests in
    hexadecimal) to doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = leaves.select(key_of(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex("leaf").alias("leaf"), F.unhex("tampered").alias("tampered"))
    at, shares = ranged(materialize(rows, "leaves"), ["doc_id", "leaf", "tampered"])
    runs, subroots = build(at, shares)
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.unhex("root").alias("leaf"), "root")
    top_at, top_shares = ranged(tops, ["source"])
    top_runs, root = build(top_at, top_shares, every=True)
    n, root = top_at.count(), (root.first() or [None, None])[1]  # one digest
    place = top_at.join(top_shares, ["tree", "part"]).select(F.col("source").alias("tree"), (F.col("row") - F.col("first") + F.col("start")).alias("rank"), F.col("root").alias("nodes"))
    own = materialize(shares.join(place, "tree"), "ranked")
    # the runs on the way up: of a stretch of a tree, those of its two ends at each level
    level, both = F.explode(F.expr("sequence(0, h - 1)")).alias("level"), lambda c: F.expr(f"shiftright({c}, 4 * (level + 1))")
    need = own.withColumn("h", levels(F.col("total"))).where("h > 0").select("tree", "part", "start", (F.col("start") + F.col("n") - 1).alias("end"), level)
    need = need.select("tree", "part", "level", F.explode(F.array_distinct(F.array(both("start"), both("end")))).alias("run"))
    lacking = need.join(runs, ["tree", "level", "run"]).select("part", F.lit("run").alias("kind"), "tree", "level", "run", "nodes")
    span = own.groupBy("part").agg(F.min("rank").alias("start"), F.max("rank").alias("end")).withColumn("h", levels(F.lit(max(1, n)))).where("h > 0")
    span = span.select("part", "start", "end", level).select("part", "level", F.explode(F.sequence(both("start"), both("end"))).alias("run"))
    upper = span.join(top_runs, ["level", "run"]).select("part", F.lit("top").alias("kind"), F.lit("").alias("tree"), "level", "run", "nodes")
    given = own.withColumn("kind", F.lit("share")).unionByName(lacking, allowMissingColumns=True).unionByName(upper, allowMissingColumns=True)
    out = proofs(at, given, n).withColumn("root", F.lit(root).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def row_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves for rows of documents; where ``tampered`` holds, also the leaf with the text in lower case."""
    cols = [F.col(c) for c in FIELDS]
    other = digest(*cols[:-1], lower_ascii(F.col("text")))
    return docs.select("source", "doc_id", digest(*cols).alias("leaf"), (F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")).alias("tampered"))


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256) of rows in the order of :data:`FIELDS`, by the
    definition; for tests."""
    h = lambda s: sha256(s.encode()).hexdigest()
    leaf = lambda row: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))
    tree: dict = {}
    for row in rows:
        tree.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row)))

    def raised(nodes):
        sides = [[] for _ in nodes]
        place, now = list(range(len(nodes))), list(nodes)
        while len(now) > 1:
            cut = [now[i : i + ARITY] for i in range(0, len(now), ARITY)]
            for k, p in enumerate(place):
                own = cut[p // ARITY]
                sides[k] += own[: p % ARITY] + own[p % ARITY + 1 :]
                place[k] = p // ARITY
            now = [h("".join(c)) for c in cut]
        return now[0], sides

    sources = sorted(tree, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: raised([x[2] for x in sorted(tree[s])]) for s in sources}
    root, above = raised([below[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for (known, i, own), sides in zip(sorted(tree[s]), below[s][1]):
            out.append((i if known else None, own, below[s][0], root, h("".join(sides + up))))
    return out


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return manifest(row_leaves(docs, fifth))


def _levels_sql(name: str, leaves: str, depth: int) -> str:
    """Tables ``name``_0 to ``name``_depth of nodes (tree, i, h, n), where a finished tree is carried on as it is;
    and ``name``_p (tree, i, steps): for each level the siblings of leaf i, with | where its own node goes."""
    out = [f"{name}_0 AS ({leaves})"]
    for k in range(depth):
        out.append(
            f"{name}_{k + 1} AS (SELECT tree, i // {ARITY} AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (n + {ARITY - 1}) // {ARITY} AS n FROM {name}_{k} GROUP BY tree, i // {ARITY}, n)"
        )
    steps = "\n  UNION ALL ".join(
        f"SELECT a.tree, a.i, {k} AS level, string_agg(CASE WHEN b.i = a.i // {ARITY**k} THEN '|' ELSE b.h END, '' ORDER BY b.i) AS s FROM {name}_0 a JOIN {name}_{k} b ON a.tree = b.tree AND b.i // {ARITY} = a.i // {ARITY ** (k + 1)} WHERE b.n > 1 GROUP BY a.tree, a.i"
        for k in range(depth)
    )
    out.append(f"{name}_p AS (SELECT tree, i, list(s ORDER BY level) AS steps FROM ({steps}) GROUP BY tree, i)")
    return ",\n".join(out)


_TEXT = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_TEXT.format(c) for c in FIELDS) + ")"
_LOWER = f"translate(text, '{UPPER}', '{LOWER}')"
_DEPTH, _TOP = 6, 3
#: For trees of at most 16 ** 6 leaves and 16 ** 3 sources; CRC-32 by its table, which is computed first.
OP13_SQL = f"""
WITH t AS (
  SELECT list(v ORDER BY c) AS t FROM (SELECT c, list_reduce([c] || range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(c))
), d AS (
  SELECT doc_id, coalesce('1' || source, '') AS tree, {_LEAF} AS leaf, {_LEAF.replace("(text", "(" + _LOWER).replace(" text IS", " " + _LOWER + " IS")} AS other,
    xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')], lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS crc FROM documents, t
), p AS (
  SELECT doc_id, tree, leaf, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS shown, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d
), {_levels_sql("a", "SELECT tree, i, leaf AS h, n FROM p", _DEPTH)},
s AS (SELECT tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM a_{_DEPTH}),
{_levels_sql("b", "SELECT '' AS tree, i, h, n FROM s", _TOP)},
f AS (
  SELECT p.doc_id, p.leaf, p.shown, s.h AS subroot, b_{_TOP}.h AS root, coalesce(a_p.steps, []) || coalesce(b_p.steps, []) AS steps
  FROM p JOIN s ON s.source = p.tree CROSS JOIN b_{_TOP} LEFT JOIN a_p ON a_p.tree = p.tree AND a_p.i = p.i LEFT JOIN b_p ON b_p.i = s.i
), g AS (
  SELECT *, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, list_reduce([shown] || steps, lambda x, y: sha256(replace(y, '|', x))) AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
