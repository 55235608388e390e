"""Operators 11 to 13 against their definitions, on small tables with nulls, empty and very long
texts, ties, repeated rows and clashing column names, and on empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle, periodic, superkmer

DOC = "doc_id long, text string"


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=str)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


# 11 ----------------------------------------------------------------------------------------


def stretches(r, n):
    """Words with repeats of every sort: nested periods, copies, powers of one word."""
    k, w = r.choice([0, 1, 1, 2, 4, 8]), []
    while len(w) < n:
        unit = [r.randint(0, k) for _ in range(r.randint(1, 7))]
        w += unit * r.choice([1, 1, 2, 3, 4, 5, 9])
        if w and r.random() < 0.4:
            a = r.randrange(len(w))
            w += w[a : a + r.randint(1, 50)]
    return w[:n]


def test_runs_of_random_words():
    r = random.Random(11)
    found = 0
    for _ in range(1500):
        w = stretches(r, r.randint(0, 150))
        want = periodic.brute(w)
        assert periodic.runs_of(np.array(w, np.int64)) == want, w
        found += len(want)
    assert found > 2000


@pytest.mark.parametrize("length, exponent", [(1, 3), (6, 4), (20, 5)])
def test_runs_by_other_bounds(length, exponent):
    r = random.Random(length)
    for _ in range(200):
        w = stretches(r, 120)
        assert periodic.runs_of(np.array(w, np.int64), length, exponent) == periodic.brute(w, length, exponent)
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.int64), 6, 2)


def test_runs_of_long_powers():
    assert periodic.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    one = np.tile(np.arange(1000), 41)
    assert periodic.runs_of(one) == [(0, 41_000, 1000)]
    assert periodic.runs_of(np.concatenate([one[:3999], [-1 % 5000], one])) == [(4000, 45_000, 1000)]


def expected_runs(docs):
    out = []
    for i, t in docs:
        w = periodic.planted(i, (t or "").encode().split())
        found = periodic.brute(w)
        drop = {k for x, y, q in found for k in range(x + q, y)}
        best = min(((-(y - x) / q, x, q, y - x) for x, y, q in found), default=None)
        four = (best[1], best[3], best[2], 1000 * best[3] // best[2]) if best else (None,) * 4
        h = lambda s: hashlib.sha256(s).hexdigest()
        out.append((i, len(found), *four, h("".join(f"{x},{y - x},{q}\n" for x, y, q in found).encode()), h(b" ".join(x for k, x in enumerate(w) if k not in drop))))
    return out


def test_runs_of_documents(spark, monkeypatch):
    r = random.Random(5)
    tenth = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    text = lambda n: " ".join(f"é{x}" for x in stretches(r, n))
    docs = [(i, text(r.randint(0, 120))) for i in range(60)] + [(i, " ".join(f"w{k}" for k in range(r.randint(1, 300)))) for i in tenth]
    docs += [(None, "a " * 9), (None, None), (7, None), (7, ""), (8, " \n\t "), (9, "\x0ba\x0ca\ra a\na\ta "), (9, "a\x85a\xa0a " * 3), tuple(docs[3]), tuple(docs[3]), (300, text(9000))]
    df = spark.createDataFrame([(*d, 5) for d in docs], f"{DOC}, n_runs int")  # a clashing name
    got = periodic.find_runs(df, change=periodic.planted, digests=True)
    assert got.columns == ["doc_id", "text", *periodic.FIELDS.names]
    same(rows(got.drop("text")), expected_runs(docs))
    monkeypatch.setattr(periodic, "CHUNK", 50)
    same(rows(periodic.find_runs(df, change=periodic.planted, digests=True).drop("text")), expected_runs(docs))
    plain = periodic.find_runs(spark.createDataFrame([(1, "x a b a b a b a b y")], DOC)).first()
    assert plain[2:] == (1, 1, 8, 2, 4000, "1,8,2\n", "x a b y")
    assert periodic.find_runs(df.limit(0)).count() == 0


# 12 ----------------------------------------------------------------------------------------


def copied(r):
    """Passages that documents share whole, in part, overlapping and edited."""
    words = lambda n, v=3000: [f"w{r.randint(0, v)}" for _ in range(n)]
    shared = [words(n) for n in (12, 15, 30, 90)]
    docs = []
    for i in range(40):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(shared)
            a = r.randrange(len(p))
            w += words(r.randint(0, 20)) + (p if r.random() < 0.5 else p[a:])
        if w and r.random() < 0.3:
            w[r.randrange(len(w))] = "edit"
        docs.append((i * 3 % 41, " ".join(w)))
    docs += [(100 + i, docs[5][1]) for i in range(5)] + [(200, "go " * 300), (3, "go " * 900), (201, "go " * 20), (202, "a b " * 100)]
    docs += [(None, docs[5][1]), (None, docs[5][1]), (300, None), (300, ""), (301, " \n "), docs[7], docs[7], (docs[7][0], docs[8][1])]
    docs += [(400, docs[9][1].replace(" ", " ")), (401, "\n".join(docs[9][1].split())), (402, docs[9][1].upper())]
    return docs


@pytest.mark.parametrize("hot, longest", [(1 << 17, 512), (0, 512), (30, 3)])
def test_windows_of_earlier_documents(spark, monkeypatch, hot, longest):
    monkeypatch.setattr(superkmer, "LONGEST", longest)
    docs = copied(random.Random(12))
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], f"{DOC}, n_words int, d string")
    got = superkmer.drop_repeated_windows(df, k=12, m=4, hot=hot)
    assert got.columns == ["doc_id", "d", "n_words", "n_removed", "text"]
    want = superkmer.brute(docs, 12)
    same(rows(got, "doc_id", "n_words", "n_removed", "text"), want)
    assert sum(w[2] for w in want) > 1000


def test_windows_of_one_word_and_of_nothing(spark):
    docs = [(1, "a b c"), (2, "c d a"), (3, "d")]
    df = spark.createDataFrame(docs, DOC)
    same(rows(superkmer.drop_repeated_windows(df, k=1, m=1), "doc_id", "n_words", "n_removed", "text"), superkmer.brute(docs, 1))
    none = superkmer.drop_repeated_windows(df.limit(0))
    assert none.count() == 0
    few = rows(superkmer.drop_repeated_windows(spark.createDataFrame([(1, " too  few\nwords "), (2, None)], DOC)), "doc_id", "n_words", "n_removed", "text")
    same(few, [(1, 3, 0, "too few words"), (2, 0, 0, "")])
    with pytest.raises(ValueError):
        superkmer.drop_repeated_windows(df, k=4, m=5)


def test_equal_windows_have_equal_minimisers():
    r = random.Random(3)
    passage = [b"p%d" % r.randint(0, 50) for _ in range(80)]
    a, b = ([b"x%d" % r.randint(0, 9) for _ in range(n)] + passage for n in (5, 31))
    assert (superkmer.minimisers(a, 50, 8)[5:] == superkmer.minimisers(b, 50, 8)[31:]).all()
    first, count, _, strings = superkmer.packed(a, 50, 8)
    assert count.sum() == len(a) - 49 and list(superkmer.windows(strings[0], 50))[0] == b" ".join(a[:50])


# 13 ----------------------------------------------------------------------------------------

ROW = "doc_id long, source string, lang string, n_chars long, text string"


def documents(n, seed=13):
    r = random.Random(seed)
    source = lambda: r.choice(["big"] * 6 + [None, "", "ä", "z", "b"])
    out = [(i, source(), r.choice([None, "en", "fr"]), r.choice([None, i]), r.choice([None, "", "Text É", f"lower {i}", "A" * 2000])) for i in r.sample(range(10 * n), n)]
    return out + out[:3] + [(out[0][0], *out[1][1:]), (None, "big", "en", 1, "X"), (None, "big", "en", 1, "X"), (None, None, None, None, None)]


@pytest.mark.parametrize("n, size", [(2, 9), (900, 20)])
def test_manifest(spark, monkeypatch, n, size):
    monkeypatch.setattr(merkle, "ROWS", size)
    docs = documents(n)
    df = spark.createDataFrame([(*d, "x") for d in docs], f"{ROW}, leaf string").repartition(5)
    monkeypatch.setattr(merkle, "LEAST", 1)
    at, _ = merkle.ranged(df.select(merkle.key_of(F.col("source")).alias("tree"), "doc_id"), ["doc_id"])
    assert at.select("part").distinct().count() > min(n, 30) / 3
    got = merkle.manifest(merkle.row_leaves(df)).collect()
    same([r[:5] for r in got], merkle.brute(docs))
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST", 40)
    docs = [(i, f"s{i * 7 % 400}", None, i, "t") for i in range(900)]
    got = merkle.manifest(merkle.row_leaves(spark.createDataFrame(docs, ROW))).collect()
    same([r[:5] for r in got], merkle.brute(docs))


def test_tampering_shows(spark):
    docs = documents(300)
    df = spark.createDataFrame(docs, ROW)
    got = merkle.manifest(merkle.row_leaves(df, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))).collect()
    same([r[:5] for r in got], merkle.brute(docs))
    bad = {d[0] for d in docs if d[0] is not None and d[0] % 2 == 0 and d[4] and d[4] != d[4].replace("T", "t").replace("A", "a")}
    assert bad and {r.doc_id for r in got if not r.verified} == bad
    # the folded root is the root of a table with the changed row in its old place
    one = next(r for r in got if not r.verified)
    assert one.folded_root != one.root and len(one.folded_root) == 64


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(5, None, "en", 2, "ab")], ROW)
    (r,) = merkle.manifest(merkle.row_leaves(df)).collect()
    leaf = hashlib.sha256(b"1:5-2:en1:22:ab").hexdigest()
    assert tuple(r) == (5, leaf, leaf, leaf, hashlib.sha256(b"").hexdigest(), leaf, True)
    assert merkle.manifest(merkle.row_leaves(df.limit(0))).count() == 0
