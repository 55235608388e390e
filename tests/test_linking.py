"""Set-at-a-time forms against the single ones and against plain definitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import links, moves, ranks, resolve, search

NOTE = "path string, size long, mtime_ns long, mode int, content string"


def table(spark, notes):
    return spark.createDataFrame([(p, len(c or ""), i, 0o644, c) for i, (p, c) in enumerate(notes)], NOTE)


def odd_vault(seed, n=14):
    """Names of all characters that open and close links, and contents made of pieces of links to them."""
    r = random.Random(seed)
    piece = ["a", "b", "é", "[", "]", "[[", "]]", "|", "#", "(", ")", "](", ".", "/", "\\", ".md"]
    word = lambda k: "".join(r.choice(piece) for _ in range(r.randint(1, k)))
    name = lambda: word(4).replace("/", "_")
    names = sorted({"/".join([name() for _ in range(r.choice([0, 0, 1, 2]))] + [name()]) for _ in range(n)} | {"a", "f/a", "a]]", "a#b", "x [a]", "İ(", "a.md"})
    lead, end = ["[[", "](", "](./", "[[[", "]["], ["]]", "|", "#", ")", "]", "]](", ""]
    out = []
    for own in names:
        text = "".join(r.choice([r.choice(lead) + r.choice([x, x.upper(), x.rsplit("/", 1)[-1], x.replace("\\", "/"), x + ".md"]) + r.choice(end), word(3), "\n", " "]) for x in r.choices(names, k=40))
        out.append((own + ".md", text))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_all_backlinks_are_those_of_each_note(spark, seed):
    notes = table(spark, odd_vault(seed))
    want = set()
    for (path,) in notes.select("path").collect():
        want |= {(path, r.file_path, r.line_number, r.match_line) for r in links.backlinks(notes, path).collect()}
    got = [(r.target_path, r.file_path, r.line_number, r.match_line) for r in links.all_backlinks(notes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_all_backlinks_of_plain_names_and_of_nothing(spark):
    notes = table(spark, [("a.md", "[[b]] [[B|x]]\n](x](b.md)\n[[[b#h]]"), ("b.md", "](./a)\n[[]]"), (".md", "x"), ("c.txt", "[[a]]"), ("n.md", None)])
    got = {(r.target_path, r.file_path, r.line_number) for r in links.all_backlinks(notes).collect()}
    assert got == {("b.md", "a.md", 1), ("b.md", "a.md", 2), ("b.md", "a.md", 3), ("a.md", "b.md", 1), (".md", "b.md", 2)}
    assert links.all_backlinks(notes.limit(0)).count() == 0
    assert links.all_backlinks(notes.withColumn("size", F.lit(11 << 20))).count() == 0


def changed(notes, own, pairs):
    return {p: moves.plain(c, pairs, links.replacements) for p, c in own}


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize("seed", range(3))
def test_many_moves_at_once(spark, monkeypatch, seed, most):
    monkeypatch.setattr(moves, "MOST", most)
    own = odd_vault(seed + 10)
    names = [p[:-3] for p, _ in own]
    r = random.Random(seed)
    some = r.sample(names, 9)
    pairs = [(some[0], some[1]), (some[1], some[0]), (some[2], some[3]), (some[3], some[4]), (some[5], "new/é"), (some[6] + ".md", "y [z]"), ("nobody", "z")]
    table_ = table(spark, own)
    m = spark.createDataFrame([*pairs, (None, "x"), ("x", None)], "old string, new string")
    want = {p: moves.plain(c, [(a.removesuffix(".md"), b) for a, b in pairs], links.replacements) for p, c in own}
    got = {r.path: r.content for r in moves.rewritten_all(table_, m).collect()}
    assert got == {p: c for p, c in want.items() if c != dict(own)[p] and not p.rsplit("/", 1)[-1].startswith(".")}
    assert len(got) > 5


@pytest.mark.parametrize("most", [200_000, 0])
def test_chains_and_swaps(spark, monkeypatch, most):
    monkeypatch.setattr(moves, "MOST", most)
    text = "[[a]] [[b|x]] [[c#h]] ](f/a.md) ](./f/b) [[f/c]] [[[a]]](f/a) [[A]] [[aa]]"
    own = [("f/a.md", text), ("f/b.md", "no link"), ("f/c.md", None), (".h.md", text), (".d/n.md", text), ("x.txt", text), ("latin.md", "ü [[a]]")]
    m = spark.createDataFrame([("f/a", "f/b"), ("f/b", "g/c"), ("f/c", "f/a")], "old string, new string")
    notes = table(spark, own)
    new = "[[b]] [[c|x]] [[a#h]] ](f/b.md) ](./g/c) [[f/a]] [[[b]]](f/b) [[A]] [[aa]]"
    got = {r.path: r.content for r in moves.moved_all(notes, m).collect()}
    assert got == {"f/b.md": new, "g/c.md": "no link", "f/a.md": None, ".h.md": text, ".d/n.md": new, "x.txt": text, "latin.md": "ü [[b]]"}
    assert moves.clashes(notes, m).count() == 0
    worse = spark.createDataFrame([("f/a", "f/b")], "old string, new string")
    assert [tuple(r) for r in moves.clashes(notes, worse).collect()] == [("f/b.md", 2)]
    assert moves.rewritten_all(notes, m.limit(0)).count() == 0 and moves.moved_all(notes.limit(0), m).count() == 0


def test_one_move_is_the_single_form_and_keeps_bytes(spark):
    own = [(p, c) for p, c in odd_vault(30) if not p.startswith(".")]
    notes = table(spark, own)
    for old, new in (("a", "q"), ("f/a", "g/q"), ("x [a]", "y"), ("a#b", "a")):
        m = spark.createDataFrame([(old, new)], "old string, new string")
        one = {r.path: r.content for r in links.rewritten(notes, old, new).collect()}
        assert {r.path: r.content for r in moves.rewritten_all(notes, m).collect()} == one
    raw = spark.createDataFrame([("n.md", bytearray(b"caf\xe9 [[a]] \x00\xff")), ("o.md", bytearray(b"\xe9"))], "path string, content binary")
    got = moves.rewritten_all(raw, spark.createDataFrame([("a", "b")], "old string, new string")).collect()
    assert [(r.path, bytes(r.content)) for r in got] == [("n.md", b"caf\xe9 [[b]] \x00\xff")]


def test_names_of_a_table_resolve_as_one_by_one(spark):
    r = random.Random(4)
    folders = ["", "a/", "a/b/", "a/b/c/", "b/", "z/", "z/a/"]
    paths = sorted({r.choice(folders) + r.choice(["n", "m", "a", "x y"]) + ".md" for _ in range(18)} | {"a/n.txt"})
    notes = table(spark, [(p, "") for p in paths])
    names = sorted({p for p in paths} | {p.removesuffix(".md") for p in paths} | {"n", "m", "n.md", "nobody", "", "b/n"})
    got = {r.name: r.path for r in resolve.resolve_all(notes, spark.createDataFrame([(n,) for n in names] * 2, "name string")).collect()}
    want = {n: (resolve.resolve(notes, n).first() or [None])[0] for n in names}
    assert got == want and sum(v is not None for v in want.values()) > 10
    assert resolve.resolve_all(notes, notes.select(F.col("path").alias("name")).limit(0)).count() == 0


def test_places_in_one_order(spark):
    r = random.Random(8)
    paths = sorted({"/".join(r.choice(["a", "a b", "a-b", "B", "é"]) for _ in range(r.randint(1, 4))) + f"{i}.md" for i in range(500)}, key=lambda p: p.split("/"))
    notes = spark.createDataFrame([(p, len(p)) for p in r.sample(paths, len(paths))], "path string, size long").repartition(3)
    got = {r.path: r.place for r in resolve.ranked_notes(notes).collect()}
    assert [got[p] for p in paths] == list(range(1, len(paths) + 1))
    at = ranks.placed(notes, [F.split("path", "/")], F.col("size"), parts=7)
    sums = dict(zip(paths, itertools.accumulate([0, *map(len, paths)])))
    assert {r.path: r.before for r in at.collect()} == {p: sums[p] for p in paths}
    assert ranks.placed(notes.limit(0), [F.col("path")], F.col("size")).count() == 0


def best_alignment(path, query):
    """The definition: every way to place the query."""
    path, query = path.lower(), query.lower()
    best = None
    for at in itertools.combinations(range(len(path)), len(query)):
        if all(path[i] == c for i, c in zip(at, query)):
            s = sum(search.MATCH + search.START * (i == 0 or not path[i - 1].isalnum()) for i in at)
            s += sum(search.RUN if b == a + 1 else -search.GAP - search.SKIP * (b - a - 1) for a, b in zip(at, at[1:]))
            best = s if best is None else max(best, s)
    return best


def test_alignment_scores(spark):
    r = random.Random(6)
    paths = ["".join(r.choice("ab/_-é C") for _ in range(r.randint(0, 11))) for _ in range(120)] + ["", "ABab", "a_b_c/abc"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for q in ("a", "ab", "bCa", "éa"):
        got = [x.s for x in df.select(search.alignment_score(F.col("path"), q).alias("s")).collect()]
        assert got == [best_alignment(p, q) for p in paths]
    notes = table(spark, [("foo/bar.md", ""), ("f/o/o.md", ""), ("xfoo.md", ""), ("foo.txt", ""), ("foo.md", "")])
    assert [x.path for x in search.fuzzy_ranked(notes, "FOO").collect()]== ["foo.md", "f/o/o.md", "foo/bar.md", "xfoo.md"]
    assert search.fuzzy_ranked(notes, "").count() == 4 and search.fuzzy_ranked(notes, "zz").count() == 0
