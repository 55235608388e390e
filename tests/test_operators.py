import random

import pytest
from pyspark.sql import functions as F

from marginalia.model import notes_from_documents
from marginalia.operators import dml, links, resolve, search


def table(spark, files, mtime=None):
    rows = [(p, len(t.encode()), (mtime or {}).get(p, i), 0o644, t) for i, (p, t) in enumerate(files.items())]
    return spark.createDataFrame(rows, "path string, size long, mtime_ns long, mode int, content string")


def matches(df):
    return [(r.file_path, r.line_number, r.match_line) for r in df.collect()]


def test_list(spark):
    t = table(spark, {"a.md": "", "a/b.md": "", "x.txt": "", ".h/c.md": "", ".d.md": ""})
    assert [r.path for r in resolve.list_notes(t).collect()] == [".d.md", ".h/c.md", "a/b.md", "a.md"]


def test_search(spark):
    t = table(spark, {"n1.md": "A test\nnone\nTEST again", "test/n2.md": "x", "test-n3.md": "one Test", "r.txt": "test"})
    assert matches(search.search_notes(t, "test")) == [
        ("n1.md", 1, "A test"), ("n1.md", 3, "TEST again"), ("test/n2.md", 0, "(filename match: n2.md)"), ("test-n3.md", 1, "one Test")]
    assert matches(search.search_notes(t, "absent")) == []


def test_an_empty_query_is_in_every_line(spark):
    assert matches(search.search_notes(table(spark, {"n.md": "a\n"}), "")) == [("n.md", 1, "a"), ("n.md", 2, "")]


def test_size_cap_of_search(spark):
    t = table(spark, {"needle.md": "needle"}).withColumn("size", F.lit(10 * 1024 * 1024).cast("long"))
    assert matches(search.search_notes(t, "needle")) == [("needle.md", 0, "(filename match: needle.md)")]
    assert len(matches(search.search_notes(t.withColumn("size", F.col("size") - 1), "needle"))) == 1


def by_bytes(line, query):
    """The rules in plain Python."""
    m = line.strip()
    b = m.encode()
    if len(b) <= 80:
        return b
    at = m.lower().encode().find(query.lower().encode())
    if at < 0:
        return b[:80] + b"..."
    lo, hi = max(at - 20, 0), min(at + len(query.encode()) + 20, len(b))
    out = b"..." + b[lo:] if lo else b
    return out[: hi - lo] + b"..." if hi < len(b) else out


LINES = ["short q", "q" + "x" * 100, "y" * 100 + " q", "a" * 50 + "QQ" + "b" * 50, "é" * 60 + "q" + "漢" * 30, "z" * 90, " q" + "w" * 120, "q" * 81]


def test_snippets(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string").orderBy("i")
    for q in ("q", "Q", "xx", "é"):
        got = [bytes(r.s) for r in df.select(search.snippet(F.col("line"), q, as_bytes=True).alias("s")).collect()]
        assert got == [by_bytes(x, q) for x in LINES]
        whole = [r.s for r in df.select(search.snippet(F.col("line"), q).alias("s")).collect()]
        assert all(len(w.encode()) <= len(g) and (w.encode() == g or not g.isascii()) for w, g in zip(whole, got))


def test_display(spark):
    t = table(spark, {"n.md": "term é", "folder/longer.md": "x term", "term.md": ""})
    got = sorted(r.display for r in search.display(search.search_notes(t, "term")).collect())
    assert got == ["folder/longer.md:1 | x term", "n.md:1             | term é", "term.md            | (filename match: term.md)"]


def test_fuzzy(spark):
    t = table(spark, {"Cookies.md": "", "a/cook.md": "", "b.md": "", "c/o/o/k.md": ""})
    assert [r.path for r in search.fuzzy_search(t, "cook", 2).collect()] == ["a/cook.md", "c/o/o/k.md"]  # fewest edits of the base name: 3, 4 (and 6)


def test_backlinks(spark):
    t = table(spark, {
        "Target.md": "self [[Target]]", "a.md": " see [[target]] \n[x](Target.md)\nboth [[Target|alias]] [[Target#h]]", "sub/b.md": "![[TARGET]]\nno [[Targets]]",
        "c.md": "[x](./Target)", "d.txt": "[[Target]]", ".hid/e.md": "[[Target#x]]\r\n"}, {"a.md": 9})
    want = [("a.md", 1, "see [[target]]"), ("a.md", 2, "[x](Target.md)"), ("a.md", 3, "both [[Target|alias]] [[Target#h]]"), ("c.md", 1, "[x](./Target)"), (".hid/e.md", 1, "[[Target#x]]"), ("sub/b.md", 1, "![[TARGET]]")]
    got = matches(links.backlinks(t, "Target"))
    assert got[:3] == want[:3] and sorted(got) == sorted(want)
    assert got == matches(links.backlinks(t, "Target.md"))
    assert matches(links.backlinks(t, "nobody")) == []


def test_a_bare_name_does_not_leave_out_the_note_itself(spark):
    t = table(spark, {"x/Cookies.md": "[[Cookies]]"})
    assert len(matches(links.backlinks(t, "Cookies"))) == 1 and matches(links.backlinks(t, "x/Cookies")) == []


def test_size_cap_of_backlinks(spark):
    t = table(spark, {"a.md": "[[n]]"}).withColumn("size", F.lit(10 * 1024 * 1024).cast("long"))
    assert len(matches(links.backlinks(t, "n"))) == 1
    assert matches(links.backlinks(t.withColumn("size", F.col("size") + 1), "n")) == []


def test_all_backlinks_are_those_of_each_note(spark):
    r = random.Random(5)
    stems = ["n1", "f/n2", "f/N3", "g/n1", "^b", "h/i/n5"]
    shapes = ["[[{b}]]", "[[{p}#h]]", "![[{B}|x]]", "[a]({p}.md)", "[a](./{p})", "[[[{b}]]", "]({b})", "[[{b}", "({p}.md)"]
    word = lambda: r.choice(shapes).format(p=(s := r.choice(stems)), b=s.split("/")[-1], B=s.split("/")[-1].upper())
    t = table(spark, {f"{s}.md": "\n".join(" ".join(word() for _ in range(3)) + r.choice(["", "\r", " "]) for _ in range(6)) for s in stems})
    every = {(x.target_path, x.file_path, x.line_number, x.match_line) for x in links.all_backlinks(t).collect()}
    single = {(f"{s}.md", *m) for s in stems for m in matches(links.backlinks(t, s))}
    assert every == single and len(every) > 20


def test_mentions(spark):
    t = table(spark, {"a.md": "x [[T]]\ny [[T]]", "b/c.md": "[[T]]", "T.md": ""}, {"a.md": 1, "b/c.md": 5})
    (row,) = links.mentions(links.backlinks(t, "T")).collect()
    assert row.section == "\n\n## Linked Mentions\n\n**[[b/c]]**\n- [[T]]\n\n**[[a]]**\n- x [[T]]\n- y [[T]]\n"
    assert links.mentions(links.backlinks(t, "none")).collect() == []


def walk_and_skip(files, file):
    """A depth-first walk where a match skips the rest of its folder and later matches win."""
    tree = {}
    for f in files:
        node = tree
        *dirs, name = f.split("/")
        for d in dirs:
            node = node.setdefault(d + "/", {})
        node[name] = None
    found = None

    def go(node, prefix):
        nonlocal found
        for name in sorted(node, key=lambda n: n.rstrip("/")):
            if node[name] is not None:
                go(node[name], prefix + name)
            elif prefix + name == file or name == file:
                found = prefix + name
                return

    go(tree, "")
    return found


def test_resolve(spark):
    r = random.Random(1)
    for _ in range(12):
        files = {"/".join([*(r.choice("abn") for _ in range(r.randint(0, 3))), r.choice(["n.md", "m.md"])]) for _ in range(r.randint(1, 9))}
        name = r.choice(["n", "a/n", "m.md", "zz"])
        got = [x.path for x in resolve.resolve(table(spark, {f: "" for f in files}), name).collect()]
        want = walk_and_skip(files, name if name.endswith(".md") else name + ".md")
        assert got == ([want] if want else [])


def test_rewrite(spark):
    text = "[[old]] [[old#s]] [[old#s|t]] [x](old.md) [[OLD]] [[older]]"
    t = table(spark, {"1.md": text, "2.md": "none", "t.txt": text, ".h/3.md": "[[old]]", ".4.md": "[[old]]"})
    got = {r.path: r.content for r in links.rewritten(t, "old.md", "dir/new").collect()}
    assert got == {"1.md": "[[new]] [[new#s]] [[new#s|t]] [x](dir/new.md) [[OLD]] [[older]]", ".h/3.md": "[[new]]"}
    assert links.rewritten(t, "old", "old").count() == 0


def test_moving_there_and_back_restores_all(spark):
    t = table(spark, {"a/n.md": "[[n]] x", "b.md": "[[a/n|k]] [y](./a/n)"})
    after = dml.moved(t, "a/n", "fresh")
    assert {r.path: r.content for r in after.collect()} == {"fresh.md": "[[fresh]] x", "b.md": "[[fresh|k]] [y](./fresh)"}
    assert [(r.action, r.path, r.new_path) for r in dml.move_plan(t, "a/n", "fresh").orderBy("action", "path").collect()] == [
        ("rename", "a/n.md", "fresh.md"), ("rewrite", "b.md", None), ("rewrite", "fresh.md", None)]


def test_upserts(spark):
    t, c = table(spark, {"a.md": "1"}), spark.createDataFrame([("a.md", "2"), ("b.md", "3")], "path string, content string")
    rows = lambda df: {r.path: r.content for r in df.collect()}
    assert rows(dml.upserted(t, c, append=True)) == {"a.md": "12", "b.md": "3"}
    assert rows(dml.upserted(t, c, overwrite=True)) == {"a.md": "2", "b.md": "3"}
    assert rows(dml.upserted(t, c)) == {"a.md": "1", "a 1.md": "2", "b.md": "3"}
    assert rows(dml.deleted(t, "a")) == {} and rows(dml.with_content(t, "a.md", "n").select("path", "content")) == {"a.md": "n"}


def test_graph(spark):
    t = table(spark, {"a.md": "[[b]] [[nowhere]]", "b.md": "[[b]]", "c.md": "[x](b.md)"})
    assert [(r.path, r.n_lines, r.n_notes) for r in links.in_degree(t).collect()] == [("b.md", 2, 2)]
    assert sorted(r.path for r in links.orphans(t).collect()) == ["a.md", "c.md"]
    assert [(r.src_path, r.target) for r in links.dangling(t).collect()] == [("a.md", "nowhere")]
    assert links.ranked_backlinks(t, 1).count() == 1
    assert {r.path: r.n_links for r in links.out_degree(t).collect()} == {"a.md": 2, "b.md": 1, "c.md": 1}


def test_derived_notes(spark):
    d = spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(3)], "doc_id long, text string, lang string, source string")
    rows = {r.path: r.content for r in notes_from_documents(d, 3).collect()}
    assert rows["s/en/doc_1.md"] == "---\ntitle: doc_1\nlang: en\n---\ntext 1\nSee [[doc_1]] and [[doc_2|alias]]\nmd [x](s/en/doc_1.md)"


def test_the_prefilter_reaches_below_the_explode(spark):
    plan = search.search_lines(table(spark, {"n.md": "x"}), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Contains")


@pytest.mark.parametrize("bad", ["note", "a/b"])
def test_read_note(spark, bad):
    t = table(spark, {"02/Cook ies.md": "c", "note2.md": "d"})
    assert [r.content for r in resolve.read_note(t, "Cook ies").collect()] == ["c"] == [r.content for r in resolve.read_note(t, "02/Cook ies.md").collect()]
    assert resolve.read_note(t, bad).collect() == []


def test_new_notes_get_the_next_free_number(spark):
    notes = table(spark, {"x.md": "0", "x 1.md": "1", "x 3.md": "3", "y 1.md": "", "d/x.md": "d"}).select("path", "content")
    changes = spark.createDataFrame([("x.md", "b"), ("x.md", "a"), ("x.md", "c"), ("new.md", "q"), ("new.md", "p"), ("x 1.md", "z"), ("y.md", "y"), ("x 4.md", "w")], "path string, content string")
    got = dml.upserted(notes, changes).collect()
    paths = [r.path for r in got]
    assert len(set(paths)) == len(paths) == 13
    own = {r.path: r.content for r in got}
    assert [own[p] for p in ("x 2.md", "x 5.md", "x 6.md")] == ["a", "b", "c"] and own["x 4.md"] == "w" and own["x 1 1.md"] == "z"
    assert own["new.md"] == "p" and own["new 1.md"] == "q" and own["y.md"] == "y" and own["x.md"] == "0"


def test_repeated_changes_of_one_path(spark):
    notes = table(spark, {"x.md": "0"}).select("path", "content")
    changes = spark.createDataFrame([("x.md", "b"), ("x.md", "a"), ("n.md", "2"), ("n.md", "1")], "path string, content string")
    assert sorted(map(tuple, dml.upserted(notes, changes, append=True).collect())) == [("n.md", "12"), ("x.md", "0ab")]
    assert sorted(map(tuple, dml.upserted(notes, changes, overwrite=True).collect())) == [("n.md", "2"), ("x.md", "b")]


def test_strict_rewriting_leaves_shared_names(spark):
    files = {"a/old.md": "", "n.md": "[[old]] [[a/old]] [x](a/old.md)"}
    change = lambda f, strict: {r.path: r.content for r in links.rewritten(table(spark, f), "a/old", "a/new", strict).collect()}
    assert change(files, True) == {"n.md": "[[new]] [[a/new]] [x](a/new.md)"}
    assert change(files | {"b/old.md": ""}, True) == {"n.md": "[[old]] [[a/new]] [x](a/new.md)"}
    assert change(files | {"b/old.md": ""}, False) == {"n.md": "[[new]] [[a/new]] [x](a/new.md)"}
