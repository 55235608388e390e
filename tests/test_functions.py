import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.actions import build_uri, editor_command, unescape_text
from marginalia.functions import frontmatter as fm
from marginalia.functions import paths, text
from marginalia.operators import links


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_suffix(spark):
    assert column(spark, ["a", "a.md", "a.md.md", ""], paths.add_md) == ["a.md", "a.md", "a.md.md", ".md"]
    assert column(spark, ["a", "a.md", "a.md.md", "b.md\n"], paths.remove_md) == ["a", "a", "a.md", "b.md\n"]


def test_walk_order(spark):
    got = spark.createDataFrame([(p,) for p in ("a.md", "a/b.md", "Note.md", "a/Note.md")], "p string").orderBy(paths.walk_key(F.col("p"))).collect()
    assert [r.p for r in got] == ["Note.md", "a/Note.md", "a/b.md", "a.md"]


def test_trim_knows_all_white_space(spark):
    assert column(spark, ["\u0085\t x y\r\n", "\u00a0z\u3000", ""], text.trim_ws) == ["x y", "z", ""]


def test_lines_keep_the_last_empty_one(spark):
    assert column(spark, ["a\nb\n", "", "a\r\nb"], text.lines) == [["a", "b", ""], [""], ["a\r", "b"]]


ESCAPED = [r"one\ntwo\tthree\rfour \"five\" \'six\' \\seven", r"\\n", "\\", r"a\b", "", "é\\n漢"]
PLAIN = ["one\ntwo\tthree\rfour \"five\" 'six' \\seven", "\\n", "\\", r"a\b", "", "é\n漢"]


def test_unescape(spark):
    assert column(spark, ESCAPED, text.unescape) == PLAIN
    assert [unescape_text(x) for x in ESCAPED] == PLAIN


def test_uri(spark):
    got = spark.range(1).select(text.uri("b://o", a="x y/é*$&+=:@~", n="", f="false", t=True).alias("u")).first().u
    assert got == "b://o?a=x%20y%2F%C3%A9%2A$&+=:@~&t=true" == build_uri("b://o", {"a": "x y/é*$&+=:@~", "n": "", "f": "false", "t": "true"})
    assert build_uri("b", {"k": ""}) == "b"


def test_values(spark):
    assert column(spark, ["true", "false", "12", "[a,  b]", "[]", 'q"', "["], text.value_json) == ["true", "false", '"12"', '["a","b"]', "[]", '"q\\""', '"["']


INSIDE = {"note.md": 1, "a/b": 1, "a/../b": 1, ".": 1, "": 1, "../x": 0, "a/../../x": 0, "..": 0, "/etc": 0, "a/./b/..": 1, "..x": 1}


def test_paths_stay_inside(spark, tmp_path):
    assert column(spark, list(INSIDE), paths.stays_inside) == [bool(x) for x in INSIDE.values()]
    for rel, ok in INSIDE.items():
        if ok:
            assert paths.validate_path(str(tmp_path), rel).startswith(str(tmp_path))
        else:
            with pytest.raises(paths.PathError):
                paths.validate_path(str(tmp_path), rel)


@given(st.text("./a", max_size=12))
def test_validated_paths_never_escape(rel):
    try:
        got = paths.validate_path("/v/base", rel)
    except paths.PathError:
        return
    assert got == "/v/base" or got.startswith("/v/base/")


def test_link_shapes(spark):
    assert links.shapes("n") == ["[[n]]", "[[n|", "[[n#", "](n.md)", "](n)", "](./n.md)", "](./n)"]
    assert len(links.shapes("a\\n.md")) == 10
    assert column(spark, ["d/n.md", "n.md"], lambda c: F.array_sort(links.link_shapes(c))) == [sorted(links.shapes(x)) for x in ("d/n.md", "n.md")]


def test_replacements():
    assert links.replacements("a/old", "b/new")["[[a/old#"] == "[[b/new#"
    assert links.replacements("old", "new.md") == {
        "[[old]]": "[[new]]", "[[old|": "[[new|", "[[old#": "[[new#", "](old.md)": "](new.md)", "](old)": "](new)", "](./old.md)": "](./new.md)", "](./old)": "](./new)"}


def test_the_order_of_replacements_does_not_matter():
    pairs, r = links.replacements("x/old", "y/new"), random.Random(3)
    content = "".join(r.choice([*pairs, "[[", "old", "](", "x/old.md)", " t "]) for _ in range(200))
    results = set()
    for _ in range(20):
        items, out = list(pairs.items()), content
        r.shuffle(items)
        for a, b in items:
            out = out.replace(a, b)
        results.add(out)
    assert len(results) == 1


def test_editor(monkeypatch):
    monkeypatch.setenv("EDITOR", "/usr/bin/code -n")
    assert editor_command("f") == ["/usr/bin/code", "-n", "--wait", "f"]
    monkeypatch.delenv("EDITOR")
    assert editor_command("f") == ["vim", "f"]


NOTES = ["---\nkind: recipe\nparts:\n  - a\n  - b\n---\nStir.", "---\n---\nStir.", "No header here", "---\nx: {open\n---\nStir.", "", "---\r\na: 1\r\n---\r\nB", "---\nnever closed", "---\n- list\n---\n"]


def test_header(spark):
    assert column(spark, NOTES, fm.has_header) == [True, True, False, True, False, True, True, True]
    got = column(spark, NOTES, lambda c: F.to_json(F.struct(F.to_json(fm.parse(c)["values"]).alias("v"), fm.parse(c)["body"].alias("b"), fm.parse(c)["error"].alias("e"))))
    import json

    got = [json.loads(x) for x in got]
    assert [g.get("v") for g in got] == ['{"kind":"recipe","parts":["a","b"]}', None, None, None, None, '{"a":1}', None, None]
    assert [g.get("b") for g in got] == ["Stir.", "Stir.", "No header here", None, "", "B", "---\nnever closed", None]
    assert [g.get("e") for g in got] == [None, None, None, fm.BAD_YAML, None, None, None, fm.BAD_YAML]
    assert column(spark, NOTES, fm.keys)[:3] == [["kind", "parts"], [], []]


@pytest.mark.parametrize("value, want", [("true", True), ("false", False), ("[one, two, three]", ["one", "two", "three"]), ("[]", []), ("12", "12"), ("x: y", "x: y")])
def test_set_key(spark, value, want):
    for note in ("---\nkind: soup\n---\nPlain body", "A plain body", "---\n---\n\nbody"):
        (r,) = column(spark, [note], lambda c: fm.set_key(c, "k", value))
        head = r.content.split("---\n")[1]
        assert fm.load(head)["k"] == want and r.error is None and r.content.endswith("ody")


def test_delete_key(spark):
    notes = ["---\nkind: k\ncook: me\n---\nStir.", "---\ncook: me\n---\n\nStir.", "No header here", "---\nkind: k\n---\nStir.", "---\n---\nB", "---\nx: {\n---\nB"]
    got = column(spark, notes, lambda c: fm.delete_key(c, "cook"))
    assert [r.content for r in got] == ["---\nkind: k\n---\nStir.", "Stir.", None, "---\nkind: k\n---\nStir.", None, None]
    assert [r.error for r in got] == [None, None, fm.NO_HEADER, None, fm.NO_HEADER, fm.BAD_YAML]


ODD = ["2024-01-01: x\n2: y\ntrue: z", "a: .nan\nb: [.inf, -.inf]", "d: 2024-13-45", "? [1, 2]\n: x", "a: &a [*a]", "when: 2024-05-06\nn: 1", "!!python/object:os.system x", "a: !!binary aGk="]


def test_odd_headers_break_nothing(spark):
    notes = [f"---\n{x}\n---\nrest" for x in ODD]
    got = column(spark, notes, lambda c: F.struct(F.to_json(fm.parse(c)["values"]).alias("v"), fm.parse(c)["error"].alias("e"), fm.keys(c).alias("k")))
    assert [r.e for r in got] == [None, None, fm.BAD_YAML, fm.BAD_YAML, fm.BAD_YAML, None, fm.BAD_YAML, None]
    assert got[0].k == ["2", "2024-01-01", "true"] and got[1].v == '{"a":".nan","b":[".inf","-.inf"]}' and got[5].v == '{"n":1,"when":"2024-05-06"}'
    edited = column(spark, notes, lambda c: fm.set_key(c, "new", "1"))
    assert [r.error for r in edited] == [r.e for r in got] and edited[5].content == "---\nn: 1\nnew: '1'\nwhen: 2024-05-06\n---\nrest"
    shown = column(spark, notes, fm.printed)
    assert shown[5].text == "n: 1\nwhen: 2024-05-06\n" and shown[2].error == fm.BAD_YAML


def test_long_inner_white_space(spark):
    assert column(spark, ["x" + " " * 200_000 + "y "], text.trim_ws) == ["x" + " " * 200_000 + "y"]
