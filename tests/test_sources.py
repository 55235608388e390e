import json
import os

import pytest

from marginalia.actions import NoteError, Vault
from marginalia.cli import main
from marginalia.functions.paths import PathError
from marginalia.model import text_notes
from marginalia.operators import links, resolve, search
from marginalia.sources import registry, vault as source
from marginalia.sources.registry import ConfigError
from marginalia.streaming.search import note_stream, stream_search


def test_vault_source(spark, vault):
    root = vault({"a.md": "A", ".h.md": "h", "_u.md": "u", ".hid/c.md": "c", "x.txt": "t", "sub/deep/n.md": "\xe9"})
    os.chmod(f"{root}/a.md", 0o600)
    rows = {r.path: r for r in source.read_vault(spark, root).collect()}
    assert sorted(rows) == [".h.md", ".hid/c.md", "_u.md", "a.md", "sub/deep/n.md", "x.txt"]
    a = rows["a.md"]
    assert (bytes(a.content), a.size, a.mode, a.mtime_ns) == (b"A", 1, 0o600, os.stat(f"{root}/a.md").st_mtime_ns)
    info = source.read_vault(spark, root, content=False)
    assert "content" not in info.columns and info.count() == 6
    assert sorted(r.path for r in source.read_vault(spark, root).where("size > 1").collect()) == ["sub/deep/n.md"]


def test_what_cannot_be_read_has_no_content(spark, vault):
    root = vault({"a.md": "needle", "b.md": "x"})
    os.symlink(f"{root}/nowhere.md", f"{root}/needle.md")
    os.symlink(root, f"{root}/loop")
    rows = {r.path: r.content for r in source.read_vault(spark, root).collect()}
    assert rows == {"a.md": b"needle", "b.md": b"x", "needle.md": None}
    notes = text_notes(source.read_vault(spark, root))
    assert [(r.file_path, r.line_number) for r in search.search_notes(notes, "needle").collect()] == [("a.md", 1), ("needle.md", 0)]
    assert [r.path for r in resolve.list_notes(notes).collect()] == ["a.md", "b.md", "needle.md"]
    assert links.backlinks(notes, "x").collect() == [] and links.rewritten(notes, "x", "y").collect() == []
    reader = source.VaultReader({"path": root})
    parts = reader.partitions()
    os.remove(f"{root}/b.md")  # gone since it was listed
    assert [r[0::4] for p in parts for r in reader.read(p)] == [("a.md", b"needle"), ("b.md", None), ("needle.md", None)]


def test_folders_are_listed_by_tasks(spark, vault, monkeypatch):
    files = {f"{a}/{b}/{c}.md": f"{a}{b}{c}" for a in "xyz" for b in "pq" for c in "mn"} | {"top.md": "t", "x/in.md": "i"}
    root = vault(files)
    monkeypatch.setattr(source, "FOLDERS", 4)
    reader = source.VaultReader({"path": root})
    parts = reader.partitions()
    assert len(parts) > 2 and sorted(r[0] for p in parts for r in reader.read(p)) == sorted(files)


def test_filters_on_size_reach_the_source():
    from pyspark.sql.datasource import GreaterThan, LessThan

    r = source.VaultReader({"path": "/"})
    assert len(list(r.pushFilters([LessThan(("size",), 10), GreaterThan(("size",), 3)]))) == 2
    assert [n for n in range(12) if r.fits(n)] == list(range(4, 10))


def test_binary_scan_sees_what_is_not_hidden(spark, vault):
    root = vault({"a.md": "A", ".h.md": "h", "sub/n.md": "N", "x.txt": ""})
    assert sorted((r.path, bytes(r.content)) for r in source.read_binary(spark, root).collect()) == [("a.md", b"A"), ("sub/n.md", b"N")]


def test_an_empty_vault(spark, vault):
    root = vault({"d/x.txt": ""})
    assert source.read_vault(spark, root).where("path like '%.md'").count() == 0


def test_preferences(tmp_path):
    file = str(tmp_path / "c" / "preferences.json")
    with pytest.raises(ConfigError, match="cannot find"):
        registry.default_name(file=file)
    registry.set_default_name("my vault", file)
    assert open(file).read() == '{"default_vault_name":"my vault"}'
    assert registry.default_name(file=file) == "my vault" and registry.default_name("other", file) == "other"
    for bad in ("{", '{"default_vault_name":""}', "{}"):
        open(file, "w").write(bad)
        with pytest.raises(ConfigError, match="could not parse"):
            registry.default_name(file=file)


def test_registry(spark, tmp_path):
    file = tmp_path / "vaults.json"
    text = json.dumps({"vaults": {"1": {"path": "/home/me/notes/vault1"}, "2": {"path": "/srv/my-vault1"}, "3": {"path": "/mnt/v3"}}})
    file.write_text(text)
    assert registry.vault_path("vault1", str(file)) == "/home/me/notes/vault1" and registry.vault_path("v3", str(file)) == "/mnt/v3"
    rows = registry.registry(spark, text)
    assert registry.find_vault(rows, "vault1").first().path == "/home/me/notes/vault1" and registry.find_vault(rows, "").count() == 0
    for name in ("none", ""):
        with pytest.raises(ConfigError, match="not found"):
            registry.vault_path(name, str(file))
    file.write_text("{")
    with pytest.raises(ConfigError, match="parse"):
        registry.vault_path("v", str(file))
    with pytest.raises(ConfigError, match="read"):
        registry.vault_path("v", str(tmp_path / "no"))


@pytest.fixture
def engine(spark, vault, tmp_path):
    root = vault({"a.md": "see [[b]] and needle", "sub/b.md": "---\ntitle: B\n---\nbody", "c.md": "[x](sub/b.md)\nneedle", ".hidden/d.md": "[[b#h]]", ".e.md": "[[b]]"})
    (tmp_path / "reg.json").write_text(json.dumps({"vaults": {"1": {"path": root}}}))
    opened = []
    v = Vault(spark, "vault", preferences=str(tmp_path / "pref.json"), registry_file=str(tmp_path / "reg.json"), open_uri=opened.append, edit=lambda p: opened.append("edit " + p), delay=0)
    v.opened, v.root = opened, root
    return v


def test_print(engine):
    assert engine.print("b") == "---\ntitle: B\n---\nbody" == engine.print("sub/b.md")
    got = engine.print("sub/b", mentions=True)
    assert "## Linked Mentions" in got and got.count("**[[") == 4
    with pytest.raises(NoteError):
        engine.print("nobody")


def test_search_and_open(engine):
    assert engine.search_content("nothing like it") is None
    assert engine.search_content("body") == "sub/b.md" and engine.opened.pop() == "notes://open?file=sub%2Fb.md&vault=vault"
    with pytest.raises(NoteError):
        engine.search_content("needle")
    engine.pick = lambda items: next(i for i, x in enumerate(items) if x.startswith("c.md:2"))
    assert engine.search_content("needle", editor=True) == "c.md" and engine.opened.pop() == f"edit {engine.root}/c.md"
    engine.pick = lambda items: items.index("a.md")
    assert engine.search() == "a.md"
    engine.open("x y")
    engine.daily()
    assert engine.opened[-2:] == ["notes://open?file=x%20y&vault=vault", "notes://daily?vault=vault"]


def test_create(engine):
    engine.create("n", r"a\nb", append=True)
    assert engine.opened.pop() == "notes://new?vault=vault&append=true&content=a%0Ab&file=n&silent=true"
    engine.create("n", show=True, editor=True)
    assert engine.opened == ["notes://new?vault=vault&file=n&silent=true", f"edit {engine.root}/n.md"]
    with pytest.raises(ValueError):
        engine.create("n", append=True, overwrite=True)


def test_move(engine):
    os.chmod(f"{engine.root}/a.md", 0o640)
    before = os.stat(f"{engine.root}/.e.md").st_mtime_ns
    assert engine.move("sub/b", "sub/new.md", show=True) == 3
    read = lambda p: open(f"{engine.root}/{p}").read()
    assert (read("a.md"), read("c.md"), read(".hidden/d.md"), read(".e.md")) == ("see [[new]] and needle", "[x](sub/new.md)\nneedle", "[[new#h]]", "[[b]]")
    assert os.stat(f"{engine.root}/a.md").st_mode & 0o777 == 0o640 and os.stat(f"{engine.root}/.e.md").st_mtime_ns == before
    assert not os.path.exists(f"{engine.root}/sub/b.md") and read("sub/new.md").endswith("body")
    assert sorted(os.listdir(engine.root)) == [".e.md", ".hidden", "a.md", "c.md", "sub"]
    for a, b, error in (("../x", "y", PathError), ("a", "/etc/y", PathError), ("gone", "y", NoteError)):
        with pytest.raises(error):
            engine.move(a, b)


def test_delete_and_overwrite(engine):
    engine.delete("c")
    assert not os.path.exists(f"{engine.root}/c.md")
    for bad, error in (("c", NoteError), ("../../x", PathError)):
        with pytest.raises(error):
            engine.delete(bad)
    engine.set_contents("b", "new")
    assert engine.print("b") == "new"
    with pytest.raises(NoteError):
        engine.set_contents("missing", "x")


def test_frontmatter(engine):
    assert engine.frontmatter("b", show=True) == "title: B\n" and engine.frontmatter("a", show=True) == ""
    assert engine.frontmatter("b", edit=True, key="tags", value="[x, y]") == "Updated frontmatter key 'tags' in b"
    assert engine.frontmatter("b", show=True) == "tags:\n- x\n- y\ntitle: B\n"
    assert "Deleted" in engine.frontmatter("b", delete=True, key="title")
    for args in ({}, {"edit": True}, {"edit": True, "key": "k"}, {"delete": True}):
        with pytest.raises(NoteError):
            engine.frontmatter("b", **args)
    with pytest.raises(NoteError, match="no header"):
        engine.frontmatter("a", delete=True, key="k")


def test_large_notes_are_named(engine, monkeypatch):
    monkeypatch.setattr(links, "BACKLINK_CAP", 19)
    said = []
    engine.warn = said.append
    engine.print("b", mentions=True)
    assert sorted(x.split(" is")[0] for x in said) == ["a.md", "c.md", "sub/b.md"]


def test_command_line(engine, capsys):
    assert main(["print", "b"], engine) == 0 and "title: B" in capsys.readouterr().out
    assert main(["sc", "nothing"], engine) == 0 and "No notes found" in capsys.readouterr().out
    assert main(["p", "missing"], engine) == 1 and "cannot find" in capsys.readouterr().err
    assert main(["sd", "vault"], engine) == 0 and main(["pd", "--path-only"], engine) == 0
    assert capsys.readouterr().out.endswith(engine.root)
    assert main(["sd", "elsewhere"], engine) == 1 and registry.default_name(file=engine.preferences) == "elsewhere"


def test_stream(spark, vault):
    root = vault({"a.md": "x needle\ny", "b/c.md": "none"})
    q = stream_search(note_stream(spark, root), "needle").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.line_number, r.line) for r in spark.table("found").collect()] == [(1, "x needle")]
