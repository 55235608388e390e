"""Folders of any layout, transactions that end half-way, bytes that are no text, files that cannot be read."""

import json
import os
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.actions import NoteError, Vault
from marginalia.cli import main
from marginalia.functions import frontmatter as fm
from marginalia.functions.paths import PathError
from marginalia.session import BATCH_BYTES, BATCH_ROWS, on_workers
from marginalia.operators import links, moves as many
from marginalia.model import text_notes
from marginalia.sources import listing, sink, vault as source

CHANGE = "path string, content binary, mode int, moved_from string"


def tree(root):
    out = {}
    for at, _, names in os.walk(root):
        for n in names:
            p = os.path.join(at, n)
            out[os.path.relpath(p, root)] = os.readlink(p) if os.path.islink(p) else open(p, "rb").read()
    return out


def make(folder, files):
    for rel, data in files.items():
        p = folder / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(folder)


# listing ------------------------------------------------------------------------------------


def sizes(df):
    return sorted(r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


@pytest.mark.parametrize("layout", ["one large folder", "many folders", "deep"])
def test_any_layout_is_spread_evenly(spark, tmp_path, layout):
    if layout == "one large folder":
        files = {f"big/n{i:05}.md": b"x" * 100 for i in range(3000)}
        for i in range(300):
            (tmp_path / "v" / f"empty{i}").mkdir(parents=True)
    elif layout == "many folders":
        files = {f"d{i}/n{j}.md": b"x" * 100 for i in range(300) for j in range(10)}
    else:
        files = {"/".join(["d"] * (i % 60 + 1)) + f"/n{i}.md": b"x" * 100 for i in range(1200)}
    root = make(tmp_path / "v", files)
    got = listing.list_vault(spark, root, bound=200)
    assert sorted(r.path for r in got.collect()) == sorted(files)
    own = listing.with_content(got, root, batch=400_000)
    n = sizes(own)
    assert sum(n) == len(files) and len(n) > 8 and n[-1] <= 2 * sum(n) / len(n)
    assert {r.path: bytes(r.content) for r in own.collect()} == files


def test_rounds_hand_back_what_they_did_not_reach(tmp_path):
    root = make(tmp_path / "v", {f"d/{i}.md": b"" for i in range(50)} | {f"e{i}/x.md": b"" for i in range(20)})
    todo, found, rounds = [("folder", "")], [], 0
    while todo:
        rows = list(listing.steps(root, todo, 10))
        found += [r[1] for r in rows if r[0] == "file"]
        todo, rounds = [r[:2] for r in rows if r[0] in ("folder", "name")], rounds + 1
    assert sorted(found) == sorted([f"d/{i}.md" for i in range(50)] + [f"e{i}/x.md" for i in range(20)]) and rounds > 3


def test_bins_hold_equal_bytes_and_large_files_stay_closed(spark, tmp_path):
    root = make(tmp_path / "v", {f"{i:03}.md": b"y" * (i % 7 * 30_000) for i in range(200)} | {"z.md": b"z" * 3_000_000})
    files = listing.list_vault(spark, root)
    own = listing.with_content(files, root, largest=1_000_000, batch=2_000_000)
    rows = own.select("path", "size", F.length("content").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert {r.path: r.n for r in rows if r.path == "z.md"} == {"z.md": None} and all(r.n == r.size for r in rows if r.path != "z.md")
    per = {}
    for r in rows:
        per[r.p] = per.get(r.p, 0) + (r.n or 0)
    assert len(per) > 5 and max(per.values()) <= 2_200_000


def test_what_the_listing_sees(spark, tmp_path, monkeypatch):
    root = make(tmp_path / "v", {"a.md": b"A", ".h/b.md": b"B", "x.txt": b""})
    os.symlink("nowhere", f"{root}/gone.md")
    os.symlink(root, f"{root}/loop")
    rows = {r.path: r for r in listing.vault_notes(spark, root).collect()}
    assert sorted(rows) == [".h/b.md", "a.md", "gone.md", "x.txt"] and rows["gone.md"].content is None and rows["gone.md"].size == 0
    assert "content" not in listing.vault_notes(spark, root, content=False).columns
    assert listing.vault_notes(spark, make(tmp_path / "e", {"d/x": b""}) + "/d/..").count() == 1
    with pytest.raises(listing.VaultAccessError, match="cannot access"):
        listing.list_vault(spark, str(tmp_path / "nothing"))
    real = os.scandir

    def scandir(path):
        if path.endswith(".h"):
            raise PermissionError(path)
        return real(path)

    monkeypatch.setattr(listing.os, "scandir", scandir)
    assert ("closed", ".h") in [r[:2] for r in listing.steps(root, [("folder", "")], 100)]


def test_a_plain_session_can_read_a_vault(spark, tmp_path):
    root = make(tmp_path / "v", {"a.md": b"A"})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert [bytes(r.content) for r in source.read_vault(spark, root).where("size < 5").collect()] == [b"A"]


# transactions ---------------------------------------------------------------------------------


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    old = {f"{i}.md": b"old" for i in range(40)}
    root = make(tmp_path / "v", old)
    df = spark.range(40, numPartitions=4).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        sink.write_back(df, root)
    assert tree(root) == old
    bad = spark.createDataFrame([("a.md", b"x"), ("../out.md", b"x")], "path string, content binary")
    with pytest.raises(Exception, match="leads out"):
        sink.write_back(bad, root)
    assert tree(root) == old and not (tmp_path / "out.md").exists()
    assert sink.write_back(df.where("id < 35"), root) == 35
    assert tree(root) == old | {f"{i}.md": b"new" for i in range(35)}


def staged(spark, root, rows):
    """A transaction that was committed and not finished."""
    source.register(spark)
    df = spark.createDataFrame(rows, CHANGE).repartition(3)
    df.write.format("vault").mode("append").option("transaction", "t").option("finish", "false").save(root)


def test_a_crash_after_the_commit_is_finished(spark, tmp_path):
    root = make(tmp_path / "v", {"a.md": b"a", "b.md": b"b", "c.md": b"c", "d.md": b"d"})
    os.chmod(f"{root}/c.md", 0o600)
    rows = [("b.md", None, None, "a.md"), ("a.md", None, None, "b.md"), ("new/c.md", bytearray(b"C"), None, "c.md"), ("e.md", bytearray(b"e"), 0o640, None), ("d.md", None, None, "d.md")]
    staged(spark, root, rows)
    assert {k: v for k, v in tree(root).items() if k.endswith(".md")} == {"a.md": b"a", "b.md": b"b", "c.md": b"c", "d.md": b"d"}
    folder = f"{root}/{sink.FOLDER}t"
    parts = json.load(open(f"{folder}/{sink.COMMITTED}"))["parts"]
    sink.put_part(folder, parts[0])  # half of it was done
    sink.put_part(folder, parts[0])
    assert sink.recover(root, spark) == {"t": 5}
    assert tree(root) == {"a.md": b"b", "b.md": b"a", "new/c.md": b"C", "e.md": b"e", "d.md": b"d"}
    assert os.stat(f"{root}/new/c.md").st_mode & 0o777 == 0o600 and os.stat(f"{root}/e.md").st_mode & 0o777 == 0o640
    assert sink.recover(root) == {}


def test_a_crash_before_the_commit_is_taken_back(spark, tmp_path):
    root = make(tmp_path / "v", {"a.md": b"a"})
    before = tree(root)
    w = sink.VaultWriter({"path": root, "transaction": "u"}).begin()
    rows = spark.createDataFrame([("a.md", bytearray(b"x"), None, None), ("s/b.md", bytearray(b"y"), None, None)], CHANGE).collect()
    w.write(iter(rows))
    assert len(tree(root)) == 4  # both staged, and the log
    assert sink.recover(root) == {"u": 0} and tree(root) == before
    # a task that was tried twice: only the attempt that the commit names counts
    w = sink.VaultWriter({"path": root, "transaction": "v"}).begin()
    w.write(iter(rows[:1]))
    second = w.write(iter(spark.createDataFrame([("a.md", bytearray(b"z"), None, None)], CHANGE).collect()))
    w.commit([second, None])
    assert tree(root) == {"a.md": b"z"}


def test_moves_of_links_and_of_nothing(spark, tmp_path):
    root = make(tmp_path / "v", {"a.md": b"a"})
    os.symlink("a.md", f"{root}/l.md")
    assert sink.write_back(spark.createDataFrame([("m.md", None, None, "l.md")], CHANGE), root) == 1
    assert tree(root) == {"a.md": b"a", "m.md": "a.md"}
    assert sink.write_back(spark.createDataFrame([], CHANGE), root) == 0 and len(tree(root)) == 2
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("a.md", b"x")], "path string, content binary").write.format("vault").mode("overwrite").save(root)


# bytes and errors -------------------------------------------------------------------------------


@pytest.fixture
def engine(spark, tmp_path):
    files = {"a.md": b"see [[b]] caf\xe9", "s/b.md": b"---\ntitle: B\n---\nbody \xff\x00\xe9 [[a]]\n", "c.md": b"[x](s/b.md) [[a|1]]", "n.md": b"no header \xe9"}
    root = make(tmp_path / "vault", files)
    (tmp_path / "reg.json").write_text(json.dumps({"vaults": {"1": {"path": root}}}))
    v = Vault(spark, "vault", preferences=str(tmp_path / "pref.json"), registry_file=str(tmp_path / "reg.json"), open_uri=lambda u: None, edit=lambda p: None, delay=0)
    v.root = root
    return v


def test_headers_change_and_other_bytes_do_not(engine):
    read = lambda p: open(f"{engine.root}/{p}", "rb").read()
    os.chmod(f"{engine.root}/s/b.md", 0o600)
    engine.frontmatter("b", edit=True, key="k", value="v")
    assert read("s/b.md") == b"---\nk: v\ntitle: B\n---\nbody \xff\x00\xe9 [[a]]\n" and os.stat(f"{engine.root}/s/b.md").st_mode & 0o777 == 0o600
    engine.frontmatter("b", delete=True, key="k")
    engine.frontmatter("b", delete=True, key="title")
    assert read("s/b.md") == b"body \xff\x00\xe9 [[a]]\n"
    engine.frontmatter("n", edit=True, key="k", value="\xe9")
    assert read("n.md") == "---\nk: \xe9\n---\n".encode() + b"no header \xe9"
    assert engine.frontmatter("n", show=True) == "k: \xe9\n"


def test_headers_in_bytes(spark):
    notes = [b"---\n---\n\nB\xff", b"---\na: 1\n---", b"---\na: \xe9\n---\nB", b"--- \r\na: 1\n--- \nB\x00", b"---\na: 1\nno end", b"\xe9\n---\n", b"", None, b"---\xe9\na: 1\n---\n", b"\xe2\x80\x83---\na: 1\n---\n\n\nB"]
    df = spark.createDataFrame([(n and bytearray(n),) for n in notes], "c binary")
    c = F.col("c")
    got = [x and (x.content and bytes(x.content), x.error) for (x,) in df.select(fm.set_key_bytes(c, "k", "true")).collect()]
    new = b"---\nk: true\n---\n"
    want = [(new + b"\nB\xff", None), (b"---\na: 1\nk: true\n---\n", None), (None, fm.BAD_YAML), (b"---\na: 1\nk: true\n---\nB\x00", None), (new + notes[4], None), (new + notes[5], None)]
    assert got[:6] == want and got[8:] == [(new + notes[8], None), (b"---\na: 1\nk: true\n---\n\n\nB", None)]
    got = [x and (x.content and bytes(x.content), x.error) for (x,) in df.select(fm.delete_key_bytes(c, "a")).collect()]
    assert got[0] == (None, fm.NO_HEADER) and got[1] == (None, None) or got[1] == (b"", None)
    assert got[2] == (None, fm.BAD_YAML) and got[3] == (b"B\x00", None) and got[5] == (None, fm.NO_HEADER) and got[9] == (b"\nB", None)
    assert [r.p.error for r in df.select(fm.parse(c).alias("p")).collect()][2] == fm.BAD_YAML


def test_a_note_that_cannot_be_read_is_an_error_and_nothing_changes(engine):
    os.symlink("nowhere", f"{engine.root}/lost.md")
    before = tree(engine.root)
    for act in (lambda: engine.print("lost"), lambda: engine.print("lost", mentions=True), lambda: engine.frontmatter("lost", edit=True, key="k", value="v"), lambda: engine.set_contents("lost", "x"), lambda: engine.move("s/b", "s/z")):
        with pytest.raises(NoteError, match="cannot read note"):
            act()
    with pytest.raises(NoteError, match="cannot read note"):
        engine.move_all(engine.spark.createDataFrame([("s/b", "s/z")], "old string, new string"))
    assert tree(engine.root) == before
    assert "lost.md" in [r.path for r in engine.files().collect()] and "Linked Mentions" in engine.print("b", mentions=True)
    os.remove(f"{engine.root}/lost.md")
    assert engine.move("s/b", "z") == 2
    assert tree(engine.root) == {"a.md": b"see [[z]] caf\xe9", "z.md": before["s/b.md"], "c.md": b"[x](z.md) [[a|1]]", "n.md": before["n.md"]}
    for old, new in (("none", "x"), ("a", "no/such/folder")):
        with pytest.raises(NoteError, match="cannot find"):
            engine.move(old, new)
    with pytest.raises(PathError):
        engine.move("a", "../x")


def test_a_moved_note_that_links_to_itself_and_one_that_is_replaced(engine):
    open(f"{engine.root}/a.md", "wb").write(b"[[a]] [[n]]")
    assert engine.move("a", "n") == 3 and engine.recover() == {}
    assert tree(engine.root) == {"n.md": b"[[n]] [[n]]", "s/b.md": b"---\ntitle: B\n---\nbody \xff\x00\xe9 [[n]]\n", "c.md": b"[x](s/b.md) [[n|1]]"}


def test_many_moves_of_files(engine):
    moves = lambda *rows: engine.spark.createDataFrame(rows, "old string, new string")
    with pytest.raises(NoteError, match="2 notes would be"):
        engine.move_all(moves(("a", "c")))
    with pytest.raises(PathError):
        engine.move_all(moves(("a", "../c")))
    assert engine.move_all(moves(("a", "s/b"), ("s/b", "c"), ("c", "new/a"))) == 3
    assert tree(engine.root) == {"s/b.md": b"see [[c]] caf\xe9", "c.md": b"---\ntitle: B\n---\nbody \xff\x00\xe9 [[b]]\n", "new/a.md": b"[x](c.md) [[b|1]]", "n.md": b"no header \xe9"}


def test_the_command_line_names_a_folder_that_is_gone(engine, capsys):
    shutil.rmtree(engine.root)
    assert main(["print", "a"], engine) == 1 and "cannot access the vault folder" in capsys.readouterr().err


# size -------------------------------------------------------------------------------------------


def test_python_holds_few_notes_at_once(spark):
    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    on_workers(spark)
    for n, size in ((20_000, 10), (60, 1 << 20)):
        df = spark.range(n).coalesce(1).select("id", F.repeat(F.lit("x"), size).cast("binary").alias("content"))
        got = df.mapInArrow(held, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == n and max(r.rows for r in got) <= BATCH_ROWS and max(r.bytes for r in got) <= BATCH_BYTES + (2 << 20)


def test_replaced_files_are_kept_and_not_freed(spark, tmp_path):
    root, old = make(tmp_path / "v", {"a.md": b"a", "b.md": b"b", "c.md": b"c", "d.md": b"d"}), str(tmp_path / "old")
    inodes = {os.lstat(f"{root}/{n}").st_ino for n in ("a.md", "c.md")}
    rows = [("a.md", bytearray(b"A"), None, None), ("new/c.md", bytearray(b"C"), None, "c.md"), ("e.md", bytearray(b"E"), None, None), ("f.md", None, None, "d.md")]
    assert sink.write_back(spark.createDataFrame(rows, CHANGE), root, old) == 4
    assert tree(root) == {"a.md": b"A", "b.md": b"b", "new/c.md": b"C", "e.md": b"E", "f.md": b"d"}
    assert sorted(tree(old).values()) == [b"a", b"c", b"d"] and inodes <= {os.lstat(f"{old}/{n}").st_ino for n in os.listdir(old)}
    # a crash after the commit: what is kept is kept once, however often a part is put
    w = sink.VaultWriter({"path": root, "transaction": "k", "finish": "false", "keep": str(tmp_path / "older")}).begin()
    m = w.write(iter(spark.createDataFrame([("a.md", bytearray(b"AA"), None, None), ("g.md", bytearray(b"G"), None, "b.md")], CHANGE).collect()))
    w.commit([m])
    sink.put_part(w.folder, m.part)
    assert sink.recover(root) == {"k": 2} and tree(root) == {"a.md": b"AA", "g.md": b"G", "new/c.md": b"C", "e.md": b"E", "f.md": b"d"}
    assert sorted(tree(tmp_path / "older").values()) == [b"A", b"b"]


def test_plain_headers_are_read_and_written_by_libyaml_alike():
    yaml = pytest.importorskip("yaml")
    if not yaml.__with_libyaml__:
        pytest.skip("no libyaml")
    assert fm._quick("SafeLoader", True) is yaml.CSafeLoader and fm._quick("SafeDumper", False) is yaml.SafeDumper
    values = "true yes No null 1 0x1F 1_000 1e3 1.5 2020-01-01 2020-13-45 12 a y on doc_1 a-b a/b.c 0b1 017 _ nan 1-2 9e9 1.0.0".split() + ["a" * 40, "[1, 2]", "'q'", "a # c", "a: b", "x" * 100, "\xe9", "\U0001f600", "- a", "a b " * 40]
    for key in ("title", "y", "null", "a", "x" * 30, "x" * 200, "1", "a b"):
        for value in values:
            text = f"lang: en\n{key}: {value}\n"
            try:
                want = yaml.safe_load(text)
            except (yaml.YAMLError, ValueError):
                want = fm.BAD_YAML
            try:
                got = fm.load(text)
            except ValueError as e:
                got = str(e)
            assert repr(got) == repr(want), text
            for v in (value, None, True, 7, [value], want.get(key) if isinstance(want, dict) else 1):
                d = {key: v, "lang": "en"}
                assert fm.dump(d) == yaml.safe_dump(d, sort_keys=True, allow_unicode=True, default_flow_style=False)


@pytest.mark.parametrize("most", [10, 0])
def test_moves_are_made_where_files_are_read(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(many, "MOST", most)
    root = make(tmp_path / "v", {f"d{i % 3}/n{i}.md": f"[[n{(i + 1) % 600}]] \xe9 [x](d0/n0.md)".encode("latin-1") for i in range(600)} | {"d0/.h.md": b"[[n0]]", "p.md": b"plain", "e.md": b""})
    moves = spark.createDataFrame([("d0/n0", "d1/n1"), ("d1/n1", "d0/n0"), ("p", "q/p")], "old string, new string")
    files = listing.list_vault(spark, root)
    want = {r.path: bytes(r.content) for r in many.moved_all(listing.with_content(files, root), moves).collect()}
    got = many.changes(files, moves, lambda f: listing.with_content(f, root, batch=1 << 20))
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 603 and len({r.task for r in rows}) > 4 and {r.moved_from for r in rows if r.content is None} == {"d0/.h.md", "p.md", "e.md"}
    assert sink.write_back(got, root, str(tmp_path / "old")) == 603 and tree(root) == want


def test_names_for_backlinks_come_from_the_listing(spark, tmp_path):
    root = make(tmp_path / "v", {f"n{i}.md": f"[[n{(i + 1) % 40}]] [[o]]".encode() for i in range(40)} | {"o.md": b""})
    files, reads = listing.list_vault(spark, root), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    notes = listing.with_content(files, root)
    found = links.all_backlinks(text_notes(notes.mapInArrow(counted, notes.schema)), files)
    assert len(found.collect()) == 80 and reads.value == 41


def test_large_files_pass_the_writer_one_by_one(spark, tmp_path):
    root = str(tmp_path / "v")
    os.makedirs(root)
    big = spark.range(40).coalesce(1).select(F.format_string("d/%d.md", "id").alias("path"), F.repeat(F.lit("x"), 5 << 20).alias("content"))

    def peak(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    on_workers(spark)
    assert max(r.n for r in big.select(F.col("content").cast("binary")).mapInArrow(peak, "n long").collect()) == 1
    assert sink.write_back(big, root) == 40 and {len(c) for c in tree(root).values()} == {5 << 20}


def test_a_large_file_is_read_when_nothing_else_is_held(spark, tmp_path, monkeypatch):
    big = 6 << 20
    root = make(tmp_path / "v", {f"a{i:02}.md": b"x" * (big if i % 4 == 3 else 1 << 20) for i in range(16)} | {"b.md": b"", "c.md": b"y" * (big + 1)})
    files, made = listing.list_vault(spark, root), []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema: made.append((f, schema)) or self)
    bins = listing.with_content(files, root, big)
    [(run, schema)] = made
    info = bins.coalesce(1).orderBy("path").toArrow().combine_chunks().to_batches()
    before, at_read, got = pa.total_allocated_bytes(), [], {}

    def read(path):
        at_read.append(pa.total_allocated_bytes() - before)
        return source.content_of(path)

    monkeypatch.setattr(listing, "content_of", read)
    out = run(iter(info))
    while (b := next(out, None)) is not None:
        assert b.schema.names == schema.names and (b.num_rows == 1 or sum(len(c.as_py() or b"") for c in b.column("content")) <= BATCH_BYTES)
        got |= dict(zip(b.column("path").to_pylist(), b.column("content").to_pylist()))
        del b
    assert got == {k: None if k == "c.md" else v for k, v in tree(root).items()} and len(at_read) == 17 and max(at_read) < 1 << 20
