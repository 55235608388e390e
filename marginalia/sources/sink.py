"""Writing notes to a vault folder, all or nothing.

A change of many notes is a transaction: tasks stage new files beside the old ones and log each before they
stage it; the commit is the renaming of one small file; then the staged files are renamed onto their places, by tasks
again. Until the commit nothing is changed, and :func:`recover` takes the staged files away; after it nothing can be
lost, and :func:`recover` finishes what a crash left. All steps may be repeated. Single files are
written beside their place and renamed onto it.

What a transaction replaces or removes is freed file by file, which a disk mounted with ``discard`` does one after the
other, however many tasks ask for it. With a ``keep`` folder (on the same disk) the old files stay there instead,
for vaults that are deleted as a whole later on.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from ..functions.paths import validate_path
from ..session import on_workers

#: The folder of a transaction in the vault's root, and in it the name of the file that commits.
FOLDER, COMMITTED = ".marginalia-", "committed"


def put(root: str, rel: str, content: bytes, mode: int | None = None) -> None:
    path = validate_path(root, rel)
    fd, tmp = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=os.path.dirname(path))
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(content)
        os.chmod(tmp, mode if mode is not None else 0o644)
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def _stage(staged: str, content: bytes | None, mode: int | None, source: str | None) -> None:
    if content is None and source is not None:
        if os.path.islink(source):
            os.symlink(os.readlink(source), staged)
            return
        try:
            os.link(source, staged)  # a move keeps the file itself
        except OSError:
            shutil.copy2(source, staged)
        return
    with open(staged, "xb") as f:
        f.write(content or b"")
    if mode is None and source is not None:
        mode = os.stat(source).st_mode & 0o7777
    os.chmod(staged, 0o644 if mode is None else mode)


@dataclass
class Staged(WriterCommitMessage):
    part: str
    n: int


class VaultWriter(DataSourceWriter):
    """Writes rows (path, content, mode, moved_from), the last two optional. With ``moved_from`` the
    file there goes, unless another row takes its place; without content it is moved as it is."""

    def __init__(self, options: dict):
        self.root, self.txn = options["path"], options.get("transaction") or uuid.uuid4().hex
        self.finish, self.keep = options.get("finish", "true").lower() != "false", options.get("keep")
        self.folder = os.path.join(self.root, FOLDER + self.txn)

    def begin(self) -> VaultWriter:
        """Make the transaction's folder: once, by the driver, so that a task which outlives an abort finds none."""
        os.makedirs(self.folder)
        return self

    def write(self, iterator):
        part, n, made = f"{uuid.uuid4().hex}.log", 0, set()
        with open(os.path.join(self.folder, part), "w", encoding="utf-8") as log:
            for row in iterator:
                r = row.asDict()
                path, source = validate_path(self.root, r["path"]), r.get("moved_from")
                source = source and validate_path(self.root, source)
                entry = {"to": path, "staged": os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}.new")}
                if source and source != path:
                    entry |= {"from": source, "inode": os.lstat(source).st_ino}
                log.write(json.dumps(entry) + "\n")
                log.flush()
                if (at := os.path.dirname(path)) not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(at)
                content = r["content"].encode() if isinstance(r["content"], str) else r["content"]
                _stage(entry["staged"], content, r.get("mode"), source)
                if not os.path.isdir(self.folder):
                    os.unlink(entry["staged"])
                    raise RuntimeError("the transaction was taken back")
                n += 1
        os.sync()  # once for all files of the task: what a commit names is on the disk before it
        return Staged(part, n)

    def commit(self, messages):
        own = [m for m in messages if m is not None]
        tmp = os.path.join(self.folder, ".commit")
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump({"parts": [m.part for m in own], "n": sum(m.n for m in own), "keep": self.keep}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, os.path.join(self.folder, COMMITTED))
        if self.finish:
            roll_forward(self.root, self.txn)

    def abort(self, messages):
        roll_back(self.root, self.txn)


def _entries(folder: str, part: str):
    with open(os.path.join(folder, part), encoding="utf-8") as f:
        for line in f:
            if line.endswith("\n"):  # a line cut short belongs to nothing that was staged
                yield json.loads(line)


def _kept(keep: str, e: dict) -> str:
    """A second name for what an entry replaces or removes: of each entry one name for each step."""
    return os.path.join(keep, os.path.basename(e["staged"]).strip(".").removesuffix(".new"))


def put_part(folder: str, part: str) -> int:
    """Rename a part's staged files onto their places; done ones are passed over."""
    n, keep = 0, _keep(folder)
    for e in _entries(folder, part):
        if os.path.lexists(e["staged"]):
            if keep:
                try:
                    os.link(e["to"], _kept(keep, e), follow_symlinks=False)
                except (FileNotFoundError, FileExistsError):
                    pass  # nothing is there, or it was linked before
            os.replace(e["staged"], e["to"])
            if os.path.lexists(e["staged"]):  # two names of one file stay as they are
                os.unlink(e["staged"])
            n += 1
    return n


def drop_part(folder: str, part: str) -> None:
    """After all parts are put: remove what was moved away, unless its place was taken."""
    keep = _keep(folder)
    for e in _entries(folder, part):
        try:
            if "from" in e and os.lstat(e["from"]).st_ino == e["inode"]:
                if keep:
                    os.replace(e["from"], _kept(keep, e) + ".from")
                else:
                    os.unlink(e["from"])
        except FileNotFoundError:
            pass


def _committed(folder: str) -> dict | None:
    try:
        with open(os.path.join(folder, COMMITTED), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def _keep(folder: str) -> str | None:
    if keep := (_committed(folder) or {}).get("keep"):
        os.makedirs(keep, exist_ok=True)
    return keep


def _discard_uncommitted(folder: str, keep: set[str]) -> None:
    for part in os.listdir(folder):
        if part.endswith(".log") and part not in keep:
            for e in _entries(folder, part):
                if os.path.lexists(e["staged"]):
                    os.unlink(e["staged"])


def roll_forward(root: str, txn: str, each=None) -> int:
    """Finish a committed transaction; the number of files it changed. ``each`` applies a function to
    every part's name (one after the other by default)."""
    folder = os.path.join(root, FOLDER + txn)
    said = _committed(folder)
    each = each or (lambda f, parts: [f(folder, p) for p in parts])
    each(put_part, said["parts"])
    each(drop_part, said["parts"])
    _discard_uncommitted(folder, set(said["parts"]))  # of tasks that were tried twice
    shutil.rmtree(folder)
    return said["n"]


def roll_back(root: str, txn: str) -> None:
    """Take a transaction's staged files away, if it did not commit."""
    folder = os.path.join(root, FOLDER + txn)
    if os.path.isdir(folder) and _committed(folder) is None:
        _discard_uncommitted(folder, set())
        shutil.rmtree(folder)


def recover(root: str, spark: SparkSession | None = None) -> dict[str, int]:
    """Finish or take back every transaction that a crash left in ``root``, when nothing else writes there: the
    number of files that each one (by name) has changed, 0 for those taken back."""
    out = {}
    for name in sorted(os.listdir(root)):
        if name.startswith(FOLDER):
            txn = name.removeprefix(FOLDER)
            if _committed(os.path.join(root, name)) is None:
                roll_back(root, txn)
                out[txn] = 0
            else:
                out[txn] = roll_forward(root, txn, _by_tasks(spark, root, txn) if spark else None)
    return out


def _by_tasks(spark: SparkSession, root: str, txn: str):
    folder = os.path.join(root, FOLDER + txn)

    def each(f, parts):
        if not parts:
            return

        def run(batches):
            for b in batches:
                for part in b.column(0).to_pylist():
                    f(folder, part)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        spark.createDataFrame([(p,) for p in parts], "part string").repartition(len(parts)).mapInArrow(run, "n long").agg(F.sum("n")).collect()

    return each


def write_back(notes: DataFrame, root: str, keep: str | None = None) -> int:
    """Write (path, content, and if there are such columns mode, moved_from) into the folder ``root``, which all
    workers must see, as one transaction; the number of files written. What is replaced or removed
    goes to the folder ``keep``, if there is one."""
    from .vault import register

    spark = notes.sparkSession
    on_workers(spark)
    register(spark)
    txn = uuid.uuid4().hex
    cols = [F.col("path"), F.col("content").cast("binary").alias("content")]
    cols += [F.col(c).cast(t).alias(c) for c, t in (("mode", "int"), ("moved_from", "string")) if c in notes.columns]
    to = notes.select(*cols).write.format("vault").mode("append").option("transaction", txn).option("finish", "false")
    (to.option("keep", keep) if keep else to).save(root)
    return roll_forward(root, txn, _by_tasks(spark, root, txn))
