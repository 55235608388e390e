"""A vault folder as a data source, with hidden files and folders.

Spark's file sources skip names that begin with ``.`` or ``_``; this source lists everything.
``spark.read.format("vault").option("path", root)`` gives :data:`marginalia.model.NOTE`; with
``content=false`` files are listed and not read. A bound on ``size`` is checked before a file
is opened. The driver lists folders only until there are ``FOLDERS`` to deal out; the rest is listed
by the tasks. Files are dealt into partitions of about ``batchBytes``, a folder that is dealt out goes whole to one
task: for large vaults :mod:`marginalia.sources.listing` spreads any layout evenly, and for folders on a
distributed file system without hidden notes, :func:`read_binary` scans in parallel. ``df.write.format("vault")`` changes
notes as a transaction, see :mod:`marginalia.sources.sink`.

A file that cannot be read (a link to nothing, no permission, gone since it was listed) is a row
without content, and of size and time 0 if it cannot even be looked at.
"""

from __future__ import annotations

import os
from collections import deque
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..model import NOTE, NOTE_INFO
from ..session import on_workers
from .sink import VaultWriter

FOLDERS = 256


class Files(InputPartition):
    """Files, and folders with all that is under them."""

    def __init__(self, paths: list[str], folders: list[str] = ()):
        super().__init__(0)
        self.paths, self.folders = paths, list(folders)


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.content = options.get("content", "true").lower() != "false"
        self.batch = int(options.get("batchbytes", options.get("batchBytes", 64 << 20)))
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        for f in filters:
            n = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("size",) and isinstance(n, int):
                if isinstance(f, (LessThan, LessThanOrEqual)):
                    top = n - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, n + isinstance(f, GreaterThan))
            yield f  # Spark checks again, which costs nothing

    def fits(self, size: int) -> bool:
        return self.low <= size and (self.high is None or size <= self.high)

    def partitions(self):
        found, size, queue = [[]], 0, deque([""])
        while queue and len(queue) < FOLDERS:
            folders, files = entries(self.root, queue.popleft())
            queue += folders
            for path, n in files:
                if size + n > self.batch and found[-1]:
                    found.append([])
                    size = 0
                found[-1].append(path)
                size += n
        return [Files(p) for p in found] + [Files([], [f]) for f in queue]

    def read(self, partition):
        under = (path for f in partition.folders for path, _ in walk(self.root, f))
        for rel in chain(partition.paths, under):
            path = os.path.join(self.root, rel)
            size, time, mode = looked_at(path)
            if self.fits(size):
                row = (rel.replace(os.sep, "/"), size, time, mode)
                yield row + (content_of(path),) if self.content else row


def looked_at(path: str) -> tuple[int, int, int]:
    """Size, modification time and mode; those of the link itself where it leads nowhere."""
    for look in (os.stat, os.lstat):
        try:
            st = look(path)
            return st.st_size if look is os.stat else 0, st.st_mtime_ns, st.st_mode & 0o7777
        except OSError:
            continue
    return 0, 0, 0


def content_of(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def entries(root: str, under: str) -> tuple[list[str], list[tuple[str, int]]]:
    """The folders in a folder, and its files with their sizes; links to folders are neither."""
    with os.scandir(os.path.join(root, under)) as it:
        own = sorted(it, key=lambda e: e.name)
    rel = lambda e: os.path.join(under, e.name)
    folders = [rel(e) for e in own if e.is_dir(follow_symlinks=False)]
    return folders, [(rel(e), looked_at(e.path)[0]) for e in own if not e.is_dir(follow_symlinks=False) and not os.path.isdir(e.path)]


def walk(root: str, under: str = ""):
    """Relative paths and sizes of all files under a folder."""
    folders, files = entries(root, under)
    yield from files
    for f in folders:
        yield from walk(root, f)


class VaultSource(DataSource):
    @classmethod
    def name(cls):
        return "vault"

    def schema(self):
        return NOTE_INFO if str(self.options.get("content", "true")).lower() == "false" else NOTE

    def reader(self, schema):
        return VaultReader(dict(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a vault is changed note by note: use mode append")
        return VaultWriter(dict(self.options)).begin()


def register(spark: SparkSession) -> None:
    on_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)


def read_vault(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("vault").option("path", root).option("content", str(content).lower()).load()


def read_binary(spark: SparkSession, root: str) -> DataFrame:
    """Notes without hidden ones, by Spark's own parallel scan of any file system; pushes down
    filters on size. Modification times have microseconds."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    full = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    rel = F.replace(full, F.regexp_replace(F.lit(base), r"^[a-z]+:/+", "/"), F.lit(""))
    return files.select(rel.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit(0o644).alias("mode"), "content")
