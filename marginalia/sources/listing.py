"""A vault folder listed and read by tasks, however its files lie in folders.

Folders are listed in rounds: a task looks at up to ``bound`` entries and hands back what it did not reach, folders by
path and the rest of a large folder by name; the next round deals that out evenly. So one folder of very many
files and very many folders of few files are both spread. What is found is a written table; files get a
place in walk order and the bytes in front of them, are cut into bins of equal bytes, and each bin is read by one task.

A folder that cannot be opened ends the listing with :class:`VaultAccessError`; one that goes away
meanwhile is left out. A file that cannot be read has no content, as in :mod:`marginalia.sources.vault`.
"""

from __future__ import annotations

import os
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import walk_key
from ..model import NOTE, NOTE_INFO
from ..operators.ranks import placed
from ..scratch import written
from ..session import BATCH_BYTES, on_workers
from .vault import content_of, looked_at

#: Entries that a task looks at in a round, and bytes that a task reads; an opened file counts as some bytes more.
BOUND, BATCH, OPEN = 20_000, 64 << 20, 16 << 10
ACCESS = "cannot access the vault folder"


class VaultAccessError(RuntimeError):
    pass


_STEP = "kind string, path string, size long, mtime_ns long, mode int"
_NAMES = ["kind", "path", "size", "mtime_ns", "mode"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=_NAMES)


def steps(root: str, todo, bound: int):
    """One task's round over (kind, path): rows of files (``file``), of what is left (``folder``, ``name``), and of
    folders that cannot be opened (``closed``). It opens at least one folder, so there is an end."""
    queue, budget, opened = deque(), bound, False

    def look(rel):
        full = os.path.join(root, rel)
        return None if os.path.isdir(full) else ("file", rel.replace(os.sep, "/"), *looked_at(full))

    for kind, rel in todo:
        if kind == "folder":
            queue.append(rel)
        elif row := look(rel):  # a name of a large folder; links to folders are neither
            budget -= 1
            yield row
    while queue:
        rel = queue.popleft()
        if budget <= 0 and opened:
            yield ("folder", rel, None, None, None)
            continue
        opened = True
        try:
            with os.scandir(os.path.join(root, rel)) as entries:
                for e in entries:
                    own = os.path.join(rel, e.name)
                    budget -= 1
                    if e.is_dir(follow_symlinks=False):
                        queue.append(own)
                    elif budget < 0:
                        yield ("name", own, None, None, None)
                    elif row := look(own):
                        yield row
        except FileNotFoundError:
            if not rel:
                yield ("closed", rel, None, None, None)
        except OSError:
            yield ("closed", rel, None, None, None)


def list_vault(spark: SparkSession, root: str, bound: int = BOUND) -> DataFrame:
    """All files under ``root``, which all workers must see: :data:`marginalia.model.NOTE_INFO`, as a written table."""
    on_workers(spark)
    cores = spark.sparkContext.defaultParallelism

    def run(batches):
        todo = ((k, p) for b in batches for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows = []
        for row in steps(root, todo, bound):
            rows.append(row)
            if len(rows) == 5000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    todo, n, found = spark.createDataFrame([("folder", "")], "kind string, path string"), 1, []
    while n:
        tasks = max(1, min(n, max(4 * cores, -(-n // bound))))
        out = written(todo.repartition(tasks).mapInArrow(run, _STEP), "listed")
        closed = out.where("kind = 'closed'").select("path").first()
        if closed:
            raise VaultAccessError(f"{ACCESS}: {os.path.join(root, closed.path)}")
        found.append(out.where("kind = 'file'").drop("kind"))
        todo = out.where("kind in ('folder', 'name')").select("kind", "path")
        n = todo.count()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def with_content(files: DataFrame, root: str, largest: int | None = None, batch: int = BATCH) -> DataFrame:
    """``files`` (of :func:`list_vault`, other columns stay) with their contents, in bins of about ``batch`` bytes. A file
    of more than ``largest`` bytes is not opened and has no content."""
    spark = files.sparkSession
    cost = F.lit(OPEN) + (F.col("size") if largest is None else F.when(F.col("size") <= largest, F.col("size")).otherwise(0))
    total = files.agg(F.sum(cost)).first()[0] or 0
    batch = max(1, min(batch, max(1 << 20, total // (3 * spark.sparkContext.defaultParallelism))))
    bins = placed(files, [walk_key(F.col("path"))], cost).withColumn("__bin", F.expr(f"cast(before div {batch} as int)"))

    more = [f for f in files.schema if f.name not in NOTE.names]

    def packed(b, at, contents):
        """The rows of ``b`` from ``at`` on that have these contents. Nothing else keeps them: the next file is large too."""
        own, n = b.slice(at, len(contents)), len(NOTE_INFO)
        cols = [*own.columns[:n], pa.array(contents, pa.binary()), *own.columns[n:]]
        contents.clear()
        return pa.RecordBatch.from_arrays(cols, names=[*NOTE.names, *own.schema.names[n:]])

    def run(batches):
        for b in batches:
            contents, held, at = [], 0, 0
            for i, (path, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                opened = largest is None or size <= largest
                if contents and opened and held + size > BATCH_BYTES:
                    yield packed(b, at, contents)
                    held, at = 0, i
                contents.append(content_of(os.path.join(root, path)) if opened else None)
                held += len(contents[-1] or b"")
            if contents:
                yield packed(b, at, contents)

    own = bins.repartitionById(int(total // batch) + 1, F.col("__bin")).select(*NOTE_INFO.names, *[f.name for f in more])
    return own.mapInArrow(run, T.StructType([*NOTE.fields, *more]))


def vault_notes(spark: SparkSession, root: str, content: bool = True, largest: int | None = None) -> DataFrame:
    """A vault as a table; it is listed when this is called, and read when the table is."""
    files = list_vault(spark, root)
    return with_content(files, root, largest) if content else files
