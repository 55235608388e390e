"""From a note's name to its file, and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import add_md, basename, is_note, walk_key, with_md
from .ranks import placed


def list_notes(notes: DataFrame) -> DataFrame:
    """All paths of notes in walk order."""
    return notes.where(is_note(F.col("path"))).select("path").orderBy(walk_key(F.col("path")))


def resolve(notes: DataFrame, name: str) -> DataFrame:
    """The one path (or none) that a name stands for.

    Candidates have the name as their path or base name. One is out of reach if another
    candidate comes before it in walk order in a folder strictly above its own; of the rest the
    last in walk order counts. Candidates are as many as notes share one name.
    """
    file = with_md(name)
    c = notes.where((F.col("path") == file) | (basename(F.col("path")) == file)).select("path", walk_key(F.col("path")).alias("k"))
    c = c.withColumn("dir", F.slice("k", F.lit(1), F.size("k") - 1))
    first = c.groupBy("dir").agg(F.min("k").alias("mk"))
    above = c.where(F.size("dir") > 0).select("path", "k", F.explode(F.transform(F.sequence(F.lit(0), F.size("dir") - 1), lambda n: F.slice("dir", F.lit(1), n))).alias("dir"))
    hidden = above.join(first, "dir").where(F.col("mk") < F.col("k")).select("path").distinct()
    left = c.join(hidden, "path", "left_anti")
    return left.agg(F.max_by("path", "k").alias("path")).where(F.col("path").isNotNull())


def resolve_all(notes: DataFrame, names: DataFrame) -> DataFrame:
    """Each of ``names`` (name) with the ``path`` it stands for, null if there is none: the rule of
    :func:`resolve` for a whole table of names at once.

    Names meet base names and paths in equi-joins; a candidate's folder is expanded to all folders above it, keyed
    by the name, and meets the first candidate of each. Any number of notes may share one name."""
    asked = names.select("name").where("name is not null").distinct().withColumn("__file", add_md(F.col("name")))
    own = notes.select("path", basename(F.col("path")).alias("__base"))
    c = asked.join(own.select("path", F.col("__base").alias("__file")), "__file").unionByName(asked.join(own.select("path", F.col("path").alias("__file")), "__file"))
    c = c.select("name", "path").distinct().withColumn("k", walk_key(F.col("path"))).withColumn("dir", F.slice("k", F.lit(1), F.size("k") - 1))
    first = c.groupBy("name", "dir").agg(F.min("k").alias("mk"))
    above = F.transform(F.sequence(F.lit(0), F.size("dir") - 1), lambda n: F.slice("dir", F.lit(1), n))
    hidden = c.where(F.size("dir") > 0).select("name", "path", "k", F.explode(above).alias("dir")).join(first, ["name", "dir"])
    hidden = hidden.where(F.col("mk") < F.col("k")).select("name", "path").distinct()
    left = c.join(hidden, ["name", "path"], "left_anti").groupBy("name").agg(F.max_by("path", "k").alias("path"))
    return names.select("name").distinct().join(left, "name", "left")


def ranked_notes(notes: DataFrame) -> DataFrame:
    """All paths of notes with their ``place`` in walk order, from 1, over all folders."""
    return placed(notes.where(is_note(F.col("path"))).select("path"), [walk_key(F.col("path"))])


def read_note(notes: DataFrame, name: str) -> DataFrame:
    """The resolved note's row, if there is one."""
    return notes.join(F.broadcast(resolve(notes, name)), "path", "left_semi")
