"""Changes to a set of notes, as plans: what a note table is after them, and what to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_rewritable, with_md
from .links import base_name, replace_all, replacements, rewritten

#: A path with a number before its suffix, as :func:`upserted` makes them.
NUMBERED = r"(?s)^(.*) ([1-9][0-9]{0,8})\.md\z"


def with_content(notes: DataFrame, path: str, content: str) -> DataFrame:
    """Overwrite one note; never creates."""
    return notes.withColumn("content", F.when(F.col("path") == path, F.lit(content)).otherwise(F.col("content")))


def deleted(notes: DataFrame, name: str) -> DataFrame:
    """Without one note; links to it stay as they are."""
    return notes.where(F.col("path") != with_md(name))


def moved(notes: DataFrame, old: str, new: str) -> DataFrame:
    """After a move: the path changes, and the links to it in all notes."""
    path = F.when(F.col("path") == with_md(old), F.lit(with_md(new))).otherwise(F.col("path"))
    after = notes.withColumn("path", path)
    own = is_rewritable(F.col("path")) & F.contains("content", F.lit(base_name(old)))
    content = F.when(own, replace_all(F.col("content"), replacements(old, new))).otherwise(F.col("content"))
    return after.withColumn("content", content)


def move_plan(notes: DataFrame, old: str, new: str) -> DataFrame:
    """What a move does: (action, path, new_path), one rename and a rewrite per changed note."""
    a, b = with_md(old), with_md(new)
    rename = notes.where(F.col("path") == a).select(F.lit("rename").alias("action"), "path", F.lit(b).alias("new_path"))
    after = notes.withColumn("path", F.when(F.col("path") == a, F.lit(b)).otherwise(F.col("path")))
    rewrite = rewritten(after, old, new).select(F.lit("rewrite").alias("action"), "path", F.lit(None).cast("string").alias("new_path"))
    return rename.unionByName(rewrite)


def upserted(notes: DataFrame, changes: DataFrame, append: bool = False, overwrite: bool = False) -> DataFrame:
    """``notes`` (path, content) after ``changes`` (path, content): new paths are added; for an
    existing one the content is appended or replaced, or else the change gets a path of its own, the
    first of "x 1.md", "x 2.md" ... that neither a note nor a change has.

    Of several changes of one path, in the order of their contents (nulls first): all are appended, or
    the last one replaces, or the first one takes the path if it is free and each other one gets its own.
    """
    n = notes.select("path", "content", F.lit(True).alias("__old"))
    if append or overwrite:
        new = F.array_join(F.array_sort(F.collect_list("content")), "") if append else F.max("content")
        c = changes.groupBy("path").agg(new.alias("__new"))
        both = F.concat("content", "__new") if append else F.col("__new")
        content = F.when(F.col("__old") & F.col("__new").isNotNull(), both).otherwise(F.coalesce("__new", "content"))
        return n.join(c, "path", "full_outer").select("path", content.alias("content"))
    known = n.select("path").distinct().withColumn("__taken", F.lit(1))
    at = Window.partitionBy("path").orderBy("content")
    c = changes.select("path", "content").join(known, "path", "left").withColumn("__j", F.row_number().over(at) - 1 + F.coalesce("__taken", F.lit(0)))
    stem, number = F.regexp_extract("path", NUMBERED, 1), F.regexp_extract("path", NUMBERED, 2)
    numbered = notes.select("path").unionByName(changes.select("path")).where(F.col("path").rlike(NUMBERED))
    used = numbered.select(F.concat(stem, F.lit(".md")).alias("path"), number.cast("int").alias("k")).groupBy("path").agg(F.collect_set("k").alias("__used"))
    moved_ = c.where("__j > 0").join(used, "path", "left").withColumn("__used", F.coalesce("__used", F.array().cast("array<int>")))
    free = F.get(F.array_except(F.sequence(F.lit(1), F.size("__used") + F.col("__j")), F.col("__used")), F.col("__j") - 1)
    moved_ = moved_.select(F.concat(F.regexp_replace("path", r"\.md\z", ""), F.lit(" "), free.cast("string"), F.lit(".md")).alias("path"), "content")
    return notes.select("path", "content").unionByName(c.where("__j = 0").select("path", "content")).unionByName(moved_)
