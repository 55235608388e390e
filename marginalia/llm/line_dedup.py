"""Line dedup: explode normalised lines, count documents per hash, drop, reassemble by position.

Native: DataFrame functions only. A document is told apart by ``doc_id``; rows that repeat
one id count once for a line. Defined results: null or empty text is one empty line, which
has an empty key and always stays; a null ``doc_id`` is an id like any other; an empty table
gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: White space stripped from both ends of a line.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, MIN_CHARS = 10, 1


def lower_ascii(c: Column) -> Column:
    """A-Z only. ``lower`` has a fast way for pure ASCII and is exact there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that may be dropped: document, position, 128 bits of the key's hash."""
    # the A-Z folding never touches \n, so it is done once per text
    keys = F.split(lower_ascii(F.col("__text")), "\n", -1)
    return (
        docs.select("__doc", "__tag", F.posexplode(keys).alias("__pos", "__line"))
        .withColumn("__key", F.btrim("__line", F.lit(SPACE)))
        .where(F.char_length("__key") >= min_chars)
        .select("__doc", "__tag", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("line"), F.col("__key")).alias("__h2"))
    )


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines cut from ``text``; adds n_lines, n_dropped.

    Lines travel as hashes; whole texts are shuffled once, by document. Counting shuffles by
    (key, document) first, so one very common line is spread over all tasks, and the joins are
    plain equi-joins that adaptive execution may split.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    docs = docs.withColumn("__doc", F.struct("doc_id")).withColumn("__text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("__tag", F.xxhash64("__text"))
    lines = materialize(keyed_lines(docs, max(1, min_chars)), "lines")
    common = lines.groupBy("__h1", "__h2").agg(F.count_distinct("__doc").alias("__n")).where(F.col("__n") >= min_docs)
    common = materialize(common.select("__h1", "__h2"), "common")  # a join of written tables can be split or broadcast
    gone = (
        lines.join(common, ["__h1", "__h2"], "left_semi")
        .groupBy("__doc", "__tag")
        .agg(F.collect_set("__pos").alias("__gone"))  # at most the lines of one document
    )
    split = F.split("__text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    return (
        docs.join(gone, ["__doc", "__tag"], "left")
        .withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
        .withColumn("__lines", split)
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("__lines", p)), "\n")))
        .select(*kept, "text", "n_lines", "n_dropped")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP8_SQL = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, {_SPACE_SQL}), '{UPPER}', '{LOWER}') AS key FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id
"""
