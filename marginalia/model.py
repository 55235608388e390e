"""The data model: schemas, and a notes view derived from a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A note. ``mtime_ns`` stays a long: timestamps have microseconds and would create ties.
NOTE = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("size", T.LongType(), False),
    T.StructField("mtime_ns", T.LongType(), False), T.StructField("mode", T.IntegerType(), False),
    T.StructField("content", T.BinaryType(), True),
])
#: A note without its content.
NOTE_INFO = T.StructType(NOTE.fields[:4])
#: A match; line 0 stands for a match of the file's path.
MATCH = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("line_number", T.IntegerType()), T.StructField("match_line", T.StringType())])
REGISTRY = "vaults map<string, struct<path: string>>"

SEARCH_CAP = 10 * 1024 * 1024  # contents of this size or more are not searched
BACKLINK_CAP = 10 * 1024 * 1024  # contents over this size are not searched for links


def text_notes(notes: DataFrame) -> DataFrame:
    """Notes with ``content`` as a string."""
    return notes.withColumn("content", F.col("content").cast("string"))


def notes_from_documents(docs: DataFrame, n: int) -> DataFrame:
    """A note per document, with a header and links to others; ids are 0 to n - 1."""
    stem = lambda d: F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), d.cast("string")))
    other = lambda a, b: F.pmod(F.col("doc_id") * a + b, F.lit(n)).cast("string")
    md = F.pmod(F.col("doc_id") * 11 + 5, F.lit(n))
    target = docs.select(F.col("doc_id").alias("__id"), stem(F.col("doc_id")).alias("__stem"))
    content = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: doc_"), F.col("doc_id").cast("string")), F.concat(F.lit("lang: "), "lang"), F.lit("---"), "text",
        F.concat(F.lit("See [[doc_"), other(7, 3), F.lit("]] and [[doc_"), other(13, 1), F.lit("|alias]]")), F.concat(F.lit("md [x]("), "__stem", F.lit(".md)")),
    )
    out = docs.withColumn("__md", md).join(target, F.col("__md") == F.col("__id"))
    return out.select(
        F.concat(stem(F.col("doc_id")), F.lit(".md")).alias("path"), F.octet_length(content).cast("long").alias("size"),
        F.pmod("doc_id", F.lit(97)).cast("long").alias("mtime_ns"), F.lit(0o644).alias("mode"), content.alias("content"),
    )


#: The same view for DuckDB, as common table expressions.
NOTES_SQL = """
base AS (SELECT doc_id, text, lang, source, source || '/' || lang || '/doc_' || doc_id AS stem, (SELECT count(*) FROM documents) AS n FROM documents),
notes AS (
  SELECT b.stem || '.md' AS path, b.doc_id % 97 AS mtime_ns,
    '---' || chr(10) || 'title: doc_' || b.doc_id || chr(10) || 'lang: ' || b.lang || chr(10) || '---' || chr(10) || b.text || chr(10)
    || 'See [[doc_' || ((b.doc_id * 7 + 3) % b.n) || ']] and [[doc_' || ((b.doc_id * 13 + 1) % b.n) || '|alias]]' || chr(10) || 'md [x](' || t.stem || '.md)' AS content
  FROM base b JOIN base t ON t.doc_id = (b.doc_id * 11 + 5) % b.n
)
"""
