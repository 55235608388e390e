"""A corpus pipeline of five stages, from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``documents``; what a stage decides takes effect:

1. quality: texts that the classifier rejects go; with nothing to learn from (no labels, or labels of
   one class only) all stay;
2. lines: lines that many documents share go; ``n_chars`` follows; a document that loses all
   its lines stays, with an empty text;
3. near_duplicates: of each group of linked texts one row stays, that with the smallest id (nulls
   last); a row that repeats both id and text of another goes, texts without words all stay;
4. decontaminate: documents that hold a window of a benchmark item go;
5. packing: tokens of whole documents are packed into sequences.

Defined results: a null text is an empty one for every stage (lines writes it as an empty text); rows
with a null id are rows like any other; rows that share an id but not the text are judged apart; an
empty table of documents gives an empty one, and an empty benchmark removes nothing. Tables that
a stage wrote for itself are deleted as soon as its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, line_dedup, packing, parity_join, quality_cnn
from marginalia.llm.common import discard_since, few, materialize, prepare, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    columns = docs.columns
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels").where(~quality_cnn.held_out()))
    if model.constant is not None:
        return docs
    return quality_cnn.score_quality(docs, model).where("predicted = 1").select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    kept = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("doc_id").isNull()))
    found = parity_join.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text")).where("n_shingles > 0")
    group = found.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("group"))
    group = materialize(group.join(keyed.select("__key", "doc_id").distinct(), "__key").distinct(), "groups")
    first = materialize(group.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"].alias("__key")), "first")
    gone = materialize(group.join(first, ["group", "__key"], "left_anti").select("__key"), "gone")
    kept = keyed.join(gone, "__key", "left_anti")
    again = materialize(found.groupBy(F.col("doc_id").alias("__key")).count().where("count > 1").select("__key"), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(few(again), "__key", "left_semi").dropDuplicates(["__key"])
    return kept.join(few(again), "__key", "left_anti").unionByName(one).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", clean),
    ("packing", packed),
]

#: A learned classifier cannot be put in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard_since(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
