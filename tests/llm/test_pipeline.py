"""The pipeline's stages on small tables, and the registered queries against their SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import packing, quality_cnn
from marginalia.llm.catalogue import LLM_QUERIES, LLM_SQL

DATA, WIDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_cnn, "STEPS", 80)
    monkeypatch.setattr(quality_cnn.Cnn.train, "__defaults__", (80, 48, 7))
    r = random.Random(3)
    prose = lambda n: " ".join(f"w{r.randint(0, 900)}" for _ in range(n))
    good = [(i, prose(60) + "\nA shared line") for i in range(60)]
    bad = [(100 + i, " ".join(f"w{r.randint(0, 900)}###" for _ in range(60))) for i in range(40)]
    item = prose(12)
    docs = good + bad + [(200, good[0][1] + "\nmore"), (201, good[0][1]), (202, "x " + item), (203, None), (204, "A shared line")]
    d = str(tmp_path)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        seen[name] = now
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {x.doc_id for x in t.select("doc_id").collect()} for n, t in seen.items()}
    assert {i for i, _ in good} <= ids["quality"] and not ids["quality"] & {i for i, _ in bad}
    assert ids["lines"] == ids["quality"] and seen["lines"].where("text like '%shared line%'").count() == 0
    assert seen["lines"].where("n_chars <> char_length(text)").count() == 0
    assert ids["lines"] - ids["near_duplicates"] == {200, 201}
    assert ids["near_duplicates"] - ids["decontaminate"] == {202}
    assert ids["packing"] == ids["decontaminate"]
    assert seen["packing"].agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.CAPACITY


def folder(spark, path, docs, labels=(), items=()):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_the_pipeline_over_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0, 0), (2, 0, 0)]])
def test_all_stay_where_nothing_is_learned(spark, tmp_path, labels):
    docs = [(1, "one text of several plain words"), (2, None), (3, "another text that differs from it in all"), (None, "x")]
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, docs, labels))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "None"]


def test_repeated_and_null_ids(spark, tmp_path):
    a, b, c = ("all of these words make text number " + x + " " + " ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    docs = [(1, a), (1, a), (1, b), (2, b), (None, a), (None, c), (None, c), (5, None), (5, None), (6, c + " more")]
    d = folder(spark, tmp_path, docs)
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("1", a), ("1", b), ("5", ""), ("5", ""), ("6", c + " more")])


def test_stages_leave_no_tables_of_their_own(spark, tmp_path):
    from marginalia.llm import common

    mark = common.written()
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, [(1, "some words to pack here")]))
    assert got.count() == 1
    assert [p.rsplit("/", 1)[1] for p in common._WRITTEN[mark:]] == ["decontaminate", "pieces"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{WIDER}/labels.parquet").select("doc_id", "quality").where("quality is not null")
    got = LLM_QUERIES["op5_quality_cnn"](spark, WIDER).where("held_out").join(labels, "doc_id")
    n, right = got.count(), got.where("predicted = quality").count()
    assert n > 50 and right >= 0.9 * n


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = LLM_QUERIES[name](spark, DATA), c.execute(LLM_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = LLM_QUERIES["op9_ppm_langid"](spark, DATA).where("held_out").join(docs, "doc_id")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 20 and right >= 0.9 * n
