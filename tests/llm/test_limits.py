"""Cases at which earlier versions failed: vectors of very unequal lengths, models that follow one another in a
worker, xz streams with large dictionaries, runs side by side."""

import base64
import lzma
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import common, decontaminate, forest, parity_join, ppm_langid, quality_cnn, secrets

from test_contracts import prose, recall_of, same, unit


@pytest.mark.parametrize("kind", ["one of 1000 times the length", "log-normal", "near copies"])
def test_recall_of_very_unequal_lengths(spark, monkeypatch, kind):
    r = np.random.default_rng(5)
    x = unit(3000, 64, seed=3)
    if kind == "log-normal":
        x *= r.lognormal(0, 1.5, size=(3000, 1)).astype(np.float32)
    elif kind == "near copies":
        x = np.repeat(x[:30], 100, axis=0) + r.normal(size=(3000, 64)).astype(np.float32) * 0.01
    else:
        x[1234] *= 1000
    recall, scored = recall_of(spark, monkeypatch, x, 20)
    print(f"{kind}: recall {recall:.3f}, scored {scored:.3f}")
    assert recall >= 0.9 and scored <= 0.6


def test_lengths_at_the_edges(spark):
    data = [(i, [float(x)] * 3) for i, x in enumerate([1e-300, 1e-30, 1.0, 1e30, 1e200, -1.0, 2.0])] + [(20, [1.0, 0.0, 0.0]), (7, [5.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in forest.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert [v for q, v in got if q == 20] == [4, 3, 6, 2, 1, 0, 5] and len(got) == 14


def test_models_that_follow_one_another(spark):
    words = {"a": "the house and the garden of the old man ", "b": "le chat et la maison du vieux monsieur "}
    docs = spark.createDataFrame([(i, words["ab"[i % 2]] * 3) for i in range(8)], "doc_id long, text string").coalesce(1)
    for k in range(12):
        names = {"a": "xy"[k % 2], "b": "yx"[k % 2]}
        learn = spark.createDataFrame([(i, words[w] * 5, names[w]) for i in range(6) for w in "ab"], "doc_id long, text string, lang string")
        got = {r.doc_id: r.lang_pred for r in ppm_langid.identify(docs, learn).collect()}
        assert got == {i: names["ab"[i % 2]] for i in range(8)}


def test_an_xz_stream_that_asks_for_much_memory_is_reported(spark):
    def hidden(size):
        data = lzma.compress(b"password=hunter22 " * 3, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": size}])
        return "x " + base64.b64encode(data).decode() + " y"

    df = spark.createDataFrame([(1, hidden(8 << 20)), (2, hidden(256 << 20))], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(":")[0] for r in secrets.find_secrets(df).collect()}
    assert got == {1: "assign", 2: "bomb"}


def test_runs_side_by_side_keep_their_tables(spark):
    ready, done, out = threading.Event(), threading.Event(), {}

    def other():
        out["df"] = common.materialize(spark.range(5), "other")
        ready.set()
        done.wait(60)
        out["n"] = out["df"].count()

    t = threading.Thread(target=other)
    mark = common.written()
    t.start()
    ready.wait(60)
    own = common.materialize(spark.range(3), "own")
    assert common.written() == mark + 1
    common.discard_since(spark, mark)
    done.set()
    t.join()
    assert out["n"] == 5 and common.written() == mark
    with pytest.raises(Exception):
        own.select(F.sum("id")).collect()


@pytest.mark.parametrize("few", [16 << 20, 0])
def test_many_blocks_of_a_benchmark_copy_no_texts(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_BYTES", few)
    r = random.Random(8)
    items = [(i, prose(r, 60, 10_000)) for i in range(100)]
    docs = [(i, prose(r, 2000, 10_000)) for i in range(60)] + [(60, None), (61, "")]
    docs += [(100 + i, prose(r, 500, 10_000) + " " + items[i][1] + " " + items[99 - i][1]) for i in range(20)]
    docs += [(200 + i, docs[-1][1]) for i in range(150)]  # copies of one text: most rows
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    mark = common.written()
    got = decontaminate.mark_contaminated(d, b, block_bytes=size // 20).collect()
    folders = [p.removeprefix("file://") for p in common._WRITTEN[mark:] if p.endswith("marks")]
    spent = [sum(os.path.getsize(os.path.join(f, x)) for x in os.listdir(f) if x.endswith(".parquet")) for f in folders]
    assert len(folders) >= 20 and max(spent) < sum(len(t or "") for _, t in docs) / 10
    once = decontaminate.mark_contaminated(d, b).collect()
    same([(x.doc_id, x.n_words, x.n_hit, ",".join(x.item_ids), x.contaminated) for x in got], [(x.doc_id, x.n_words, x.n_hit, ",".join(x.item_ids), x.contaminated) for x in once])
    assert sum(x.contaminated for x in got) == 170 and all(len(x.item_ids) >= 2 for x in got if x.contaminated)


def test_counts_from_tasks_are_those_of_the_texts(spark, monkeypatch):
    r = random.Random(4)
    texts = {"a": [prose(r, 300).encode(), "é\x00ß".encode()], "b": [b"xyx xyz", b"", b"q"], "c": [b""]}
    want = ppm_langid.Ppm(texts)
    data = [(lang, t.decode()) for lang, own in texts.items() for t in own]
    got = ppm_langid.learned(spark.createDataFrame(data, "lang string, text string").repartition(3))
    monkeypatch.setattr(ppm_langid, "AT_ONCE", 7)
    for other in (got, ppm_langid.Ppm(texts)):
        assert other.langs == want.langs == ["a", "b", "c"]
        for lang in want.langs:
            for (x, n), (y, m) in zip(want.counts[lang], other.counts[lang], strict=True):
                assert x.tolist() == y.tolist() and n.tolist() == m.tolist()
    assert ppm_langid.learned(spark.createDataFrame([], "lang string, text string")).langs == []


def test_counts_that_the_corpus_has_outgrown(spark, monkeypatch):
    """Far more shingles than cells: no block is frequent by chance, those of a shared passage still are."""
    monkeypatch.setattr(parity_join, "CELLS", parity_join.CHUNK)
    monkeypatch.setattr(parity_join, "MOST_CELLS", parity_join.CHUNK)
    monkeypatch.setattr(parity_join, "SPLIT", 4)
    r = random.Random(9)
    passage = prose(r, 60, 5000)
    texts = [f"{prose(r, 900, 5000)} {passage}" for _ in range(300)]
    texts += [t.replace(" ", " extra ", 1) for t in texts[:40]] + texts[40:50]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cells = parity_join.cells_for(10**12)
    assert cells == parity_join.CHUNK
    counts = parity_join.counted(parity_join.survey(df, 5, cells)[1], cells)
    assert np.median(counts) == 0 and (parity_join.parts_of(counts) > 1).mean() < 0.05
    shared = parity_join.shingle_set(passage.encode(), 5)
    assert (parity_join.parts_of(counts[parity_join._cell(shared, cells)]) > 1).all()
    got = [tuple(x) for x in parity_join.near_duplicates(df).collect()]
    same(got, parity_join.brute(docs))


def test_the_sample_of_the_classifier_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_cnn.Cnn, "train", lambda self, texts, labels, steps: seen.append((texts, labels)) or self)
    docs = [(i, f"{i} " + "x" * (50_000 if i % 10 == 0 else 100)) for i in range(200)] + [(200, None)]
    labels = [(i, i % 2) for i in range(201)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    quality_cnn.fit(d, lab, train_bytes=4000)
    (texts, y), whole = seen.pop(), {(t or "").encode() for _, t in docs}
    assert set(texts) <= whole and all(3000 < sum(len(t) for t, q in zip(texts, y) if q == k) <= 4000 for k in (0, 1))
    quality_cnn.fit(d, lab)
    assert len(seen.pop()[0]) == 201
    only_long = d.where("doc_id % 10 = 0 and doc_id < 200")
    assert quality_cnn.fit(only_long, lab, train_bytes=4000).constant is not None and not seen
