"""The ten queries against brute force, on small tables with nulls, empty and very long texts,
ties, repeated rows, clashing column names, and on empty tables."""

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import os
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import components, decontaminate, forest, line_dedup, packing, parity_join, ppm_langid, quality_cnn, secrets, tool_calls, warc

DOC = "doc_id long, text string"
DATA = "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def prose(r, n, vocabulary=40):
    return " ".join(f"w{r.randint(0, vocabulary)}" for _ in range(n))


# 1 -----------------------------------------------------------------------------------------


def contaminated_fixture():
    r = random.Random(2)
    items = [(1, prose(r, 25)), (2, "only Three words"), (3, None), (None, "null id item"), (4, "  "), (5, prose(r, 10)), (10, "ONLY three, words"), (2, "a second text of item two with many words in it")]
    docs = [(i, prose(r, 60)) for i in range(6)]
    docs += [(7, "x " + items[0][1].upper() + " tail"), (8, "only-three_words; " + items[5][1]), (9, None), (10, ""), (11, "é " * 5000 + items[5][1]), (7, "x " + items[0][1]), (None, items[5][1])]
    docs += [(12, " ".join(items[0][1].split()[:14])), (13, " ".join(items[0][1].split()[:9])), (14, "a second text of item two with many words in it")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 120])
def test_decontamination(spark, block):
    docs, items = contaminated_fixture()
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    m = decontaminate.mark_contaminated(d, b, block_bytes=block)
    got = m.select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()
    same(got, decontaminate.brute(docs, items))
    same(rows(decontaminate.drop_contaminated(d, b)), [t for t, r in zip(docs, decontaminate.brute(docs, items)) if not r[-1]])


def test_decontamination_of_nothing_and_by_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", 9)], "doc_id long, text string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.mark_contaminated(docs, none), "doc_id", "n_words", "n_hit", "contaminated") == [(1, 2, 0, False)]
    assert decontaminate.mark_contaminated(docs.limit(0), none).count() == 0


def test_words():
    assert decontaminate.words_of("A-b_C9 É~ß`z q".encode()) == ["a".encode(), b"b", b"c9", "É".encode(), "ß".encode(), "z q".encode()]


# 2 -----------------------------------------------------------------------------------------


def exact(data, k):
    ok = {}
    for i, v in data:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, v)
    out = []
    for q, v in ok.items():
        if q % 20 == 0:
            near = sorted((-float(np.dot(np.array(v, np.float64), np.array(w, np.float64))), i) for i, w in ok.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return out


def test_nearest_small(spark):
    r = np.random.default_rng(0)
    data = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(150)]
    data += [(i, data[40][1]) for i in range(200, 240)]  # copies tie
    data += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [None] + [1.0] * 7), (305, [float("inf")] * 8), (None, [1.0] * 8), (320, [1.0, 2.0]), (321, [3.0, 4.0]), (60, data[60][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(forest.nearest(df, df.where("vec_id % 20 = 0")))
    want = exact(data, 20)
    same([g[:3] for g in got], [w[:3] for w in want])
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))], rtol=0, atol=1e-12)
    assert forest.nearest(df.limit(0), df.limit(0)).count() == 0


def recall_of(spark, monkeypatch, x, every):
    """Mean recall over the queries, and the share of the vectors scored for one."""
    pairs, scored = [], forest.scored
    monkeypatch.setattr(forest, "scored", lambda p, *rest: pairs.append(p.count()) or scored(p, *rest))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for q, _, i, s in rows(forest.nearest(df, df.where(f"vec_id % {every} = 0"))):
        found.setdefault(q, {})[i] = s
    recall = []
    for q, got in found.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        recall.append(sum(v >= np.sort(s)[-20] - 1e-12 for v in got.values()) / 20)
        assert len(got) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in got.items())
    assert len(found) == -(-len(x) // every)
    return np.mean(recall), pairs[0] / len(found) / len(x)


def unit(n, d=64, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n, every, share", [(500, 20, 0.5), (2000, 20, 0.2), (16384, 160, 0.06)])
def test_recall(spark, monkeypatch, n, every, share):
    recall, scored = recall_of(spark, monkeypatch, unit(n), every)
    print(f"n {n}: recall {recall:.3f}, scored {scored:.3f}")
    assert recall >= 0.93 and scored <= share


@pytest.mark.parametrize("n, chunk", [(3000, 100), (600, 4)])  # nodes of one and of two symbols
def test_recall_over_nodes(spark, monkeypatch, n, chunk):
    monkeypatch.setattr(forest, "CHUNK", chunk)
    assert recall_of(spark, monkeypatch, unit(n), 60)[0] >= 0.93


def test_recall_of_unequal_lengths_and_groups(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = unit(4000, 32) * r.uniform(0.5, 2, size=(4000, 1)).astype(np.float32)
    x[1000:2000] = x[7]  # copies
    x[2000:3000] = x[8] + r.normal(size=(1000, 32)).astype(np.float32) * 0.2
    monkeypatch.setattr(forest, "CHUNK", 1500)  # some nodes are cut into chunks
    assert recall_of(spark, monkeypatch, x, 40)[0] >= 0.9


# 3 -----------------------------------------------------------------------------------------


def test_encoding_is_the_tokenizers():
    r, e = random.Random(1), packing.Encoder(packing.vocabulary_path())
    letters = "aAé'sΣς \t\n\x0b\x85\xa0 İ!?12²́e漢<|>ﬁK\x1c\x00ßÅ'ret"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["<|endoftext|> x", "don't we'll", "x" * 5000]
    for i in range(256):
        texts += [chr(i), f"a{chr(i)}b", f"!{chr(i)}'s", f"{chr(i)}1{chr(i)}"]
    assert [e.encode(t) for t in texts] == [e.raw(t) for t in texts]
    e.MOST = 3
    assert [e.encode(t) for t in texts[:200]] == [e.raw(t) for t in texts[:200]]


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 3)
    r, cap = random.Random(4), 64
    docs = [(i, prose(r, r.randint(0, 60), 5)) for i in range(80)] + [(90, None), (91, ""), (92, "word " * 900), (92, "word " * 900), (None, "x")] + [(100 + i, "same text here") for i in range(30)]
    df = packing.pack_documents(spark.createDataFrame(docs, DOC), capacity=cap).collect()
    e, want = packing.Encoder(packing.vocabulary_path()), []
    for i, t in docs:
        ids = np.append(np.frombuffer(e.raw(t or ""), "<u4"), 1).astype("<u4")
        want += [(i, k // cap, k, len(ids[k : k + cap]), zlib.crc32(ids[k : k + cap].tobytes())) for k in range(0, len(ids), cap)]
    same([tuple(x)[:5] for x in df], want)
    filled = {}
    for x in df:
        filled.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap
    assert len(filled) == -(-sum(w[3] for w in want) // cap) or len(filled) <= 1.02 * sum(w[3] for w in want) / cap + 1


def test_plans_hold_all_and_are_tight():
    r = random.Random(9)
    for h in ({}, {1: 1}, {64: 5}, {33: 7}, {n: r.randint(1, 30) for n in range(1, 65)}, {n: r.randint(1, 9) for n in range(17, 40)}, {r.randint(1, 64): r.randint(1, 4000) for _ in range(20)}):
        p = packing.plan(h, 64, 16)
        total = {}
        for c, times in p:
            assert sum(n * q for n, q in c.items()) <= 64 and times > 0
            for n, q in c.items():
                total[n] = total.get(n, 0) + q * times
        assert total == h
        bins = sum(t for _, t in p)
        free, plain = [], 0  # best fit, decreasing, one by one
        for n in sorted(h, reverse=True):
            for _ in range(h[n]):
                at = min((x for x in free if x >= n), default=None)
                if at is None:
                    plain += 1
                    at = 64
                else:
                    free.remove(at)
                free.append(at - n)
        assert bins <= plain * 1.02 + 1


# 4 -----------------------------------------------------------------------------------------

CALL = "array<struct<id: string, name: string, arguments: string>>"
MESSAGE = f"conv_id long, turn long, text string, tool_calls {CALL}, tool_call_id string, parent_ids array<string>"


def test_tool_calls(spark):
    tools = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "string", "enum": ["x", "y"]}, "c": {"type": "array"}}, "additionalProperties": False}}
    m = spark.createDataFrame([
        (1, 0, "go", [("i1", "f", '{"b": "x",  "a": 1}'), ("i2", "f", '{"a": -1}')], None, None),
        (1, 1, "late \"r\"", None, "i2", None), (1, 2, "first", None, "i1", None), (1, 2, "second", None, "i1", None),
        (1, 3, None, [("i3", "g", '{"a": 1}'), ("i1", "f", '{"z": 1, "a": 2}')], None, ["i2"]), (1, 4, "r", None, "nobody", None),
        (1, 5, None, [("i4", "f", "not json"), (None, "f", None), ("i5", "f", '{"a": "1"}')], None, ["i3"]), (2, 0, "r", None, "i1", None),
        (3, 0, None, [("p", "f", '{"a":1,"b":"q"}')], None, ["q"]), (3, 1, None, [("q", "f", '{"a":1,"c":[1.50,null]}')], None, ["p"]), (3, 2, None, [("s", "f", "[1]")], None, ["q"]),
        (None, 0, None, [("n", "f", '{"a":1}')], None, None), (None, 1, "res", None, "n", None), (4, 0, None, [], None, None), (4, 1, None, None, None, None)], MESSAGE)
    got = tool_calls.link_tool_calls(m, tools).select("conv_id", "level", "turn", "place", "call_id", "result_turn", "status", "problem", "canonical").collect()
    same(got, [
        (1, 0, 0, 0, "i1", 2, "answered", None, '{"arguments":{"a":1,"b":"x"},"id":"i1","name":"f","result":"first"}'),
        (1, 0, 0, 0, "i1", 2, "answered", None, '{"arguments":{"a":1,"b":"x"},"id":"i1","name":"f","result":"second"}'),
        (1, 0, 0, 1, "i2", 1, "answered", "a: minimum", '{"arguments":{"a":-1},"id":"i2","name":"f","result":"late \\"r\\""}'),
        (1, 1, 3, 0, "i3", None, "unanswered", "unknown tool", '{"arguments":{"a":1},"id":"i3","name":"g"}'),
        (1, 0, 3, 1, "i1", None, "unanswered", "unknown property", '{"arguments":{"a":2,"z":1},"id":"i1","name":"f"}'),
        (1, None, None, None, "nobody", 4, "orphan", None, '{"id":"nobody","result":"r"}'),
        (1, 2, 5, 0, "i4", None, "unanswered", "not an object", '{"arguments":"not json","id":"i4","name":"f"}'),
        (1, None, 5, 1, None, None, "unanswered", "not an object", '{"arguments":null,"name":"f"}'),
        (1, 2, 5, 2, "i5", None, "unanswered", "a: type", '{"arguments":{"a":"1"},"id":"i5","name":"f"}'),
        (2, None, None, None, "i1", 0, "orphan", None, '{"id":"i1","result":"r"}'),
        (3, None, 0, 0, "p", None, "unanswered", "b: enum", '{"arguments":{"a":1,"b":"q"},"id":"p","name":"f"}'),
        (3, None, 1, 0, "q", None, "unanswered", None, '{"arguments":{"a":1,"c":[1.5,null]},"id":"q","name":"f"}'),
        (3, None, 2, 0, "s", None, "unanswered", "not an object", '{"arguments":[1],"id":"s","name":"f"}'),
        (None, 0, 0, 0, "n", 1, "answered", None, '{"arguments":{"a":1},"id":"n","name":"f","result":"res"}')])
    assert tool_calls.link_tool_calls(m.limit(0), tools).count() == 0


def valid(x, schema):
    """A plain validator; ``None``: not there."""
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    types = {"string": isinstance(x, str), "integer": number and x == int(x), "number": number, "boolean": isinstance(x, bool), "object": isinstance(x, dict), "array": isinstance(x, list), "null": x is None}
    kinds = schema.get("type", list(types))
    if not any(types[k] for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    alike = lambda a, b: type(a) is type(b) and a == b or (number and isinstance(b, (int, float)) and not isinstance(b, bool) and a == b)
    if "enum" in schema and not any(alike(x, w) for w in schema["enum"]):
        return False
    if isinstance(x, dict):
        own = schema.get("properties", {})
        if set(schema.get("required", [])) - set(x) or (schema.get("additionalProperties") is False and set(x) - set(own)):
            return False
        if not all(valid(x[k], s) for k, s in own.items() if k in x):
            return False
    if isinstance(x, list) and not (schema.get("minItems", 0) <= len(x) <= schema.get("maxItems", 99) and all(valid(y, schema.get("items", {})) for y in x)):
        return False
    if isinstance(x, str) and not schema.get("minLength", 0) <= len(x) <= schema.get("maxLength", 99):
        return False
    return not number or schema.get("minimum", x) <= x <= schema.get("maximum", x)


def test_arguments_against_a_plain_validator(spark):
    r = random.Random(4)
    schema = {
        "type": "object", "required": ["a"], "description": "says nothing",
        "properties": {
            "a": {"type": "integer", "minimum": 0, "maximum": 5}, "b": {"enum": ["x", 1, True, None, {"k": [1, 2]}]}, "it's \"q\"": {"type": ["string", "null"], "minLength": 2, "maxLength": 3},
            "o": {"type": "object", "required": ["z"], "properties": {"z": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "number", "maximum": 5}}}, "additionalProperties": False}}}
    some = {
        "a": [0, 1, 5, 6, -1, 1.0, 1.5, "1", True, None, 2, 3], "b": ["x", "y", 1, 1.0, "1", True, "true", False, None, {"k": [1, 2]}, {"k": [2, 1]}], "it's \"q\"": ["q", "qq", "qqqq", None, 5],
        "o": [{}, {"z": [1]}, {"z": [1, 9]}, {"z": [1, "s"]}, {"z": [1, 2, 3, 4]}, {"z": []}, {"z": [1], "y": 1}, 5, [1]]}
    rows_ = [{k: r.choice(v) for k, v in some.items() if r.random() < (0.95 if k == "a" else 0.4)} for _ in range(400)] + [[1], 5, None, "x"]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows_)], "i int, x string")
    got = {x.i: x.p for x in df.select("i", tool_calls.problem(F.try_parse_json("x"), schema).alias("p")).collect()}
    want = [valid(x, schema) for x in rows_]
    assert [got[i] is None for i in range(len(rows_))] == want and 20 < sum(want) < 380
    with pytest.raises(ValueError, match="oneOf"):
        tool_calls.problem(F.lit(None), {"properties": {"a": {"oneOf": []}}})


def test_long_chains_take_few_rounds(spark):
    n = 40
    chain = [(7, i, None, [(f"c{i}", "f", "{}")], None, [f"c{i - 1}"] if i else None) for i in range(n)]
    got = tool_calls.link_tool_calls(spark.createDataFrame(chain, MESSAGE), {})
    assert {r.turn: r.level for r in got.collect()} == {i: i for i in range(n)}


def longest_chains(ups):
    """A plain definition: levels grow until nothing changes; what still waits has none."""
    level = {}
    while ready := {x: 1 + max((level[u] for u in own), default=-1) for x, own in ups.items() if x not in level and all(u in level for u in own)}:
        level |= ready
    return {x: level.get(x) for x in ups}


@pytest.mark.parametrize("several", [0.1, 0.5, 0.9])
def test_levels_of_calls_with_several_parents(spark, several):
    r, rows_, want = random.Random(several), [], {}
    for conv in (1, 2, 3, None):
        n, ups = 60, {}
        for i in range(n):
            most = r.randint(2, 4) if r.random() < several else r.random() < 0.9
            # now and then a parent that comes later, the call itself, or one that is not there
            ups[f"c{i}"] = [f"c{r.randrange(n) if r.random() < (0.02 if conv == 2 else 0) else r.randint(max(0, i - 6), i - 1)}" for _ in range(int(most))] if i else []
        if conv == 3:
            ups["c50"] = ["c50", "c2"]
        places = list(ups)
        r.shuffle(places)  # turns need not follow the order
        rows_ += [(conv, t, None, [(x, "f", "{}")], None, r.choice([[*ups[x], None, "gone"], ups[x] * 2 or None])) for t, x in enumerate(places)]
        want |= {(conv, x): v for x, v in longest_chains(ups).items()}
    m = spark.createDataFrame(rows_, MESSAGE)
    out = tool_calls.link_tool_calls(m, {})
    assert {(x.conv_id, x.call_id): x.level for x in out.collect()} == want
    assert any(v is None for v in want.values()) and max(v or 0 for v in want.values()) > 8
    up = {(x[0], x[3][0][0]): [u for u in x[5] or () if u not in (None, "gone")] for x in rows_}
    seen = set()
    for x in tool_calls.in_order(out).collect():
        key = (x.conv_id, x.call_id)
        assert x.level is None or all((x.conv_id, u) in seen for u in up[key])
        seen.add(key)


def test_nested_several_parents_at_any_depth(spark):
    n = 40
    nest = [(7, n - i, None, [(f"c{i}", "f", "{}")], None, [f"c{j}" for j in range(max(0, i - 2), i)]) for i in range(n)]
    got = tool_calls.link_tool_calls(spark.createDataFrame(nest, MESSAGE), {})
    assert {r.call_id: r.level for r in got.collect()} == {f"c{i}": i for i in range(n)}


def test_turns_of_other_roles_are_results(spark):
    rows_ = [(1, 0, "user", "a"), (1, 1, "tool", "b"), (1, 2, None, "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e")]
    m = tool_calls.as_calls(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string"))
    got = tool_calls.link_tool_calls(m, tool_calls.TOOLS).select("turn", "result_turn", "status").collect()
    same(got, [(0, 1, "answered"), (None, 2, "orphan"), (3, 4, "answered")])


def test_tool_calls_stay_native(spark):
    plan = tool_calls.link_tool_calls(tool_calls.as_calls(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")), tool_calls.TOOLS)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5 -----------------------------------------------------------------------------------------


def junk(r, n):
    return " ".join(f"w{r.randint(0, 40)}{r.choice(['###', '***', '!!!'])}" for _ in range(n))


def test_quality(spark):
    r = random.Random(5)
    docs = [(i, prose(r, r.randint(5, 120)) if i % 4 else junk(r, r.randint(5, 120))) for i in range(300)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(240)] + [(9999, 1, 0), (None, 0, 0), (3, None, 0)]
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_cnn.fit(d, lab, steps=120)
    more = d.unionByName(spark.createDataFrame([(400, None), (401, ""), (402, prose(r, 30000)), (402, prose(r, 3))], DOC)).withColumn("score", F.lit("clash"))
    got = quality_cnn.score_quality(more, model).select("doc_id", "score", "predicted").collect()
    assert len(got) == 304 and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got)
    late = [(g.predicted, int(g.doc_id % 4 > 0)) for g in got if 240 <= g.doc_id < 300]
    assert np.mean([a == b for a, b in late]) > 0.93
    assert next(g for g in got if g.doc_id == 400).score == next(g for g in got if g.doc_id == 401).score
    assert next(g.predicted for g in got if g.doc_id == 402) == 1


def test_quality_with_one_class_or_none(spark):
    d = spark.createDataFrame([(1, "x"), (2, None)], DOC)
    for labels, want in (([(1, 1)], 2 / 3), ([], 0.5)):
        model = quality_cnn.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r.score for r in quality_cnn.score_quality(d, model).collect()] == [pytest.approx(want)] * 2
    assert quality_cnn.score_quality(d.limit(0), model).count() == 0


def test_scores_are_those_of_plain_loops():
    m, r = quality_cnn.Cnn(3), random.Random(2)
    p, half, group, n = m.p, quality_cnn.HALF, quality_cnn.GROUP, quality_cnn.FILTERS
    for text in (b"", b"short", bytes(r.randrange(256) for _ in range(1000)), b"z" * (half * 3)):
        count = max(1, -(-len(text) // half))
        padded = text + b"\0" * (count * half + group - len(text))
        pooled = []
        for h in range(count):
            best = np.full(n, -np.inf)
            for at in range(h * half, (h + 1) * half, group):  # eight bytes, in steps of four
                first, second = (np.concatenate([p["e"][b] for b in padded[x : x + group]]) for x in (at, at + group))
                best = np.maximum(best, first @ p["w"][:, :n] + second @ p["w"][:, n:])
            pooled.append(np.maximum(best + p["b"], 0))
        chunk = [np.maximum(a, b) for a, b in zip(pooled, pooled[1:])] or pooled
        hidden = np.array([np.maximum(c @ p["v"] + p["d"], 0) for c in chunk])
        z = np.concatenate([hidden.mean(0), hidden.max(0)]) @ p["u"] + p["c"][0]
        assert m.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_gradients():
    model, texts, y = quality_cnn.Cnn(), [b"some text", b"other " * 60, b""], np.array([1, 0, 1], np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        z = model.logits(texts)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g, r = model.gradients(texts, y), np.random.default_rng(0)
    for k, v in model.p.items():
        flat = v.reshape(-1)
        for i in r.choice(flat.size, min(6, flat.size), replace=False):
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(float(np.asarray(g[k]).reshape(-1)[i]), abs=2e-4)


def test_chunks_cover_the_whole_text():
    text = bytes(range(1, 251)) * 5
    buf, start, n = quality_cnn.layout([text, b""])
    a, b, m = quality_cnn.chunks(n)
    assert b"".join(bytes(buf[s : s + quality_cnn.HALF]) for s in start[: n[0]]).rstrip(b"\0") == text
    assert n.tolist() == [10, 1] and m.tolist() == [9, 1] and (b - a).tolist() == [1] * 9 + [0]


# 6 -----------------------------------------------------------------------------------------


def copies(r, n_groups=12):
    docs, i = [], 0
    for _ in range(n_groups):
        base = prose(r, r.randint(6, 160), 3000).split()
        for _ in range(r.choice([1, 2, 3, 14])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"e{r.randint(0, 999)}"
            docs.append((i, "  ".join(w) if r.random() < 0.8 else "\t".join(w).upper()))
            i += 1
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed, monkeypatch):
    monkeypatch.setattr(parity_join, "SQUARE", 6)
    monkeypatch.setattr(parity_join, "OFTEN", 5)
    r = random.Random(seed)
    docs = copies(r) + [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two  WORDS"), (905, "a b c d"), (906, "x " * 9000), (907, "x " * 20), (908, "a b c d e"), (909, "a b c d e f")]
    got = rows(parity_join.near_duplicates(spark.createDataFrame(docs, DOC)))
    same(got, parity_join.brute(docs))


def test_a_mark_of_often_makes_a_tie_in_any_order():
    def part(classes, late=0):  # each class holds the one token 5
        fp, size, need = (np.array(x, t) for x, t in zip(zip(*classes), (np.int64, np.uint8, np.uint8)))
        n = len(fp)
        return b"".join(x.tobytes() for x in (np.int64(n), fp, size, need, np.ones(n, np.uint32), np.full(n, 5, np.uint32), np.zeros(n, np.uint8), np.full(n, late, np.int8)))

    mark, rest = part([(1, 70, 0)]), part([(1, 70, 6), (2, 70, 6), (3, 71, 6)])
    for parts in ([mark, rest], [rest, mark]):
        pairs = {}
        found = [r for b in parity_join._join(parts, pairs) for r in b.to_pylist()]
        assert not pairs and sorted((r["kind"], r["u"], r["v"]) for r in found) == [(1, 1, 2), (1, 1, 3)]
    pairs = {}
    assert not list(parity_join._join([rest, rest], pairs)) and set(pairs) == {(1, 2), (1, 3), (2, 3)}
    pairs = {}  # late classes meet early ones only, in small groups and in large ones
    early, late = part([(1, 100, 6)]), part([(c, 100, 6) for c in range(2, 5)], 60)
    assert not list(parity_join._join([early, late], pairs)) and not pairs
    many = part([(c, 100, 6) for c in range(2, 30)], 60)
    assert not list(parity_join._join([early, many], pairs)) and not list(parity_join._join([many], pairs)) and not pairs
    found = [r for b in parity_join._join([part([(1, 100, 6)], -60), many], pairs) for r in b.to_pylist()]
    assert sorted((r["kind"], r["u"], r["v"]) for r in found) == [(1, 1, c) for c in range(2, 30)]


def test_near_duplicates_with_a_hot_block_split_unevenly(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "OFTEN", 5)
    r = random.Random(6)
    base = prose(r, 150, 3000).split()
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 4 * 4):
            w[r.randrange(len(w))] = f"e{r.randint(0, 999)}"
        docs.append((i, " ".join(w)))
    few = docs[34:] + [(100 + i, t) for i, t in docs[:4]]
    for parts in ([docs[:34], few], [few, docs[:34]]):
        df = spark.createDataFrame(parts[0], DOC).coalesce(1).union(spark.createDataFrame(parts[1], DOC).coalesce(1))
        same(rows(parity_join.near_duplicates(df)), parity_join.brute(parts[0] + parts[1]))


def forms(r, n, words, change):
    """Documents of one form, each with words of its own in some places."""
    base = prose(r, words, 3000).split()
    return [" ".join(f"e{i}x{j}" if r.random() < change else w for j, w in enumerate(base)) for i in range(n)]


@pytest.mark.parametrize("split", [1, 2])
def test_near_duplicates_of_forms_and_parts_of_forms(spark, monkeypatch, split):
    """Sets that are alike about as much as a link asks for, of sizes apart, with frequent blocks in parts."""
    monkeypatch.setattr(parity_join, "SPLIT", split)
    monkeypatch.setattr(parity_join, "OFTEN", 5)
    r = random.Random(11)
    texts = [t for change in (0.0, 0.01, 0.02, 0.03, 0.04, 0.06) for t in forms(random.Random(3), 14, 120, change)]
    texts += [" ".join(t.split()[r.randint(0, 20) : 120 - r.randint(0, 20)]) for t in texts]
    texts += forms(r, 30, 30, 0.02)
    r.shuffle(texts)
    docs = list(enumerate(texts))
    same(rows(parity_join.near_duplicates(spark.createDataFrame(docs, DOC).repartition(3))), parity_join.brute(docs))


@pytest.mark.parametrize("spread", [16, 1])
def test_linked_sets_meet_early(spread, monkeypatch):
    """At each of the first blocks that a linked pair shares, lateness adds up to ``LATE`` at most."""
    monkeypatch.setattr(parity_join, "LEAST_BLOCKS", 16)
    r, seen = np.random.default_rng(8), 0
    counts = r.integers(0, 5, parity_join.CELLS).astype(np.int32)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, r.integers(5, 900), dtype=np.uint64))
        gone, new = r.integers(0, len(a) // 5 + 1), r.integers(0, len(a) // 5 + 1)
        b = np.unique(np.concatenate([r.choice(a, len(a) - gone, replace=False), r.integers(0, 2**63, new, dtype=np.uint64)]))
        if not parity_join.linked(parity_join.common(a, b), len(a), len(b)):
            continue
        f = parity_join.band(max(len(a), len(b)))
        x, y = (parity_join.blocks_of(s, counts, spread)[f - parity_join.band(len(s))] for s in (a, b))
        if min(x[1], y[1]) < 1:
            continue  # too few blocks: the pass is repeated
        late = [dict(zip(z[0].tolist(), parity_join.lateness(z[2], np.full(len(z[0]), parity_join._size_class(len(s)))))) for z, s in ((x, a), (y, b))]
        shared = [t for t in x[0].tolist() if t in late[1]][: min(x[1], y[1])]
        assert len(shared) == min(x[1], y[1]) and all(late[0][t] + late[1][t] <= parity_join.LATE for t in shared)
        seen += 1
    assert seen > 50


def test_documents_of_one_form_that_are_not_linked_do_not_meet(spark):
    r = random.Random(4)
    base = prose(r, 300, 3000).split()
    blanks = set(range(5, 300, 22))  # each spoils five shingles: a similarity of about 0.63
    docs = [(i, " ".join(f"e{i}x{j}" if j in blanks else w for j, w in enumerate(base))) for i in range(400)]
    docs = spark.createDataFrame(docs, DOC)
    _, partial = parity_join.survey(docs, 5)
    assert parity_join.candidates(docs, parity_join.counted(partial), 400 * 300, 5).where("kind < 2").count() == 0


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], DOC).withColumn("n", F.lit("clash"))
    same(rows(parity_join.near_duplicates(df)), [(5, 2, 3), (5, 2, 3), (None, 2, None), (3, 2, 3)])
    assert parity_join.near_duplicates(df.limit(0)).count() == 0


def test_sketches_bound_the_symmetric_difference():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([r.choice(a, r.integers(1, len(a) + 1), replace=False), r.integers(0, 2**63, r.integers(0, 40), dtype=np.uint64)]))
        away = len(np.setxor1d(a, b))
        assert parity_join.apart(parity_join.parity(a), parity_join.parity(b)) <= away
        if parity_join.linked(parity_join.common(a, b), len(a), len(b)):
            assert away <= parity_join.most_apart(len(a), len(b)) and parity_join.fits(len(a), len(b))


def test_too_few_blocks_are_noticed():
    s = np.arange(16, dtype=np.uint64) << np.uint64(40)  # all in one block
    (token, need, *_), *_ = parity_join.blocks_of(s, np.zeros(parity_join.CELLS, np.int32), 16)
    assert len(token) == 1 and need < 1
    assert all(n >= 1 for _, n, *_ in parity_join.blocks_of(s, np.zeros(parity_join.CELLS, np.int32), 1 << 44))


def test_components(spark):
    r = random.Random(6)
    for n, m in ((30, 20), (60, 58), (1, 0)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(12)]
        label = {x: x for e in edges for x in e}
        for _ in range(len(label)):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = dict(rows(components.components(spark.createDataFrame(edges, "u long, v long"))))
        assert got == {x: c for x, c in label.items() if x in got} and all(x in got for a, b in edges if a != b for x in (a, b))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 7 -----------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/ b\r\nX: y", "same é\r\n\r\nWARC/1.1\r\n"), (9, None, "same é\r\n\r\nWARC/1.1\r\n"), (4, "u", "same é\r\n\r\nWARC/1.1\r\n"), (2, "u", None), (3, "u", ""), (5, "u", "漢" * 200000), (None, "u", "only"), (7, "u", "twice"), (7, "u", "twice")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(df, path)
    heads = warc.read_headers(spark, path)
    got = warc.resolve(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = []
    for i, _, html in pages:
        p = (html or "").encode()
        last = max((j for j, _, h in pages if (h or "") == (html or "") and j is not None), default=None)
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if i == last else ("revisit", last))))
    same(got, want)
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.resolve(warc.read_headers(spark, str(tmp_path / "none"))).count() == 0


def test_reading_members_and_plain_files():
    one = lambda body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    bodies = [b"a", b"", b"x" * 3_000_000]
    for data in (b"".join(map(one, bodies)), b"".join(gzip.compress(one(b)) for b in bodies)):
        assert [block for _, block in warc.parse(data)] == bodies


# 8 -----------------------------------------------------------------------------------------


def dropped(docs, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    split = [(i, (t or "").split("\n")) for i, t in docs]
    seen = {}
    for i, own in split:
        for x in own:
            seen.setdefault(key(x), set()).add(i)
    out = []
    for i, own in split:
        kept = [x for x in own if not (key(x) and len(seen[key(x)]) >= min_docs)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    r = random.Random(8)
    pool = [f"Line {i}" for i in range(30)] + ["", "  ", "É line", "é line", " x"]
    docs = [(i, "\n".join(r.choice(["", " ", "\t"]) + r.choice([str.upper, str])(r.choice(pool)) for _ in range(r.randint(0, 9)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "Line 1\n" * 20000), (5, "Line 1\nLine 2"), (5, "Line 1\nLine 2"), (None, "Line 1\nx"), (None, "Line 1\ny")]
    df = spark.createDataFrame(docs, DOC).withColumn("n_lines", F.lit("clash")).withColumn("extra", F.lit(1))
    for least in (3, 10):
        got = line_dedup.drop_repeated_lines(df, least)
        same(got.select("doc_id", "n_lines", "n_dropped", "text").collect(), dropped(docs, least))
    assert got.columns == ["doc_id", "extra", "text", "n_lines", "n_dropped"]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


# 9 -----------------------------------------------------------------------------------------


def test_language(spark):
    r = random.Random(9)
    make = {"xx": lambda: "".join(r.choice("abca ") for _ in range(80)), "yy": lambda: "".join(r.choice("xyzéx ") for _ in range(80))}
    docs = [(i, make[k](), k) for i, k in enumerate(["xx", "yy"] * 30)] + [(70, None, "xx"), (71, "abc", None), (72, "", "yy"), (73, "12 !?", "yy"), (74, make["yy"]() * 3000, None), (74, "é", None), (None, "abcab", "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = ppm_langid.identify(df, df.where("doc_id < 40")).collect()
    assert len(got) == len(docs) and all(0 <= g.score <= 1 for g in got)
    by = {(g.doc_id, g.text): g.lang_pred for g in got}
    assert all(by[i, t] == k for i, t, k in docs[:60])
    assert [by[docs[k][0], docs[k][1]] for k in range(60, 66)] == ["und", "xx", "und", "und", "yy", "yy"]
    assert {g.lang_pred for g in ppm_langid.identify(df, df.limit(0)).collect()} == {"und"}
    assert ppm_langid.identify(df.limit(0), df).count() == 0


def test_code_lengths_are_those_of_the_definition():
    m = ppm_langid.Ppm({"a": [b"abracadabra", "été".encode()], "b": [b"xyx xyz"]})
    t = m.unfold()
    for text in (b"abra", b"zzz?", "été xy".encode(), b"", bytes(range(256))):
        want = [sum(m.bits(lang, text[max(0, i - m.order) : i], text[i]) for i in range(len(text))) for lang in m.langs]
        assert np.allclose(t.lengths([text])[0], want, rtol=1e-5)


def test_long_texts_are_scored_in_steps():
    t = ppm_langid.Ppm({"a": [b"abcabcaab"]}).unfold()
    r = random.Random(2)
    text = bytes(r.choice(b"abcd") for _ in range((1 << 20) + 1000))
    split = (1 << 20) - 5
    assert t.lengths([text])[0, 0] == pytest.approx(t.lengths([text[:split]])[0, 0] + t.lengths([text[split - 3 :]])[0, 0] - t.lengths([text[split - 3 : split]])[0, 0], rel=1e-4)


# 10 ----------------------------------------------------------------------------------------


def base_spans(text):
    """Straight from the patterns, on code points."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    s, key = 'password = "hunter2hunter', "AKIA" + "Q1" * 8
    r = random.Random(10)
    bits = [s, key, "0af" * 9, "API_KEY:'abcdef", "token=abc", "paſſword=abcdefgh", "toKen = 123456", " é", "漢 ", "%", "\\u00", "ab" * 11, "AKIAQQ", "\n", "x", "Secret\": zzzzzzzz", "secretsecret=xxxxxx", "="]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for i in range(300)] + [(400, None), (401, ""), (402, "é" * 100000 + s), (402, s)]
    df = spark.createDataFrame(docs, DOC).withColumn("spans", F.lit("clash"))
    got = {(g.doc_id, g.text): g for g in secrets.find_secrets(df).collect()}
    for i, t in docs:
        want, g = base_spans(t or ""), got[i, t]
        assert g.base_spans == secrets.shown(want) and [g.n_assign, g.n_access, g.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert set(g.base_spans.split(",")) <= set(g.spans.split(","))
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_secrets_in_layers():
    s = 'token: "q1w2e3r4t5y6'
    uni = "".join(f"\\u{ord(c):04x}" for c in s)
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    show = lambda t: secrets.shown(secrets.in_code_points(t.encode(), secrets.find(t.encode())[1]))
    assert show("é " + urllib.parse.quote(s) + " z") == f"assign:2:{2 + len(urllib.parse.quote(s))}"
    assert show("漢" + uni) == f"assign:1:{1 + len(uni)}"
    assert show("q" + "".join(f"\\x{b:02x}" for b in s.encode())) == f"assign:1:{1 + 4 * len(s)}"
    assert show(b64("token=abcdef")) == "assign:0:16"
    assert show("\\ud83d\\ude00" + uni) == f"assign:0:{12 + len(uni)}"
    for inner in (b64(s), b64(gzip.compress(s.encode())), b64(zlib.compress(s.encode())), b64(b64(s)), b64("pre " + uni), b64("p " + urllib.parse.quote(b64(s)))):
        assert show(f"a {inner} b {inner}") == f"assign:2:{2 + len(inner)},assign:{5 + len(inner)}:{5 + 2 * len(inner)}"
    assert show("nothing " + b64("only a plain sentence here")) == ""
    bomb = b64(gzip.compress(b"0" * 5_000_000))
    assert [k for _, k, _ in secrets.find(bomb.encode(), 1 << 20)[1]] == [secrets.KINDS.index("bomb")]


def test_secrets_in_compressed_layers():
    s, other = b"token: q1w2e3r4t5y6", b"AKIA" + b"Q1" * 8
    b64 = lambda x: base64.b64encode(x).decode()
    show = lambda t: secrets.shown(secrets.find(t.encode())[1])
    packers = (gzip.compress, zlib.compress, bz2.compress, lzma.compress)
    for f in packers:
        for g in packers:
            t = b64(f(g(s)))  # compressed twice
            assert show(f"a {t}") == f"assign:2:{2 + len(t)}", (f, g)
            t = b64(f(b"first") + g(s))  # in the second member
            assert show(f"a {t}") == f"assign:2:{2 + len(t)}", (f, g)
        t = b64(f(s[:9]) + f(s[9:]))  # over two members
        assert show(t) == f"assign:0:{len(t)}"
        t = b64(f(b"first" * 9) + b"\n" + s + b"\n")  # behind the members
        assert show(t).startswith("assign:0:")
    t = b64(gzip.compress(gzip.compress(gzip.compress(b64(gzip.compress(s)).encode()) + gzip.compress(other))))
    assert show(t) == f"access:0:{len(t)},assign:0:{len(t)}" or show(t) == f"assign:0:{len(t)},access:0:{len(t)}"
    t = b64(gzip.compress(s)[:-8] + b"\0" * 8)  # a wrong checksum
    assert show(t) == f"assign:0:{len(t)}"
    t = urllib.parse.quote(gzip.compress(s))
    assert show(t) == f"assign:0:{len(t)}"


def test_secrets_in_wrapped_glued_and_binary_base64():
    s = b"token=q1w2e3r4t5y6u7i8o9p0 tail"
    b64 = lambda x: base64.b64encode(x).decode()
    show = lambda t: secrets.shown(secrets.find(t.encode())[1]).split(",")
    packers = (gzip.compress, zlib.compress, bz2.compress, lzma.compress)
    noise = bytes(random.Random(4).randbytes(200))
    for at in range(32, 57):  # across the break of 76 columns
        t = base64.encodebytes(b"x " * (at // 2) + b" " * (at % 2) + s).decode().strip()
        assert "\n" in t and f"assign:0:{len(t)}" in show(t)
    for width in (10, 64, 75, 76):
        for glue in ("\n", "\r\n", "\r", "\n    ", " \n\t", "\\n", "\\r\\n"):
            for before in ("", "see ", "see\n", "-----BEGIN KEY-----\n", "cfg/", "id_", "ab-", "q+"):
                for inner in [s * 9] + [f(noise + s) for f in packers]:
                    t = b64(inner)
                    t = before + glue.join(t[i : i + width] for i in range(0, len(t), width))
                    assert any(x.startswith("assign:") for x in show(t + " end")), (width, glue, before)
    for before in ("cfg/", "id_", "x-", "ab+", "ab+cd/", "abcde_"):
        for inner in (s, noise[:50] + s, "é".encode("latin-1") + s, *(f(s) for f in packers)):
            for after in ("", "/x", "_tail"):
                t = before + b64(inner).rstrip("=") + after
                assert f"assign:2:{2 + len(t)}" in show(f"a {t} b"), (before, inner)
    for bad in (b"\xff", b"\0\1\2\3", "é".encode("latin-1")):
        t = b64(bad + b"AKIA" + b"Q1" * 8 + bad)
        assert show(t) == [f"access:0:{len(t)}"]
        t = b64(bad + b64(s).encode() + bad)
        assert show(t) == [f"assign:0:{len(t)}"]
    lines = "one\ntwo\n" + b64(b"token=abcdef") + "\nthree\nfour words"
    assert show(lines) == ["assign:8:24"]
    assert show("a\nb c\n" + "\n".join("plain words only".split() * 50)) == [""]


def test_the_bound_on_unwrapping_is_for_each_stretch():
    big = [base64.b64encode(gzip.compress(b"z " * 4000 + b"token=q1w2e3r4" + bytes([97 + i]))) for i in range(12)]
    found = secrets.find(b" ".join(big), 10_000)[1]  # 96,000 bytes in all
    assert [k for _, k, _ in found] == [0] * 12
    assert [k for _, k, _ in secrets.find(b" ".join(big), 1000)[1]] == [secrets.KINDS.index("bomb")] * 12
    escaped = " ".join(urllib.parse.quote(base64.b64decode(x)) for x in big).encode()
    assert [k for _, k, _ in secrets.find(escaped, 10_000)[1]] == [0] * 12
    nest = base64.b64encode(gzip.compress(b" ".join(big)))  # one stretch, one bound
    assert secrets.KINDS.index("bomb") in [k for _, k, _ in secrets.find(nest, 20_000)[1]]


ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})"), re.compile(rb"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")


def one_by_one(data):
    """Each decoded layer of escapes as (bytes, first and last original byte of each)."""
    runs = [], []
    runs[0].extend((m.start(), m.end(), bytes([int(m[1], 16)])) for m in ESCAPE[0].finditer(data))
    for m in ESCAPE[1].finditer(data):
        units, i = [], m.start()
        while i < m.end():
            n = 6 if data[i + 1 : i + 2] == b"u" else 4
            units.append((i, i + n, int(data[i + 2 : i + n], 16)))
            i += n
        if all(x < 128 for _, _, x in units):
            runs[1].extend((a, b, bytes([x])) for a, b, x in units)
        else:
            text = "".join(chr(x) for _, _, x in units).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
            runs[1].append((m.start(), m.end(), text.encode()))
    for found in runs:
        out, at = [], 0
        for a, b, new in found:
            out += [(data[i], i, i + 1) for i in range(at, a)] + [(x, a, b) for x in new]
            at = b
        if found:
            yield out + [(data[i], i, i + 1) for i in range(at, len(data))]


def test_escapes_are_those_of_the_definition():
    r = random.Random(3)
    bits = [b"%41", b"%e9", b"%", b"%4", b"\\u0041", b"\\u00e9", b"\\x41", b"\\xe9", b"\\ud83d", b"\\ude00", b"\\u", b"\\x4", b"a", b"41", "é".encode(), b"\\", b"\\u20ac", b"%4%41"]
    for _ in range(3000):
        data = b"".join(r.choice(bits) for _ in range(r.randint(1, 12)))
        got = [x for x in secrets.unwrap(secrets.Layer(data), lambda at: 1) if isinstance(x, secrets.Layer) and not isinstance(x.lo, int)]
        assert [list(zip(x.data, x.lo.tolist(), x.hi.tolist())) for x in got] == list(one_by_one(data))


def test_many_escapes_take_bounded_memory():
    import tracemalloc

    text = b"%41" * 2_000_000 + b"%70assword=hunter2hunter"
    tracemalloc.start()
    found = secrets.find(text)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(6_000_000, 0, len(text))] and peak < 50 * len(text)


def test_large_compressed_stretches_are_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 16)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    s = b"token: q1w2e3r4t5y6"
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        for at in (10, 65_530, 200_000, 399_000):
            body = (b"z " * 200_000)[:at] + s + (b" z" * 200_000)[at:]
            for data in (pack(body), pack(body[:at]) + pack(body[at:]) if pack is not zlib.compress else pack(body)):
                t = base64.b64encode(data)
                assert secrets.find(b"a " + t)[1] == [(2, 0, 2 + len(t))], (pack, at)
        t = base64.b64encode(pack(b"z " * 300_000))
        assert [k for _, k, _ in secrets.find(t, 500_000)[1]] == [secrets.KINDS.index("bomb")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_base_counts_are_duckdbs(spark):
    import duckdb

    word = "(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    sql = f"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i){word}', 2), lambda x: length(x) >= 6)) AS n_assign,
      len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
      len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM '{DATA}/documents.parquet')"""
    got = secrets.op10_secret_scan(spark, DATA).select("doc_id", "n_assign", "n_access", "n_hex").collect()
    want = duckdb.connect().execute(sql).fetchall()
    same(got, want)
    assert sum(sum(r[1:]) for r in want) > 0


# all ---------------------------------------------------------------------------------------


def test_queries_over_empty_tables(spark, tmp_path):
    from marginalia.llm.catalogue import LLM_QUERIES

    d = str(tmp_path)
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int",
        "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int",
        "conversations": "conv_id long, turn long, role string, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    for name, query in LLM_QUERIES.items():
        assert query(spark, d).count() == 0, name
