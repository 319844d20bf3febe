"""Gate, parsing, redaction, reading pieces, stream against replay, and SQL twins."""

import json
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from roomgraph.functions import answers as a
from roomgraph.sources import artifacts, corpus
from roomgraph.sources.testtables import view
from roomgraph.streaming import gate

SF = "/root/testdata/sf0.001"


def decide(spark, rows):
    df = spark.createDataFrame(rows, "device_id long, seq long, epoch_s double, trigger string, phash string")
    return {(r.device_id, r.seq): r.reject_reason for r in gate.replay(df).collect()}


def test_gate_rules(spark):
    z, far, mid = "0" * 16, "f" * 16, "0" * 13 + "fff"
    got = decide(spark, [
        (1, 1, 0.0, "auto", z), (1, 2, 1.5, "auto", z), (1, 3, 3.0, "auto", far), (1, 4, 3.2, "auto", z),
        (2, 1, 0.0, "auto", z), (2, 2, 2.0, "auto", mid), (2, 3, 4.0, "manual", z), (2, 4, 200.0, "auto", z),
        *[(3, i, 0.1 * i, "read", z) for i in range(4)],
    ])
    assert [got[1, i] for i in (1, 2, 3, 4)] == [None, "duplicate", None, "rate_limit"]
    assert [got[2, i] for i in (1, 2, 3, 4)] == [None, "no_scene_change", None, None]
    assert [got[3, i] for i in range(4)] == [None, None, None, "read_rate_limit"]


@pytest.mark.parametrize("raw,stage,advice", [
    ('{"advice":"go","risk_level":"danger"}', "json", "go"),
    ('```json\n{"advice":"go"}\n```', "json", "go"),
    ('see {"advice":"go"} ok', "braces", "go"),
    ('{"advice":"go", "objects":[', "advice", "go"),
    ("nothing", "none", ""),
    ('{"scene":7,"advice":"go"}', "advice", "go"),
])
def test_parse_stages(spark, raw, stage, advice):
    row = a.parse_answers(spark.createDataFrame([(raw,)], "raw_text string")).collect()[0]
    assert (row.stage, row.result.advice) == (stage, advice)


def test_reading_text(spark):
    raws = ["abc", "```\nabc\n```", '{"text":"abc"}', "未发现文字。", "报告：未发现文字，其余合格", "x" * 2500]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(
        a.parse_read_text(F.col("raw"))).collect()]
    assert got == ["abc", "abc", "abc", "", "报告：未发现文字，其余合格", "x" * 2000]


def plain_segments(text, limit):
    out = []
    for line in text.split("\n"):
        rest = line.strip()
        while len(rest) > limit:
            head, cut = rest[:limit], 0
            for marks in ("。！？!?；;", "，、,：:）)】」』》"):
                at = max(head.rfind(m) for m in marks)
                if at >= 0:
                    cut = at + 1
                    break
            else:
                at = head.rfind(" ")
                cut = at + 1 if at > 0 else limit
            piece, rest = rest[:cut].strip(), rest[cut:].lstrip()
            if piece:
                out.append(piece)
        if rest:
            out.append(rest)
    return out


def plain_chunks(text, size=500, overlap=60):
    done, held = [], ""
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if len(held) + len(p) + 2 <= size:
            held = f"{held}\n\n{p}" if held else p
        else:
            done += [held] if held else []
            held = p if len(p) <= size else ""
            if len(p) > size:
                done += [c for c in (p[i:i + size].strip() for i in range(0, len(p), size - overlap)) if c]
    return done + ([held] if held else [])


def test_pieces_and_chunks_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120)
    extra = spark.createDataFrame([("凉菜类\n口水鸡 38 元",), ("本店招牌是水煮鱼。人均消费 60 元。",), ("一" * 70,), (" x" * 40,)], "text string")
    rows = docs.unionByName(extra).withColumn("double", F.replace("text", F.lit("\n"), F.lit("\n\n"))).select(
        "text", "double", a.segments(F.col("text"), 30).alias("s"), a.chunks(F.col("double")).alias("c")).collect()
    for r in rows:
        assert r.s == plain_segments(r.text, 30)
        assert r.c == plain_chunks(r.double)


def test_redaction_order(spark):
    text = "id 11010119900307123X tel 13812345678 a@b.cn 京A12345"
    row = a.redact(spark.createDataFrame([(text,)], "t string"), "t").collect()[0]
    assert row.t == "id *** tel *** *** ***"
    assert (row.n_id_card, row.n_phone, row.n_email, row.n_plate) == (1, 1, 1, 1)


def test_redaction_equals_the_plain_patterns(spark):
    rng, chars = random.Random(5), "ab1.@_%-京A川Z9 é١"
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a@b.com_x@y.org", "a@b.cc@d.ee", "x" * 40000 + "@", "1" * 40 + "X", "京A1234川B12345", "A" * 9, ""]
    got = a.redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t").collect()
    for row in got:
        text = texts[row.i]
        for name, pattern in a.REDACT_PATTERNS:
            if name == "email" and len(text) > 10000:  # the plain pattern is quadratic here
                continue
            text, n = re.subn(pattern, a.MASK, text)
            assert row[f"n_{name}"] == n, (texts[row.i], name)
        assert row.t == text
    null = a.redact(spark.createDataFrame([(None,)], "t string"), "t").head()
    assert null.t is None and null.n_email == null.n_plate == 0


def test_sources(spark):
    root = tempfile.mkdtemp(prefix="roomgraph-src-")
    import os
    os.makedirs(f"{root}/s1/docs")
    with open(f"{root}/s1/detections.jsonl", "w") as f:
        for i in range(3):
            f.write(json.dumps({"frame": f"frame_{i:06d}.jpg", "class": "cup", "conf": 0.5, "bbox": [0, 0, 1, 1]}) + "\n")
    got = artifacts.read_lines(spark, root, "detections").orderBy("ord").collect()
    assert [r.frame[-5] for r in got] == ["0", "1", "2"] and got[0].scene_id == "s1"
    assert artifacts.read_lines(spark, root, "anchors").count() == 0
    with open(f"{root}/s1/timeline.csv", "w") as f:
        f.write("frame_index,sender_ts_ns,arrival_ns,flags\n0,5,77,0\n1,6,,0\n")
    clocks = {r.row_no: r.host_mono_ns for r in artifacts.read_timeline(spark, root).collect()}
    assert clocks == {0: 77, 1: 0}
    with open(f"{root}/s1/docs/a.md", "w") as f:
        f.write("one\n\ntwo")
    docs = corpus.read_corpus(spark, f"{root}/s1/docs")
    assert [(r.id, r.text) for r in corpus.chunk_table(docs).collect()] == [("a.md#0", "one\n\ntwo")]
    for v in ("1", "2"):
        corpus.write_version(corpus.chunk_table(docs), f"{root}/kb", v)
    corpus.activate(spark, f"{root}/kb", "2")
    assert [r.version for r in corpus.active_chunks(spark, f"{root}/kb").collect()] == ["2"]


def test_reconstruction_points(spark):
    import os
    import struct

    root = tempfile.mkdtemp(prefix="roomgraph-bin-")
    os.makedirs(f"{root}/s1/sparse/0")
    with open(f"{root}/s1/sparse/0/points3D.bin", "wb") as f:
        f.write(struct.pack("<Q", 2))
        for i in range(2):
            f.write(struct.pack("<Q3d3Bd", i, i, 2.0, 3.0, 1, 2, 3, 0.5) + struct.pack("<Q", i + 1) + b"\0" * 8 * (i + 1))
    got = artifacts.read_reconstruction(spark, root, "points3D").orderBy("x").collect()
    assert [(r.x, r.z, r.track_len, r.model) for r in got] == [(0.0, 3.0, 1, 0), (1.0, 3.0, 2, 0)]


@pytest.mark.parametrize("name", ["relations_on", "retrieval_answer", "shape_replies", "kb_context_asof"])
def test_sql_twins(spark, name):
    import check
    from roomgraph.plans.all_queries import ORACLES, QUERIES

    got = check.normal(QUERIES[name](spark, SF).toPandas())
    want = check.normal(check.connect(SF).execute(ORACLES[name]).df())
    assert got.equals(want)
