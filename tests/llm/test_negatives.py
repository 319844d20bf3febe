import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from roomgraph.llm import negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchor_id long"


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, v, k, "x", 1) for i, v, k in rows], SCHEMA)
    return sorted(map(tuple, hn.mine(docs, F.col("id") % 10 == 0, **kw).collect()))


def brute(rows, positives=5, negatives=5, low=80, scale=256):
    sound = {}
    for i, v, k in rows:
        if i is not None and k is not None and v and all(x is not None and np.isfinite(x) for x in v):
            at = (str(k), np.array(v, np.float32).astype(float).tolist())
            sound[i] = min(sound.get(i, at), at)
    ints = {i: np.floor(scale * np.array(v)).astype(int) for i, (_, v) in sound.items()}
    out = []
    for a in (i for i in sound if i % 10 == 0):
        score = {i: int(ints[a] @ ints[i]) for i in sound if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if sound[i][0] == sound[a][0]][:positives]:
            fits = [i for i in order if sound[i][0] != sound[a][0]
                    and low * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 24))
    x = np.concatenate([rng.normal(size=(200, 24)), *[b + 0.1 * rng.normal(size=(150, 24)) for b in base],
                        np.repeat(base, 30, 0), np.zeros((4, 24)), np.round(rng.normal(size=(60, 24)))])
    rows = [(int(i), v.astype(np.float32).tolist(), int(k)) for i, v, k in
            zip(rng.permutation(3000), x, rng.integers(0, 3, len(x)))]
    want = brute(rows)
    assert run(spark, rows) == want and len(want) > 500
    monkeypatch.setattr(hn, "ANCHORS", 30)  # several blocks of anchors
    monkeypatch.setattr(hn, "ROWS", 40)
    assert run(spark, rows, positives=3, negatives=2, low=95, scale=20) == brute(rows, 3, 2, 95, 20)


def test_intervals_hold_and_drop(spark):
    rng = np.random.default_rng(7)
    near = rng.normal(size=70)
    x = np.concatenate([near + 0.2 * rng.normal(size=(300, 70)), rng.normal(size=(3000, 70))])
    ints = np.floor(256 * x).astype(np.int64)
    made = list(hn._coded(70, 17)(iter([pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(x))), pa.array(["a"] * len(x)), pa.array(ints.tolist(), pa.list_(pa.int64()))],
        names=["id", "label", "ints"])])))
    block = hn._Block(pa.Table.from_batches(made), 70)
    at, dropped = np.arange(len(x)), 0
    for i in range(20):
        score = block.ints.astype(np.int64) @ ints[i]
        least, most = block.interval(at, ints[i], hn.rotation(70, 17))
        assert (least <= score).all() and (score <= most).all()
        dropped += int((most < np.sort(score)[-6]).sum())
    assert dropped > 0.8 * 20 * 3000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0], 2), (4, [0.9, 0.0], None), (5, None, 2),
            (6, [], 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [None, 1.0], 2), (None, [0.9, 0.0], 2), (11, [0.9, 0.0, 0.0], 2),
            (10, [0.0, 0.0], 3), (12, [0.0, 0.0], 3), (2, [0.9, 0.0], 2), (20, [1.0, 1.0], 9), (13, [-1.0, 0.0], 1)]
    got = run(spark, rows)
    assert got == brute([r for r in rows if r[0] != 11])
    assert [r[:4] for r in got if r[0] == 0][:3] == [(0, 1, 1, 20), (0, 1, 2, 2), (0, 1, 3, 3)]
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1)]) == []
