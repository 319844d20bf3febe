import numpy as np
from pyspark.sql import functions as F

from roomgraph.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def brute(rows, k):
    """Exact answer over sound rows, for queries divisible by 20."""
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in sound:
        if i % 20 == 0:
            near = sorted(((-sum(v * w), j) for j, w in sound if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], SCHEMA)
    got = {}
    for r in nb.nearest(docs, F.col("id") % 20 == 0, 20, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["vec_id"], r.score))
    return got


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[300:420] = x[7]  # one very common vector
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys()
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.95
    truth = dict(rows)
    for q, near in got.items():
        assert len(near) == 20 and q not in dict(near)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        for j, s in near:
            assert abs(s - np.dot(np.array(truth[q], float), np.array(truth[j], float))) < 1e-9
    assert [j for j, _ in got[320]] == [j for j, _ in want[320]]


def test_few_odd_and_no_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (40, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, []), (3, [0.0, 2.0])]
    got = run(spark, rows)
    assert got == {0: [(20, 0.5), (3, 0.0)], 20: [(3, 1.0), (0, 0.5)]}
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 1.0])]) == {}


def test_opposite_groups_and_lone_vectors_are_whole(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    x = np.concatenate([base + 0.01 * rng.normal(size=(10, 16)), -base + 0.01 * rng.normal(size=(15, 16))])
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows, 20)
    assert {q: [j for j, _ in near] for q, near in got.items()} == {
        q: [j for j, _ in near] for q, near in want.items()}
    # one large tight cluster, and vectors far from it and from each other
    x = np.concatenate([base + 0.05 * rng.normal(size=(600, 16)), 2 * np.eye(16) - base, -2 * np.eye(16) - base])
    rows = [(int(i) + (20 * int(i) - int(i) if i >= 600 else 0), v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys() and all(len(near) == 20 for near in got.values())
    lone = [q for q in want if q >= 12000]
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in lone)
    assert len(lone) == 32 and hit / (20 * len(lone)) >= 0.95


def test_queries_without_neighbours_search_all(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    none = lambda codes, *a, **b: spark.createDataFrame([], nb.PROPOSED)
    monkeypatch.setattr(nb, "from_buckets", none)
    monkeypatch.setattr(nb, "SCAN", 64)
    got, want = run(spark, rows), brute(rows, 20)
    assert {q: [j for j, _ in near] for q, near in got.items()} == {
        q: [j for j, _ in near] for q, near in want.items()}


def test_search_goes_on_until_all_kept_are_opened(spark):
    # a chain: each node knows only the next, better one
    rows = [(i, [1.0 + i], [i + 1] if i < 11 else [10], [2.0 + i]) for i in range(12)]
    own = spark.createDataFrame([(i, v) for i, v, _, _ in rows], "node long, vector array<double>")
    lists = spark.createDataFrame([(i, o, s) for i, _, o, s in rows], "node long, others array<long>, scores array<float>")
    nodes = nb.packed(own).join(lists, "node")
    found = nb.greedy_search(nodes, spark.createDataFrame([(0,)], "node long"))
    assert {r.node for r in found.collect()} >= set(range(1, 12))
