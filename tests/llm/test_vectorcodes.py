import hashlib

import numpy as np
import pytest

from roomgraph.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int"


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, v, k, "x", 1) for i, v, k in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, vc.encode(docs, **kw).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [int(np.floor(scale * x)) for x in v], k) for i, v, k in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in kept], dtype=np.int64)
    cuts = vc.cuts_of(x.shape[1], parts)
    books = [x[:entries, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:])]

    def nearest():
        return [((x[:, None, a:b] - book[None]) ** 2).sum(2) for a, b, book in zip(cuts[:-1], cuts[1:], books)]

    for _ in range(rounds):
        for p, d in enumerate(nearest()):
            at = d.argmin(1)
            for e in range(len(books[p])):
                if (at == e).any():
                    mine = x[at == e, cuts[p]:cuts[p + 1]]
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    far = nearest()
    code = ["".join(f"{int(d[i].argmin()):02x}" for d in far) for i in range(len(x))]
    error = [sum(int(d[i].min()) for d in far) for i in range(len(x))]
    of = {}
    for (_, _, k), e in zip(kept, error):
        of[k] = of.get(k, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted([(i, code[n], error[n], of[k], sha) for n, (i, _, k) in enumerate(kept)], key=str)


def test_equals_the_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK", 16 * 64)  # many small blocks
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 16)), np.round(rng.normal(size=(300, 16))),  # many ties
                        np.repeat(rng.normal(size=(3, 16)), 60, 0)])
    rows = [(int(i), v.tolist(), int(i) % 4) for i, v in zip(rng.permutation(3000), x)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, parts=5, entries=7, rounds=3, scale=10) == brute(rows, 5, 7, 3, 10)


def test_whole_nodes_are_assigned():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-9, 9, (500, 4)) + c for c in (0, 1000, -1000)])
    tree = vc.grow(points, vc.LEAF)
    whole, apart = vc.settle(tree, points[tree["order"]], np.array([[0] * 4, [1000] * 4, [-1000] * 4]))
    n = sum(int((tree["stop"] - tree["start"])[node].sum()) for node, _ in whole)
    assert n + sum(len(r) for r, _ in apart) == 1500 and n > 1400


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, -0.25, 1.0], None), (1, [0.1] * 3, None), (1, [0.1] * 3, 5), (None, [0.7, 0.0, -3.0], 5), (4, None, 1),
            (5, [nan, 0.0, 1.0], 1), (6, [inf, 0.0, 1.0], 1), (7, [None, 0.0, 1.0], 1), (8, [], 1)]
    assert run(spark, rows) == brute(rows) and len(run(spark, rows)) == 4
    assert len(run(spark, [*rows, (9, [1.0], 1)])) == 4
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    with pytest.raises(Exception, match="31 bits"):
        run(spark, [(1, [1e9], 1)])
