import numpy as np

from roomgraph.llm import vectordedup as vd

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, node long, unit double"


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, v, k, "x", 1, 2.0) for i, v, k in rows], SCHEMA)
    return [tuple(r) for r in vd.near_vectors(docs, **kw).collect()]


def brute(rows, least=0.93):
    sound = {}
    for i, v, k in rows:
        if i is None or k is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        at = (str(k), list(np.array(v, np.float32).astype(float)))
        sound[i] = min(sound.get(i, at), at)
    ids = sorted(sound)
    x = np.array([sound[i][1] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    kind = np.array([sound[i][0] for i in ids])
    near = (x @ x.T >= least) & (kind[:, None] == kind[None, :])
    np.fill_diagonal(near, False)
    comp = np.array(ids)
    while True:
        after = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(ids))])
        if (after == comp).all():
            break
        comp = after
    told = {i: (i, int(near[k].sum()), int(comp[k]), bool(comp[k] == i)) for k, i in enumerate(ids)}
    return sorted(told.get(i, (i, 0, i, True)) for i in {i for i, _, _ in rows if i is not None})


def test_tight_wide_and_lone_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = [rng.normal(size=(300, 16)), base[0] + 0.05 * rng.normal(size=(700, 16)),  # tight: angles decide
         base[1] + 0.22 * rng.normal(size=(400, 16)),  # wide: some pairs link, blocks are compared
         np.repeat(base[2:3], 90, 0), 3 * base[2:4],  # equal vectors, and one of the same direction
         np.repeat(base[4:40], 2, 0) + 0.1 * rng.normal(size=(72, 16))]
    x = np.concatenate(x).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(rng.permutation(5000), x, label)]
    got, want = sorted(run(spark, rows)), brute(rows)
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]
    assert [r[1] for r in got] == [r[1] for r in want]
    assert max(r[1] for r in want) > 10 * 24  # lists of 24 had to be enlarged


def test_blocks_of_a_wide_group_are_compared(spark, monkeypatch):
    monkeypatch.setattr(vd, "RUN", 16)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=8) + 0.35 * rng.normal(size=(260, 8))).astype(np.float32)
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    assert sorted(run(spark, rows, degree=8, sample=6)) == brute(rows)


def test_audit_starts_another_descent(spark, monkeypatch):
    begun, real = [], vd.starts

    def first_blind(nodes, *a, **kw):
        begun.append(kw["seed"])
        made = real(nodes, *a, **kw)
        return made.filter("false") if len(begun) == 1 else made

    monkeypatch.setattr(vd, "starts", first_blind)
    rows = [(i, [1.0, 0.001 * i], 1) for i in range(30)]
    assert sorted(run(spark, rows)) == brute(rows)
    assert len(begun) == 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1),
            (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 0.0], 1), (10, [None, 1.0], 1), (None, [1.0, 0.0], 1),
            (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [0.0, 1.0], 1), (13, None, 1)]
    got = run(spark, rows)
    assert sorted(r for r in got if r[0] is not None) == brute([r for r in rows if r[0] != 11] + [(11, None, 1)])
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)] * 2
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == [(1, 0, 1, True)]
