"""Every helper must equal the plain computation over the whole key."""

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from roomgraph.operators import assemble, relations, scaling, search, similarity


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(
        pd.DataFrame({"k": rng.integers(0, 3, n), "t": rng.permutation(n * 5)[:n], "v": rng.normal(size=n).round(2)})
    )


def test_previous_and_sessions_and_positions(spark):
    df = frame(spark)
    want = df.toPandas().sort_values(["k", "t"])
    want["p"] = want.groupby("k")["v"].shift()
    want["pos"] = want.groupby("k").cumcount() + 1
    gap = want.groupby("k")["t"].diff()
    want["s"] = (gap.isna() | (gap >= 12)).groupby(want["k"]).cumsum()
    got = scaling.with_previous(df, ["k"], "t", {"v": "p"}, 37)
    got = scaling.sessionize(got, ["k"], "t", 12, 50, name="s")
    got = scaling.positions(got, ["k"], "t", width=40).toPandas().sort_values(["k", "t"])
    for c in ("p", "pos", "s"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_halo_equals_full_window(spark):
    df = frame(spark)
    sliced = scaling.with_halo(df, "t", 100, 60)
    got = sliced.withColumn(
        "n", F.expr("count(*) OVER (PARTITION BY k, _bucket ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)")
    ).filter("NOT _context").select("k", "t", "n")
    want = df.selectExpr(
        "k", "t", "count(*) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n"
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_quantiles_of_hot_keys(spark):
    df = frame(spark)
    wanted = {"a": ("v", 0.1), "b": ("v", 0.5), "c": ("t", 0.25)}
    plain = df.groupBy("k").agg(
        *[F.percentile(c, F.lit(p)).alias(name) for name, (c, p) in wanted.items()]
    ).toPandas().sort_values("k")[["k", *wanted]]
    middle = sorted(r["count"] for r in df.groupBy("k").count().collect())[1]
    for bins, most in ((1, 0), (8, 0), (256, 0), (16, middle), (16, 10**6)):
        got = scaling.exact_quantiles(df, ["k"], wanted, bins, most).toPandas().sort_values("k")
        assert got[["k", *wanted]].values.tolist() == plain.values.tolist()  # to the last bit
    empty = df.limit(3).select("k", F.lit(None).cast("double").alias("v"), "t")
    for most in (0, 10**6):
        assert all(r.a is None for r in scaling.exact_quantiles(empty, ["k"], {"a": ("v", 0.5)}, 8, most).collect())


def test_bins_of_a_heavy_tailed_key_are_even(spark):
    """One value far out doesn't put all others into one bin."""
    df = spark.range(20_000).select(F.lit(None).cast("int").alias("k"), F.when(F.col("id") == 0, 1e300).otherwise(
        1 + F.col("id") * 1e-9).alias("v"))
    got = scaling.ranked_quantiles(df, ["k"], {"a": ("v", 0.5), "b": ("v", 1.0)}, 64)
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.max("v").alias("b")).head()
    assert got.head() == want
    splits = df.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1280)).head()[0]
    sizes = df.groupBy(F.size(F.filter(F.array(*map(F.lit, splits)), lambda x: x < F.col("v")))).count().agg(F.max("count")).head()[0]
    assert sizes < 4 * 20_000 / 64


def test_staircase_and_last_known(spark):
    df = frame(spark).withColumn("o", F.col("t"))
    steps = scaling.prefix_best(df, ["k"], "v", "o", 0.5, "best").toPandas()
    for k, part in df.toPandas().groupby("k"):
        part = part.sort_values("v")
        mine = steps[steps.k == k].sort_values("v")
        for v in part["v"]:
            assert mine[mine.v <= v]["best"].min() == part[part.v <= v]["o"].min()
    gappy = df.withColumn("w", F.when(F.col("t") % 3 == 0, F.col("v")))
    got = scaling.last_known(gappy, ["k"], "t", {"w": "prev"}, 45).toPandas().sort_values(["k", "t"])
    want = got.groupby("k")["w"].transform(lambda s: s.ffill().shift())
    assert np.allclose(got["prev"], want, equal_nan=True)


def test_stretches_of_overlapping_intervals(spark):
    rng = np.random.default_rng(4)
    data = [(int(k), int(lo), int(lo + n)) for k, lo, n in zip(
        rng.integers(0, 4, 600), rng.integers(-3000, 3000, 600), rng.integers(1, 40, 600))]
    data += [(9, 0, 5), (9, 5, 7), (9, 6, 8), (9, 6, 30), (9, 29, 31), (9, 31, 32)]  # touching ends are apart
    want, reach = {}, {}
    for k, lo, hi in sorted(data):
        label, top = reach.get(k, (None, None))
        if top is None or lo >= top:
            label, top = lo, hi
        reach[k] = (label, max(top, hi))
        want[k, lo, hi] = label
    df = spark.createDataFrame(data, "k long, lo long, hi long")
    got = scaling.stretches(df, ["k"], "lo", "hi", 50, "s").collect()
    assert len(got) == len(data) and {(r.k, r.lo, r.hi): r.s for r in got} == want


def test_prefix_top_equals_plain_search(spark):
    rng = np.random.default_rng(6)
    n = 900
    data = [(int(k), float(z), int(o), str(lab)) for k, z, o, lab in zip(
        rng.integers(0, 3, n), np.where(rng.random(n) < 0.5, rng.normal(0, 2, n), rng.integers(-6, 7, n) / 4),
        rng.permutation(n), rng.choice(list("abcdefgh"), n))]
    data += [(7, 1.0, 5000, "a"), (8, float("nan"), 5001, "a"), (8, None, 5002, "b"), (8, 9.0, 5003, None), (8, 10.0, 5004, "c"), (8, 11.0, 5005, "c")]
    df = spark.createDataFrame(data, "k long, z double, o long, l string")
    for top, reach in ((3, 0.02), (1, 0.25)):
        got = scaling.prefix_top(df, ["k"], "z", "o", "l", top, reach, 0.5, "t").collect()
        rows = [r for r in data if r[1] is not None and r[1] == r[1]]
        assert len(got) == len({r[:2] for r in rows})
        for r in got:
            best = {}
            for _, _, o, lab in sorted((x for x in rows if x[0] == r.k and r.z - x[1] > reach), key=lambda x: x[2]):
                best.setdefault(lab, o)
            assert [(t.l, t.v) for t in r.t] == list(best.items())[:top]


def test_questions_of_large_scenes_pass_no_side_through_the_driver(spark, tmp_path):
    """Files are small for what they hold, so their size must not make Spark broadcast a side."""
    spark.sql("""
        SELECT 0L AS scene_id, id AS ord, concat('n', id) AS node_id, 'cup' AS label, 'cup' AS category,
          'cup' AS name, 'red' AS color, 'cup' AS label_hint, 'ocr' AS source, 'cup' AS text, '' AS layer1_text,
          'red cup' AS layer2_text, array('red') AS aliases, 0.5D AS confidence, id AS query_id, 'on' AS predicate,
          'cup' AS subject_hint, 'red' AS object_hint, CAST(NULL AS STRING) AS parent_id, 1D AS top_z,
          concat('s', id) AS support_id,
          named_struct('xmin', 0D, 'ymin', 0D, 'zmin', 0D, 'xmax', 1D, 'ymax', 1D, 'zmax', 1D) AS box,
          named_struct('x', 0D, 'y', 0D, 'z', 0D) AS center FROM range(4)""").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    edges = t.select("scene_id", F.col("node_id").alias("subject"), "predicate", F.lit("n1").alias("object"),
                     F.lit("active").alias("status"))
    questions = t.select("query_id", "scene_id", "text", "predicate", "subject_hint", "object_hint")
    nodes = t.drop("query_id", "text", "predicate")
    for found in (
        search.locate_ranked(questions, nodes, 1), search.relational(questions, nodes, edges, upright=True),
        search.retrieve(questions, nodes), assemble.text_edges(nodes, nodes),
        relations.on_edges(nodes), relations.near_edges(nodes), relations.support_edges(nodes, nodes),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, found.columns


def test_large_blocks_keep_copies_few_and_give_the_same_matches(spark, monkeypatch):
    rows = spark.range(40_000).select(F.lit(0).alias("kb"), "id")
    # 20 copies of each row in blocks of 2048
    assert similarity._in_blocks(rows, ["kb"], "id", "_a", "_b", rows).count() <= 8 * 40_000
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)
    words = np.array(["", "a", "b"])[rng.integers(0, 3, 60)]
    q = pd.DataFrame({"query_id": range(60), "feature": list(vectors), "conflict": words})
    m = pd.DataFrame({"match_id": range(60), "match_ord": range(60), "feature": list(vectors), "conflict": words})
    score = similarity._score_blocks(["kb"], 3, 0.5, False, 9)
    whole = score((0, 0, 0), q, m)
    monkeypatch.setattr(similarity, "_CELLS", 60 * 7)
    pd.testing.assert_frame_equal(whole, score((0, 0, 0), q, m))
    norms = np.maximum(np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(vectors, axis=1), 1e-9)
    sim = np.round(vectors @ vectors.T / norms, 9)
    want = []
    for i in range(60):
        free = [j for j in range(60) if sim[i, j] >= 0.5 and (words[i] == words[j] or "" in (words[i], words[j]))]
        want.append(sorted(free, key=lambda j: (-sim[i, j], j))[:3])
    assert [set(whole.loc[whole.query_id == i, "match_id"]) for i in range(60)] == [set(w) for w in want]


def test_large_keys_are_split_off(spark):
    rows = [(None, "a")] * 5 + [(1, "a")] * 6 + [(1, None)] * 2 + [(2, "b")] * 4
    df = spark.createDataFrame(rows, "k long, s string")
    small, large = scaling.by_size(df, ["k", "s"], 4)
    assert sorted(map(str, small.distinct().collect())) == sorted(map(str, [Row(k=1, s=None), Row(k=2, s="b")]))
    assert small.count() == 6 and large.count() == 11
    assert scaling.by_size(df, ["k", "s"], 6)[1] is None
