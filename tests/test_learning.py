"""Learning loop on literal cases."""

import numpy as np
from pyspark.sql import functions as F

from roomgraph.functions import geometry as g
from roomgraph.operators import learn, lifecycle

ROW = ("scene_id long, ord long, frame string, label_hint string, name string, color string, "
       "feature array<double>, x double")


def rows(spark, data):
    df = spark.createDataFrame(data, ROW)
    return df.withColumn("center", F.when(F.col("x").isNotNull(), g.make_point(F.col("x"), 0.0, 0.0))).drop("x")


def test_pool_known_merge_new(spark):
    seen = rows(spark, [(1, 1, "frame_000001.jpg", "c", "椅子", "黑色", None, None),
                        (1, 2, "frame_000002.jpg", "f", "风扇", "白色", None, None),
                        (1, 3, "frame_000003.jpg", "f", "电风扇", "白色", None, None)])
    known = spark.createDataFrame([(1, "chair_6", "椅子", "黑色", None)],
                                  "scene_id long, node_id string, name string, color string, feature array<double>")
    pooled = learn.pool_candidates(learn.novel(seen, known))
    stats = {r.action: r.n for r in learn.pool_stats(seen, pooled).collect()}
    assert stats == {"known_skip": 1, "new": 1, "merged": 1}
    assert learn.candidates(pooled).collect()[0].n_observations == 2


def test_pool_walk_equals_plain_loop(spark):
    rng = np.random.default_rng(4)
    names, colors = ["风扇", "椅子", "杯子", None], ["红", "白", ""]
    data = []
    for i in range(120):
        name = names[rng.integers(4)]
        feat = [1.0, float(rng.integers(0, 3))]
        x = None if rng.random() < 0.3 else float(rng.uniform(0, 12))
        data.append((int(rng.integers(0, 2)), i, f"frame_{i:06d}.jpg", "h", name, colors[rng.integers(3)], feat, x))
    pools, want = {0: [], 1: []}, {}
    fam = {"风扇": "fan", "椅子": "chair", "杯子": "cup"}
    for s, i, _, _, name, color, feat, x in data:
        for c in pools[s]:
            close = x is not None and c["x"] is not None and abs(x - c["x"]) <= 1.0
            if name and c["name"]:
                same = (not color or not c["color"] or color == c["color"]) and (fam[name] == fam[c["name"]] or close)
            else:
                a, b = np.array(feat), np.array(c["feat"])
                same = close and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.82
            if same:
                break
        else:
            c = {"first": i, "x": None, "name": None, "color": "", "feat": feat}
            pools[s].append(c)
        if x is not None:
            c["x"] = x
        if name:
            c["name"], c["color"] = name, color
        want[i] = c["first"]
    got = learn.pool_candidates(rows(spark, data))
    first = got.groupBy("scene_id", "candidate_id").agg(F.min("ord").alias("first"))
    merged = {r.ord: r.first for r in got.join(first, ["scene_id", "candidate_id"]).collect()}
    assert merged == want


def test_duplicates_keep_the_surer(spark):
    data = [(1, 1, "chair_6", "chair", "椅子", "黑色", [1.0], 540, 610, 8, 0.833),
            (1, 2, "chair_8", "chair", "办公椅", "黑色", [1.0], 570, 607, 4, 0.761),
            (1, 3, "chair_9", "chair", "椅子", "白色", [1.0], 570, 607, 4, 0.9)]
    df = spark.createDataFrame(
        data, "scene_id long, ord long, instance_id string, class string, name string, color string, "
              "feature array<double>, first_no long, last_no long, n_observations long, median_conf double"
    ).withColumn("center", F.lit(None).cast("struct<x:double,y:double,z:double>"))
    kept, report = learn.merge_duplicates(df)
    got = {r.instance_id: r.n_observations for r in kept.collect()}
    assert got == {"chair_6": 12, "chair_9": 4}
    assert [(r.keep, r.absorbed) for r in report.collect()] == [("chair_6", "chair_8")]


def plain_merge(rows, tol=0.82, near=1.0):
    """The loop itself: rows are dicts in ord order."""
    def same(a, b):
        if a["class"] != b["class"]:
            return False
        over = min(a["last_no"], b["last_no"]) - max(a["first_no"], b["first_no"])
        short = min(a["last_no"] - a["first_no"], b["last_no"] - b["first_no"])
        meet = over > 0 and short > 0 and over / short >= 0.5
        close = a["center"] is not None and b["center"] is not None and sum((a["center"][k] - b["center"][k]) ** 2 for k in "xyz") ** 0.5 <= near
        if a["name"] is not None and b["name"] is not None:
            return (not a["color"] or not b["color"] or a["color"] == b["color"]) and (a["name"] == b["name"] or meet or close)
        fa, fb = np.array(a["feature"]), np.array(b["feature"])
        return fa @ fb / max(np.sqrt(fa @ fa) * np.sqrt(fb @ fb), 1e-9) >= tol and (meet or close)

    rows, report = [dict(r) for r in rows], []
    while True:
        pair = next(((i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if same(rows[i], rows[j])), None)
        if pair is None:
            return rows, report
        a, b = rows[pair[0]], rows.pop(pair[1])
        keep, gone = (a, b) if a["median_conf"] >= b["median_conf"] else (b, a)
        rows[pair[0]] = keep | {"first_no": min(a["first_no"], b["first_no"]), "last_no": max(a["last_no"], b["last_no"]),
                                "n_observations": a["n_observations"] + b["n_observations"]}
        report.append((keep["instance_id"], gone["instance_id"], a["n_observations"] + b["n_observations"]))


def test_merging_equals_plain_loop(spark):
    rng = np.random.default_rng(12)
    data = []
    for scene in range(12):
        for o in range(30):
            start = int(rng.integers(0, 400))
            data.append({
                "scene_id": scene, "ord": o, "instance_id": f"{scene}_{o}", "class": str(rng.choice(["chair", "fan"])),
                "name": None if rng.random() < 0.5 else str(rng.choice(["qa", "qb", "qc"])), "color": str(rng.choice(["", "red", "blue"])),
                "feature": rng.integers(-1, 2, 3).astype(float).tolist(), "first_no": start, "last_no": start + int(rng.integers(0, 60)),
                "n_observations": int(rng.integers(1, 9)), "median_conf": float(rng.integers(1, 6)) / 5,
                "center": None if rng.random() < 0.3 else {"x": float(rng.random() * 6), "y": float(rng.random() * 6), "z": 0.0}})
    df = spark.createDataFrame(data, "scene_id long, ord long, instance_id string, class string, name string, color string, feature array<double>, "
                               "first_no long, last_no long, n_observations long, median_conf double, center struct<x:double,y:double,z:double>")
    kept, report = learn.merge_duplicates(df)
    cols = ["instance_id", "first_no", "last_no", "n_observations"]
    got, told = {}, {}
    for r in kept.collect():
        got.setdefault(r.scene_id, []).append(tuple(r[c] for c in cols))
    for r in report.collect():
        told.setdefault(r.scene_id, []).append((r.keep, r.absorbed, r.n_observations_sum))
    merges = 0
    for scene in range(12):
        rows, steps = plain_merge([r for r in data if r["scene_id"] == scene])
        assert sorted(got[scene]) == sorted(tuple(r[c] for c in cols) for r in rows)
        assert sorted(told.get(scene, [])) == sorted(steps)
        merges += len(steps)
    assert merges > 60


def test_scenes_walked_whole_or_by_components_merge_alike(spark, monkeypatch):
    test_merging_equals_plain_loop(spark)  # a scene at once
    monkeypatch.setattr(learn, "_WALK", 0)
    test_merging_equals_plain_loop(spark)


def test_confirmation_rules(spark):
    views = spark.createDataFrame(
        [("a", 1, "杯子", "白"), ("a", 2, "杯子", "白"), ("b", 1, "杯子", "白"), ("c", 1, "杯子", "白"),
         ("c", 2, "床", "白"), ("d", 1, "杯子", "白"), ("e", 1, "杯子", "白"), ("e", 2, "杯子", "白")],
        "candidate_id string, ord long, name string, color string")
    conf = spark.createDataFrame(
        [("d", 1, "杯子", "白", "interactive", 1.0), ("e", 1, "水杯", "白", "interactive", 1.0)],
        "candidate_id string, ord long, name string, color string, source string, weight double")
    got = {r.candidate_id: r for r in learn.decide_upgrades(views, conf).collect()}
    assert got["a"].upgrade and got["a"].sources == "multi_view"
    assert not got["b"].upgrade and got["b"].reason == "no_confirmation" and not got["c"].upgrade
    assert got["d"].upgrade and got["d"].confidence == 1.0 and got["e"].name == "水杯"


def test_reidentify_tiers(spark):
    gal = spark.createDataFrame(
        [(1, 1, "chair_6", [0.0, 1.0], "椅子", "黑色"), (1, 2, "fan", [1.0, 0.0], "电风扇", "白色")],
        "scene_id long, ord long, node_id string, feature array<double>, name string, color string")
    asks = spark.createDataFrame(
        [(1, 10, [1.0, 0.0], "办公椅", "黑色"), (1, 11, [0.99, 0.01], "马桶", "白色"), (1, 12, [1.0, 0.0], "杯子", "蓝色")],
        "scene_id long, query_id long, feature array<double>, name string, color string")
    got = {r.query_id: (r.match_id, r.tier) for r in learn.reidentify(asks, gal).collect()}
    assert got == {10: ("chair_6", "strong"), 11: ("fan", "weak"), 12: (None, "none")}


def test_corrections_moves_stale(spark):
    nodes = spark.createDataFrame([("n", "电风扇", "白色", 1.0)], "node_id string, name string, color string, confidence double")
    fix = spark.createDataFrame([("n", 1, 5, "interactive", "暖风机", "")],
                                "node_id string, ord long, t_s long, source string, new_name string, new_color string")
    node, log = lifecycle.apply_corrections(nodes, fix)
    row = node.collect()[0]
    assert (row["name"], row.color, row.confidence) == ("暖风机", "白色", 0.5)
    assert (log.collect()[0].old_name, log.collect()[0].new_name) == ("电风扇", "暖风机")
    at = spark.createDataFrame([("n",)], "node_id string").withColumn("center", g.make_point(1.0, 2.0, 0.0))
    move = spark.createDataFrame([("n", 1, 10)], "node_id string, ord long, t_s long").withColumn("center", g.make_point(3.0, 4.0, 0.0))
    now, left = lifecycle.move_nodes(at, move)
    assert now.collect()[0].center.x == 3.0 and left.collect()[0].old_center.x == 1.0
    ages = spark.createDataFrame([(100.0,), (1000000.0,), (None,)], "s double")
    got = [r[0] for r in ages.select(lifecycle.stale_status(F.col("s"), F.lit(1003000.0), 3600.0)).collect()]
    assert got == ["stale", "active", "active"]
