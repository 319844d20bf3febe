"""Scene operators against literal cases and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomgraph.functions import geometry as g
from roomgraph.operators import align, associate, lift, planes, search, spatial
from roomgraph.operators import relations as rel


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "scene_id long, ord long, node_id string, label string, b array<double>")
    return df.withColumn("box", g.make_box(*[F.col("b")[i] for i in range(6)])).drop("b")


ROOM = [
    (1, 0, "table", "桌子", [1.5, 1.0, 0.7, 3.5, 3.0, 0.78]),
    (1, 1, "quilt", "被子", [2.0, 1.5, 0.78, 2.8, 2.5, 0.95]),
    (1, 2, "cup", "杯子", [2.9, 2.6, 0.78, 3.1, 2.8, 0.98]),
    (1, 3, "window", "窗户", [4.7, 0.0, 1.0, 5.0, 2.0, 2.2]),
    (1, 4, "room", "客厅", [0.0, 0.0, 0.0, 5.0, 4.0, 3.0]),
]


def test_room_relations(spark):
    o = boxes(spark, ROOM)
    on = {(r.subject, r.object) for r in rel.on_edges(o).collect()}
    assert {("quilt", "table"), ("cup", "table")} <= on and ("table", "room") not in on
    inside = {(r.container, r.item) for r in rel.contains_pairs(o, o).collect()}
    assert ("room", "table") in inside


def test_big_boxes_meet_small_ones(spark):
    """Boxes of very different size share a grid level."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        x, y, s = rng.uniform(-50, 50), rng.uniform(-50, 50), float(rng.choice([0.3, 3.0, 30.0]))
        z = float(rng.integers(0, 3)) * 0.5
        rows.append((1, i, f"n{i}", "a", [x, y, z, x + s, y + s, z + 0.5]))
    got = {(r.subject, r.object) for r in rel.on_edges(boxes(spark, rows)).collect()}

    def overlap(a, b):
        w = max(0, min(a[3], b[3]) - max(a[0], b[0])) * max(0, min(a[4], b[4]) - max(a[1], b[1]))
        return w / min((a[3] - a[0]) * (a[4] - a[1]), (b[3] - b[0]) * (b[4] - b[1]))

    want = {
        (p[2], q[2]) for p in rows for q in rows
        if p[1] != q[1] and abs(p[4][2] - q[4][5]) <= 0.05 and overlap(p[4], q[4]) >= 0.15
    }
    assert got == want and want


def test_above_pairs_match_counts(spark):
    o = boxes(spark, ROOM)
    pairs = rel.above_edges(o, o).groupBy("subject").count().collect()
    counts = {r.node_id: r.n_below for r in rel.above_counts(o).collect()}
    assert {r["subject"]: r["count"] for r in pairs} == {k: n for k, n in counts.items() if n}


def test_locate_and_relational(spark):
    nodes = boxes(spark, ROOM).withColumns({
        "category": F.lit(""), "layer1_text": F.lit(""), "layer2_text": F.lit(""),
        "aliases": F.array().cast("array<string>"), "confidence": F.lit(1.0),
        "parent_id": F.when(F.col("node_id") != "room", "room"),
    })
    q = spark.createDataFrame([(1, 1, "被子")], "query_id long, scene_id long, text string")
    assert [r.node_id for r in search.locate_ranked(q, nodes, 3).collect()] == ["quilt"]
    edges = rel.on_edges(nodes).withColumn("status", F.lit("active"))
    ask = spark.createDataFrame(
        [(1, 1, "被子", "on", "桌子"), (2, 1, "桌子", "in", "客厅"), (3, 1, "桌子", "on", "客厅")],
        "query_id long, scene_id long, subject_hint string, predicate string, object_hint string",
    )
    got = {(r.query_id, r.object) for r in search.relational(ask, nodes, edges).collect()}
    assert got == {(1, "table"), (2, "room")}


def test_memory_answers(spark):
    nodes = spark.createDataFrame(
        [(1, 0, "a", "电风扇", "白色"), (1, 1, "b", "键盘", "灰色"), (1, 2, "c", "葡萄", "紫色")],
        "scene_id long, ord long, node_id string, name string, color string",
    ).withColumns({
        "label_hint": F.lit(""), "source": F.lit("interactive"), "confidence": F.lit(1.0),
        "center": F.lit(None).cast("struct<x:double,y:double,z:double>"),
    })
    texts = ["电风扇在哪", "鼠标在哪儿", "白色", "不存在的蓝色恐龙", "在哪里"]
    q = spark.createDataFrame([(i, 1, x) for i, x in enumerate(texts)], "query_id long, scene_id long, text string")
    got = {r.query_id: r for r in search.answers(q, search.retrieve(q, nodes)).collect()}
    assert [got[i].found for i in range(5)] == [True, False, True, False, False]
    assert got[0].answer.startswith("根据记忆，白色的电风扇")


def naive_association(rows, dist=0.6, family_dist=0.2):
    from roomgraph.fixed_values import CLASS_FAMILY, TIGHT_FAMILIES

    instances = []
    out = []
    for cls, p in rows:
        fam = CLASS_FAMILY.get(cls, cls)

        def gap(inst):
            pts = [q for _, q in inst["obs"]]
            ref = np.median(pts, axis=0) if len(pts) >= 3 else pts[-1]
            return float(np.linalg.norm(np.asarray(ref) - p))

        best = min(((gap(i), n) for n, i in enumerate(instances) if i["obs"][0][0] == cls), default=(9, -1))
        pick = best[1] if best[0] < dist else -1
        if fam in TIGHT_FAMILIES:
            kin = min(((gap(i), n) for n, i in enumerate(instances) if i["family"] == fam), default=(9, -1))
            if kin[0] < family_dist and (pick < 0 or kin[0] <= best[0]):
                pick = kin[1]
        if pick < 0:
            instances.append({"family": fam, "obs": []})
            pick = len(instances) - 1
        instances[pick]["obs"].append((cls, p))
        out.append(pick)
    return out


def test_association_equals_naive_walk(spark):
    rng = np.random.default_rng(3)
    names = ["cup", "mug", "bucket", "chair", "laptop", "pillow", "blanket"]
    pdf = pd.DataFrame({
        "scene_id": 1, "ord": np.arange(300), "frame_no": np.arange(300) // 5, "conf": 0.5,
        "class": rng.choice(names, 300), **{a: rng.uniform(0, 3, 300).round(3) for a in "xyz"},
    })
    got = associate.associate(spark.createDataFrame(pdf), ["ord"]).toPandas().sort_values("ord")
    want = naive_association([(r["class"], np.array([r.x, r.y, r.z])) for _, r in pdf.iterrows()])
    assert got["instance_no"].tolist() == want


def sightings_of_scenes(spark):
    """Five scenes: rows that come twice, equal orders, missing orders, NaN places, a crowded class, odd types."""
    rng = np.random.default_rng(31)
    n = 1500
    names = ["cup", "mug", "bucket", "chair", "laptop", "pillow", "blanket", "container"]
    pdf = pd.DataFrame({
        "scene_id": rng.integers(0, 5, n), "frame_no": np.arange(n) // 9, "ord": rng.permutation(n), "conf": rng.integers(1, 9, n) / 8,
        "class": np.where(np.arange(n) % 3 > 0, "chair", rng.choice(names, n)),
        **{a: rng.uniform(0, 4, n).round(2) for a in "xyz"}, "s": 0.25})
    rows = spark.createDataFrame(pd.concat([pdf, pdf[pdf["ord"] % 40 == 0]]))
    k = F.col("ord")
    return rows.withColumns({
        "x": F.when(k % 97 > 0, F.when(k % 83 > 0, F.col("x")).otherwise(F.lit(float("nan")))),
        "class": F.when(k % 89 > 0, F.col("class")), "scene_id": F.when(k % 101 > 0, F.col("scene_id")),
        "conf": F.when(k % 53 > 0, F.col("conf")), "empty": F.lit(None).cast("string"),
        "tags": F.array(k, k + 1), "seen_at": F.timestamp_seconds(k), "box": g.make_box(
            F.col("x"), F.col("y"), F.col("z"), F.col("x") + F.col("s"), F.col("y") + F.col("s"), F.col("z") + F.col("s")),
    }).withColumns({
        "text": F.when(k % 31 > 0, F.concat(F.lit("t"), (k % 700).cast("string"))), "ord": F.when(k % 61 > 0, k % 900)})


def test_scenes_walked_at_once_equal_those_spread(spark, monkeypatch):
    seen, orders = sightings_of_scenes(spark).persist(), ["frame_no", "ord", "text"]

    def of(scene):
        monkeypatch.setattr(associate, "_SCENE", scene)
        monkeypatch.setattr(associate, "_HELD", 70)  # many blocks
        got = associate.associate(seen, orders)
        summed = associate.instances(got, F.struct(*orders)).drop("center", "box")
        return (sorted(map(str, got.drop("_part", "_place").collect())), got.schema["_part"].nullable,
                sorted(map(str, summed.select(*sorted(summed.columns)).collect())))

    rows, some_spread, summed = of(0)
    placed = seen.dropna(subset=["scene_id", "class", "x"])
    sizes = sorted(r[1] for r in placed.groupBy("scene_id").count().collect())
    assert some_spread and len(rows) > 1400 and len(summed) > 100
    for scene, spread in ((100_000, False), (sizes[-2], True)):
        got = of(scene)
        assert got[0] == rows and got[1] == spread and got[2] == summed
    seen.unpersist()


def test_short_islands_walked_together_equal_the_walk():
    rng = np.random.default_rng(32)
    sizes = np.sort(rng.integers(2, 60, 40))[::-1]
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    tight = np.repeat(rng.random(40) < 0.5, sizes)
    classes = np.where(tight, rng.integers(0, 3, n), 0)
    xyz = rng.integers(0, 12, (n, 3)) / 10
    head = np.arange(n)
    associate._walk_together(xyz, classes, tight, starts, sizes, 0.6, 0.2, head)
    walk = associate._walk(0.6, 0.2)
    for low, size in zip(starts, sizes):
        part = slice(low, low + size)
        assert (head[part] == low + walk(xyz[part], classes[part], classes[part] * 0, tight[part])).all()


def test_sightings_are_moved_once_and_not_stored(spark, monkeypatch, tmp_path):
    from roomgraph.plans import all_queries

    def stored(_):
        raise AssertionError("stored")

    monkeypatch.setattr(associate, "cut_lineage", stored)
    n = 4000
    lines = spark.range(n).selectExpr(
        "id div 4 AS l_orderkey", "id * 37 % 50 AS l_partkey", "id % 20 AS l_suppkey", "cast(id % 4 + 1 AS int) AS l_linenumber",
        "cast(id % 50 + 1 AS double) AS l_quantity")
    parts = spark.range(50).selectExpr("id AS p_partkey", "concat('red ', if(id % 2 = 0, 'cup', 'gear'), ' x') AS p_name")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    found = all_queries.QUERIES["associate_instances"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange ") == 1 and found.count() > 100


def test_planted_surfaces(spark):
    rng = np.random.default_rng(5)
    flat = np.c_[rng.uniform(0, 2, 400), rng.uniform(0, 2, 400), 0.75 + rng.normal(0, 0.005, 400)]
    wall = np.c_[np.full(300, 3.0) + rng.normal(0, 0.005, 300), rng.uniform(0, 3, 300), rng.uniform(0.4, 2.8, 300)]
    pts = spark.createDataFrame(
        pd.DataFrame(np.r_[flat, wall], columns=list("xyz")).assign(scene_id=1)
    ).select("scene_id", g.make_point(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    top = planes.support_surfaces(pts, rounds=1).collect()[0]
    assert abs(top.top_z - 0.75) < 0.03 and top.n_inliers >= 390
    side = planes.walls(pts, rounds=1).collect()[0]
    assert abs(side.normal.nx) > 0.95 and side.n_inliers >= 250


def test_planes_of_scenes_in_one_call_equal_those_round_by_round(spark, monkeypatch):
    rng = np.random.default_rng(12)
    parts = []
    for scene, n in ((0, 2500), (1, 300), (2, 2), (3, 400)):
        xyz = rng.uniform(0, 3, (n, 3)).round(2)
        xyz[: n // 3, 2] = 0.75  # a table, and repeated points
        xyz[n // 3: n // 2] = xyz[0]
        parts += [(scene, *map(float, p)) for p in xyz]
    parts += [(None, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0), (3, float("nan"), 1.0, 1.0), (3, float("inf"), -0.0, 1.0)]
    points = spark.createDataFrame(parts, "scene_id long, x double, y double, z double").select(
        "scene_id", g.make_point(*map(F.col, "xyz")).alias("p"))

    def found(whole):
        monkeypatch.setattr(planes, "_WHOLE", whole)
        return [sorted(map(str, search(points, 60, 3).collect())) for search in (planes.walls, planes.support_surfaces)]

    by_rounds = found(0)
    assert found(100_000) == by_rounds and found(1000) == by_rounds and all(map(len, by_rounds))


def test_jump_filter_with_return(spark):
    xs = [0, 0.5, 1, 9, 9.5, 1.5, 2, 20, 3.5, 3.6, 30, 28, 5]
    pdf = pd.DataFrame({"scene_id": 1, "frame_no": range(len(xs)), "cx": np.array(xs, float), "cy": 0.0,
                        "cz": 0.0, "host_mono_ns": 0})
    kept, want = None, []
    for i, x in enumerate(xs):
        if kept is None or abs(x - kept) <= 2.0:
            kept = x
            want.append(i)
    got = align.drop_jumps(spark.createDataFrame(pdf)).toPandas()["frame_no"]
    assert sorted(got) == want


def test_gravity_of_planar_walk(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(x), float(y), float(z)) for x, y, z in
            np.c_[rng.uniform(0, 4, 60), rng.uniform(0, 4, 60), rng.normal(1.5, 0.01, 60)]]
    zero, one = F.lit(0.0), F.lit(1.0)
    poses = spark.createDataFrame(rows, "scene_id long, x double, y double, z double").withColumn(
        "pose", g.make_pose((one, zero, zero, zero, zero, one, zero, -one, zero),
                            (-F.col("x"), -F.col("z"), F.col("y"))))
    v = align.gravity(poses).collect()[0].gravity
    assert abs(v.gz) > 0.999 and v.gz > 0


def _kept_by_loop(track):
    kept, out = None, []
    for row in track.sort_values("frame_no").itertuples():
        here = np.array([row.cx, row.cy, row.cz], float)
        if kept is None or np.sqrt(((here - kept) ** 2).sum()) <= 2.0:
            kept = here
            out.append((row.scene_id, row.frame_no))
    return out


def test_jump_filter_equals_loop(spark):
    rng = np.random.default_rng(5)
    parts = []
    for scene in range(12):
        n = int(rng.integers(1, 260))
        steps = rng.normal(0, 0.6, (n, 3))
        places = np.cumsum(steps, axis=0) + rng.choice([0, 0, 0, 6, -9], n)[:, None]
        no = np.sort(rng.choice(20_000 if scene % 2 else 300, n, replace=False))
        track = pd.DataFrame(places, columns=["cx", "cy", "cz"])
        if scene == 3:
            track.loc[5:9, "cy"] = None
        if scene == 4:
            track.loc[0, "cx"] = None
        parts.append(track.assign(scene_id=scene, frame_no=no, host_mono_ns=0))
    want = [pair for part in parts for pair in _kept_by_loop(part)]
    track = spark.createDataFrame(pd.concat(parts)).withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("cx", "cy", "cz")})
    got = [(r.scene_id, r.frame_no) for r in align.drop_jumps(track).select("scene_id", "frame_no").collect()]
    assert sorted(got) == sorted(want)
    assert align.drop_jumps(track.limit(0)).count() == 0


def test_rays_by_cells_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    low = rng.uniform(-30, 30, (300, 3))
    high = low + rng.uniform(0, 12, (300, 3))
    low[0], high[0] = -200, 200  # around everything
    low[1], high[1] = 1e6, 1e6 + 5  # far from everything
    boxes = [(i % 3, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(low, high))]
    boxes += [(0, 900, None, 0.0, 0.0, 1.0, 1.0, 1.0), (0, 901, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0)]
    looks = rng.normal(0, 1, (60, 3))
    looks[:5] = [[1, 0, 0], [0, -1, 0], [0, 0, 1], [0, 0, 0], [1, 1, 0]]
    rays = [(i % 3, i, *map(float, (*e, *d))) for i, (e, d) in enumerate(zip(rng.uniform(-30, 30, (60, 3)), looks))]
    objects = spark.createDataFrame(boxes, ["scene_id", "node", *g.BOX_FIELDS]).select(
        "scene_id", "node", g.make_box(*[F.col(f) for f in g.BOX_FIELDS]).alias("box"))
    views = spark.createDataFrame(rays, "scene_id long, ray long, ex double, ey double, ez double, dx double, dy double, dz double")
    views = views.select("scene_id", "ray", g.make_point(*[F.col(f"e{a}") for a in "xyz"]).alias("eye"),
                         g.make_point(*[F.col(f"d{a}") for a in "xyz"]).alias("look"))
    want = objects.filter("node < 900").join(views, "scene_id").filter(
        g.ray_hits_box(F.col("eye"), F.col("look"), F.col("box"))).select("ray", "node").collect()
    got = spatial.ray_hits(views, objects, ["scene_id"]).select("ray", "node").collect()
    assert len(want) > 60 and sorted(got) == sorted(want)
    assert spatial.ray_hits(views, objects.limit(0), ["scene_id"]).count() == 0


@pytest.mark.parametrize("bend", [0.05, -0.2, 0.0])
def test_points_by_cells_equal_all_pairs(spark, bend):
    rng = np.random.default_rng(7)
    points = [(int(i % 2), *map(float, p)) for i, p in enumerate(rng.uniform(-12, 12, (1500, 3)))]
    points += [(0, float("nan"), 0.0, 1.0), (0, float("inf"), 0.0, 1.0), (0, None, 0.0, 1.0), (1, 1e7, 1e7, 1e7)]
    turns = [np.linalg.qr(rng.normal(0, 1, (3, 3)))[0] for _ in range(8)]
    poses = [(i % 2, f"f{i}", *map(float, (*r.ravel(), *rng.uniform(-4, 4, 3)))) for i, r in enumerate(turns)]
    marks = [(i % 2, f"f{i % 8}", i, float(x), float(y), float(x + 60), float(y + 50))
             for i, (x, y) in enumerate(zip(rng.uniform(0, 580, 40), rng.uniform(0, 310, 40)))]
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    poses = spark.createDataFrame(poses, ["scene_id", "frame", *names, "tx", "ty", "tz"]).select(
        "scene_id", "frame", g.make_pose([F.col(c) for c in names], [F.col(c) for c in ("tx", "ty", "tz")]).alias("pose"))
    marks = spark.createDataFrame(marks, "scene_id long, frame string, det_id long, x1 double, y1 double, x2 double, y2 double"
                                  ).select("scene_id", "frame", "det_id", F.struct("x1", "y1", "x2", "y2").alias("bbox"))
    cloud = spark.createDataFrame(points, "scene_id long, x double, y double, z double").select(
        "scene_id", g.make_point(*map(F.col, "xyz")).alias("p"))
    lens = F.struct(F.lit(500.0).alias("f"), F.lit(320.0).alias("cx"), F.lit(180.0).alias("cy"), F.lit(bend).alias("k"))
    box = F.col("bbox")
    want = (
        lift.project_frames(cloud, poses, lens).join(marks, ["scene_id", "frame"])
        .filter((F.col("depth") > 0.1) & F.col("u").between(box.x1 - 3, box.x2 + 3) & F.col("v").between(box.y1 - 3, box.y2 + 3))
        .select("det_id", "p", "depth").collect()
    )
    got = lift.points_in_detections(marks, cloud, poses, lens).select("det_id", "p", "depth").collect()
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_plane_votes_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    cloud = rng.uniform(0, 3, (9000, 3)).round(2)
    cloud[:3000] = cloud[0]  # one place holds a third of all points
    rows = [(int(i % 7 == 0), *map(float, p)) for i, p in enumerate(cloud)] + [(1, None, 0.0, 0.0)]
    slants = rng.normal(0, 1, (25, 3))
    slants /= np.linalg.norm(slants, axis=1)[:, None]
    sheets = [(s, h, *map(float, n), -1.0) for s in (0, 1, 5) for h, n in enumerate(slants)]
    points = spark.createDataFrame(rows, "scene_id long, x double, y double, z double").select(
        "scene_id", g.make_point(*map(F.col, "xyz")).alias("p"))
    sheets = spark.createDataFrame(sheets, "scene_id long, h long, nx double, ny double, nz double, d double")
    want = points.join(sheets, "scene_id").groupBy("scene_id", "h").agg(
        F.count_if(planes._distance() <= 0.1).alias("n_inliers")).collect()
    got = planes.plane_votes(points, sheets, 0.1).select("scene_id", "h", "n_inliers").collect()
    assert len(want) == 50 and sorted(got) == sorted(want)
    assert planes.plane_votes(points.limit(0), sheets, 0.1).count() == 0


def test_islands_that_go_on_over_batches_are_walked_whole():
    rng = np.random.default_rng(7)
    n = 90
    rows = pd.DataFrame({
        "scene_id": np.repeat([1, 2, 2], 30), "match": np.repeat(["cup", "cup", "mug"], 30), "_ix": 0,
        "ord": np.tile(np.arange(30), 3), "class": np.repeat(["cup", "cup", "mug"], 30), "tight": False,
        **{a: rng.uniform(0, 1, n) for a in "xyz"}})
    rows["family"] = rows["class"]
    run = associate._greedy(["scene_id", "match", "_ix"], ["ord"], 0.6, 0.2)
    whole = pd.concat(run(iter([rows])), ignore_index=True)
    assert len(whole) == n and whole["first_ord"].nunique() > 1
    for size in (1, 7, 30, 45):
        parts = [rows.iloc[i:i + size] for i in range(0, n, size)]
        pd.testing.assert_frame_equal(pd.concat(run(iter(parts)), ignore_index=True), whole)


def test_instances_rolled_up_at_once_equal_those_spread(spark, monkeypatch):
    rng = np.random.default_rng(21)
    n = 600
    pdf = pd.DataFrame({
        "scene_id": rng.integers(0, 3, n), "inst": rng.integers(0, 9, n) ** 2 // 20, "frame_no": rng.integers(0, 30, n),
        "class": rng.choice(["cup", "mug"], n), "conf": rng.integers(1, 9, n) / 8, "k": np.arange(n),
        **{a: rng.integers(0, 64, n) / 16 for a in "xyz"}})
    seen = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("k") % 5 > 0, F.col("x"))).withColumn(
        "inst", F.when(F.col("k") % 50 > 0, F.col("inst"))).withColumn("box", g.make_box(
            F.col("x") - 0.5, F.col("y") - 0.5, F.col("z") - 0.5, F.col("x") + 0.5, F.col("y") + 0.5, F.col("z") + 0.5))

    def rolled(whole):
        monkeypatch.setattr(associate, "_WHOLE", whole)
        columns = ["scene_id", "inst", "n_observations", "first_no", "last_no", "evidence", "median_conf", "center", "box"]
        rows = associate.roll_up(seen, ["scene_id", "inst"], F.col("k")).select(*columns)
        return sorted(rows.selectExpr(
            "*", "transform(array(center.x, center.y, box.xmin, box.zmax), v -> round(v, 9)) AS r"
        ).drop("center", "box").collect())

    by_joins = rolled(0)
    assert len(by_joins) == 12 and rolled(1000) == by_joins and rolled(30) == by_joins


@pytest.mark.parametrize("bend", [0.0, 0.05])
def test_boxes_of_a_frame_go_in_several_rows(spark, monkeypatch, bend):
    monkeypatch.setattr(lift, "_HELD", 2)
    test_points_by_cells_equal_all_pairs(spark, bend)


def test_a_block_is_counted_by_itself():
    block = planes.pa.table({"x": [0.0, 1.0, 2.0], "y": [0.0] * 3, "z": [0.0] * 3, "w": [1, 5, 1]})
    sheets = planes.pa.table({"scene_id": [7, 7], "h": [0, 1], "nx": [1.0, 0.0], "ny": [0.0, 1.0], "nz": [0.0, 0.0],
                              "d": [-1.0, 0.0], "_block": [0, 0]})
    counted = planes._count_block(0.1)(block, sheets).to_pydict()
    assert counted["h"] == [0, 1] and counted["n"] == [5, 7]
    assert planes._count_block(0.1)(block.slice(0, 0), sheets)["n"].to_pylist() == [0, 0]
