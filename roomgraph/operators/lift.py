"""From 2-D detections to 3-D observations, by sparse points or by depth samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.functions import geometry as g
from roomgraph.operators.spatial import LEAF, cells_met, with_leaf

_PIXEL_CELL = 64
_HELD = 64  # boxes of a frame that go with one of its rows
DETECTION = ["scene_id", "det_id"]


def with_poses(detections: DataFrame, poses: DataFrame) -> DataFrame:
    """Detections of frames that have a pose."""
    return detections.join(poses.select("scene_id", "frame", "pose"), ["scene_id", "frame"])


def project_frames(points: DataFrame, frames: DataFrame, lens: Column) -> DataFrame:
    """Every point of a scene seen from every given frame, projected once.

    ``points`` carry scene_id and p, ``frames`` scene_id, frame and pose.
    """
    kept = [c for c in (*points.columns, *frames.columns) if c not in ("scene_id", "pose")]
    # everything that follows works per frame; one exchange serves all of it
    return _projected(points.join(frames, "scene_id"), kept, lens).repartition("scene_id", "frame")


def _projected(pairs: DataFrame, kept: list[str], lens: Column) -> DataFrame:
    """Image place ``u``, ``v`` and ``depth`` of the point ``p`` of each row seen from its ``pose``."""
    # One step per projection, and the result passes through a generator: filters on image
    # coordinates would otherwise be pushed under the join with every step written out anew.
    cam = g.to_camera(F.col("p"), F.col("pose"))
    floor = F.greatest(F.col("_cz"), F.lit(g.TINY))
    bent = 1.0 + lens.k * (F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    shot = F.struct(
        (lens.f * F.col("_x") * F.col("_bent") + lens.cx).alias("u"),
        (lens.f * F.col("_y") * F.col("_bent") + lens.cy).alias("v"),
        F.col("_cz").alias("depth"),
    )
    return (
        pairs.withColumns({"_cx": cam.x, "_cy": cam.y, "_cz": cam.z})
        .withColumns({"_x": F.col("_cx") / floor, "_y": F.col("_cy") / floor})
        .withColumn("_bent", bent)
        .select("scene_id", *kept, F.inline(F.array(shot)))
    )


def _step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a generator, past which Spark does not write an expression out again."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))


#: Depth below which a point is not seen, and what an image range is widened by against rounding.
_NEAREST, _HAIR = 0.1, 0.01


def _may_see(lens: Column):
    """Keep, of a frame's image boxes ``_boxes``, those a point between two corners may fall into, and
    frames with such boxes.

    Interval arithmetic along the projection: each step takes the range of the step before to a
    range that holds every value possible, so no visible point is lost.
    """

    def meets(df: DataFrame, low: dict, high: dict) -> DataFrame:
        pose, hair = F.col("pose"), F.lit(_HAIR)
        mid = g.to_camera(F.struct(*[((F.col(low[a]) + F.col(high[a])) / 2).alias(a) for a in "xyz"]), pose)
        half = [(F.col(high[a]) - F.col(low[a])) / 2 for a in "xyz"]
        reach = [sum((F.abs(pose[f"r{i}{j}"]) * half[j] for j in range(1, 3)),
                     F.abs(pose[f"r{i}0"]) * half[0]) * (1 + 1e-9) + 1e-9 for i in range(3)]
        df = _step(df, {f"_m{a}": mid[a] for a in "xyz"} | {f"_h{a}": r for a, r in zip("xyz", reach)})
        near = F.greatest(F.col("_mz") - F.col("_hz"), F.lit(_NEAREST))
        far = F.greatest(F.col("_mz") + F.col("_hz"), F.lit(_NEAREST))
        lo, hi = ({a: F.col(f"_m{a}") + sign * F.col(f"_h{a}") for a in "xy"} for sign in (-1, 1))
        df = _step(
            df.filter(F.col("_mz") + F.col("_hz") >= _NEAREST),
            {f"_lo{a}": lo[a] / F.when(lo[a] < 0, near).otherwise(far) for a in "xy"}
            | {f"_hi{a}": hi[a] / F.when(hi[a] > 0, near).otherwise(far) for a in "xy"},
        )
        least = [F.greatest(F.lit(0.0), F.col(f"_lo{a}"), -F.col(f"_hi{a}")) for a in "xy"]
        most = [F.greatest(F.abs(f"_lo{a}"), F.abs(f"_hi{a}")) for a in "xy"]
        df = _step(df, {f"_b{i}": 1.0 + lens.k * (x * x + y * y) for i, (x, y) in ((1, least), (2, most))})
        ends = {a: [lens.f * F.col(f"_{e}{a}") * F.col(b) for e in ("lo", "hi") for b in ("_b1", "_b2")] for a in "xy"}
        centre = {"x": lens.cx, "y": lens.cy}
        df = _step(df, {f"_from{a}": F.least(*ends[a]) + centre[a] - hair for a in "xy"}
                   | {f"_to{a}": F.greatest(*ends[a]) + centre[a] + hair for a in "xy"})
        inside = F.filter("_boxes", lambda b: (b.x2 >= F.col("_fromx")) & (b.x1 <= F.col("_tox"))
                          & (b.y2 >= F.col("_fromy")) & (b.y1 <= F.col("_toy")))
        return df.withColumn("_boxes", inside).filter(F.size("_boxes") > 0)

    return meets


def _pixel(value: Column) -> Column:
    return F.floor(value / F.lit(float(_PIXEL_CELL)))


def _in_cells(detections: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column) -> DataFrame:
    """A detection once for each pixel cell its image box touches."""
    return (
        detections.withColumn("_cu", F.explode(F.sequence(_pixel(x1), _pixel(x2))))
        .withColumn("_cv", F.explode(F.sequence(_pixel(y1), _pixel(y2))))
    )


def points_in_detections(
    detections: DataFrame, points: DataFrame, poses: DataFrame, lens: Column, margin: float = 3.0
) -> DataFrame:
    """Points whose image falls into the box of a detection (grown by ``margin`` pixels).

    A frame meets only the cells of space that its detections may show, and goes to each with the boxes
    that may show something of it, at most about ``_HELD`` in a row. Points are projected and held against these
    boxes where they lie, so only hits are left to move; the product of a scene's points and frames is never formed.
    """
    frame, bbox = ["scene_id", "frame"], F.col("bbox")
    grown = F.struct(
        "det_id", (bbox.x1 - margin).alias("x1"), (bbox.y1 - margin).alias("y1"),
        (bbox.x2 + margin).alias("x2"), (bbox.y2 + margin).alias("y2"))
    rows = detections.groupBy(*frame).agg(F.ceil(F.count(F.lit(1)) / _HELD).alias("_rows"))
    asked = (
        detections.select(*frame, grown.alias("b")).join(rows, frame)
        .groupBy(*frame, F.pmod(F.xxhash64("b"), F.col("_rows")).alias("_row"))
        .agg(F.collect_list("b").alias("_boxes"))
    )
    used = poses.select(*frame, "pose").join(asked.drop("_row"), frame)
    p = F.col("p")
    finite = F.abs(p.x) + F.abs(p.y) + F.abs(p.z) < float("inf")
    placed = with_leaf(points.select("scene_id", "p").filter(finite), p)
    met = cells_met(used, placed, ["scene_id"], g.make_box(*[p[a] for a in "xyz"] * 2), _may_see(lens))
    in_sight = placed.join(met.select("scene_id", *LEAF, "pose", "_boxes"), ["scene_id", *LEAF])
    shots = _projected(in_sight, ["p", "_boxes"], lens).filter(F.col("depth") > _NEAREST)
    u, v = F.col("u"), F.col("v")
    hit = F.filter("_boxes", lambda b: (u >= b.x1) & (u <= b.x2) & (v >= b.y1) & (v <= b.y2))
    return shots.select("scene_id", "p", "depth", F.inline(hit)).select("scene_id", "det_id", "p", "depth")


def foreground(hits: DataFrame, slab: float = 0.6) -> DataFrame:
    """Keep points near the closest surface of each detection."""
    closest = F.min("depth").over(Window.partitionBy(*DETECTION))
    return hits.withColumn("_z", closest).filter(F.col("depth") <= F.col("_z") + slab).drop("_z")


def robust_boxes(hits: DataFrame, min_points: int = 5) -> DataFrame:
    """Median centre and 10..90 percent box of the points of each detection."""
    cut = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    spread = hits.groupBy(*DETECTION).agg(
        F.count(F.lit(1)).alias("n_points"),
        *[F.percentile(f"p.{a}", cut).alias(f"q{a}") for a in "xyz"],
    ).filter(F.col("n_points") >= min_points)
    q = {a: F.col(f"q{a}") for a in "xyz"}
    return spread.select(
        *DETECTION,
        "n_points",
        g.make_point(q["x"][1], q["y"][1], q["z"][1]).alias("center"),
        g.make_box(q["x"][0], q["y"][0], q["z"][0], q["x"][2], q["y"][2], q["z"][2]).alias("box"),
    )


def lift_by_points(
    detections: DataFrame,
    points: DataFrame,
    poses: DataFrame,
    lens: Column,
    min_points: int = 5,
    slab: float = 0.6,
) -> DataFrame:
    """3-D observation of each detection that sees at least ``min_points`` points."""
    hits = foreground(points_in_detections(detections, points, poses, lens), slab)
    return detections.join(robust_boxes(hits, min_points), DETECTION)


def lift_by_depth(
    detections: DataFrame,
    samples: DataFrame,
    poses: DataFrame,
    lens: Column,
    min_depth: float = 0.15,
    min_samples: int = 5,
) -> DataFrame:
    """3-D observation from the median depth in the middle 45 percent of a detection.

    ``samples`` carry scene_id, frame, px, py, depth: pixels of a metric depth map.
    """
    b = F.col("bbox")
    w, h = b.x2 - b.x1, b.y2 - b.y1
    left, right = (b.x1 + 0.275 * w).cast("int"), (b.x1 + 0.725 * w).cast("int")
    top, bottom = (b.y1 + 0.275 * h).cast("int"), (b.y1 + 0.725 * h).cast("int")
    usable = (F.col("depth") > min_depth) & ~F.isnan("depth") & (F.col("depth") < float("inf"))
    pixels = samples.filter(usable).withColumns(
        {"_cu": _pixel(F.col("px")), "_cv": _pixel(F.col("py"))}
    )
    boxes = _in_cells(
        detections.select("scene_id", "frame", "det_id", "bbox"), left, top, right, bottom
    )
    depths = (
        pixels.join(boxes, ["scene_id", "frame", "_cu", "_cv"])
        .filter((F.col("px") >= left) & (F.col("px") < right))
        .filter((F.col("py") >= top) & (F.col("py") < bottom))
        .groupBy(*DETECTION)
        .agg(F.count(F.lit(1)).alias("_n"), F.median("depth").alias("depth_m"))
        .filter(F.col("_n") >= min_samples)
        .drop("_n")
    )
    d = F.col("depth_m")
    width, height = w / lens.f * d, h / lens.f * d
    thick = F.greatest(F.lit(0.05), F.least(F.lit(0.6), 0.15 * F.greatest(width, height)))
    center = g.back_project((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, d, F.col("pose"), lens)
    c, half = F.col("center"), (width / 2, F.greatest(height / 2, F.lit(0.1)), thick / 2)
    return (
        with_poses(detections, poses)
        .join(depths, DETECTION)
        .withColumn("center", center)
        .withColumn(
            "box",
            g.make_box(c.x - half[0], c.y - half[1], c.z - half[2],
                       c.x + half[0], c.y + half[1], c.z + half[2]),
        )
        .drop("pose")
    )


def depth_scales(
    samples: DataFrame, width: int = 640, height: int = 360, min_view: int = 20, min_valid: int = 10
) -> DataFrame:
    """Factor from inverse depth to metres per frame.

    ``samples`` carry scene_id, frame, u, v, depth (metric) and disp (inverse depth there).
    The factor is the median of depth times disp inside its 10..90 percent range, null where
    too few points are seen.
    """
    keys = ["scene_id", "frame"]
    seen = samples.filter(
        (F.col("u") >= 1) & (F.col("u") < width - 1) & (F.col("v") >= 1)
        & (F.col("v") < height - 1) & (F.col("depth") > 0.2)
    )
    valid = F.col("disp") > 1e-4
    ratios = seen.withColumn("ratio", F.when(valid, F.col("depth") * F.col("disp")))
    bounds = ratios.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seen"), F.count("ratio").alias("n_valid"),
        F.percentile("ratio", F.array(F.lit(0.1), F.lit(0.9))).alias("_q"),
    )
    enough = (F.col("n_seen") > min_view) & (F.col("n_valid") >= min_valid)
    inner = (
        ratios.join(bounds.filter(enough), keys)
        .filter((F.col("ratio") >= F.col("_q")[0]) & (F.col("ratio") <= F.col("_q")[1]))
        .groupBy(*keys)
        .agg(F.median("ratio").alias("scale"))
    )
    frames = samples.select(*keys).distinct()
    return (
        frames.join(bounds.drop("_q"), keys, "left")
        .join(inner, keys, "left")
        .select(*keys, F.coalesce("n_seen", F.lit(0)).alias("n_seen"),
                F.when(F.col("scale") > 0, F.col("scale")).alias("scale"))
    )
