"""Upright metric frame of a reconstruction, pose tables and trajectory checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roomgraph.functions import geometry as g
from roomgraph.operators.scaling import (
    exact_quantiles,
    positions,
    running_total,
    with_previous,
)
from roomgraph.session import cut_lineage

_AXES = "xyz"


def camera_centers(poses: DataFrame) -> DataFrame:
    return poses.withColumn("center", g.camera_center(F.col("pose")))


@F.pandas_udf(T.StructType([T.StructField("g" + a, T.DoubleType()) for a in _AXES]))
def _thinnest_axis(sums: pd.DataFrame) -> pd.DataFrame:
    """Direction of least spread, turned towards the mean camera down-axis."""
    cov = np.empty((len(sums), 3, 3))
    for i, a in enumerate(_AXES):
        for j, b in enumerate(_AXES):
            cov[:, i, j] = sums["c" + "".join(sorted(a + b))]
    axis = np.linalg.eigh(cov)[1][:, :, 0] if len(sums) else np.empty((0, 3))
    down = sums[["dx", "dy", "dz"]].to_numpy()
    axis = np.where((axis * down).sum(axis=1, keepdims=True) < 0, -axis, axis)
    return pd.DataFrame(axis, columns=["gx", "gy", "gz"])


def gravity(poses: DataFrame) -> DataFrame:
    """One axis per scene from the camera positions: six covariances, then a 3x3 eigenproblem."""
    c = camera_centers(poses)
    pairs = [(a, b) for i, a in enumerate(_AXES) for b in _AXES[i:]]
    spread = c.groupBy("scene_id").agg(
        *[F.covar_pop(f"center.{a}", f"center.{b}").alias(f"c{a}{b}") for a, b in pairs],
        *[F.avg(f"pose.r1{i}").alias(f"d{a}") for i, a in enumerate(_AXES)],
    )
    axis = _thinnest_axis(F.struct(*[f"c{a}{b}" for a, b in pairs], "dx", "dy", "dz"))
    return spread.select("scene_id", axis.alias("gravity"))


def floor_heights(
    point_heights: DataFrame, camera_heights: DataFrame, bins: int = 200, min_points: int = 50
) -> DataFrame:
    """Densest height bin in the lower half of everything below the lowest camera.

    Both tables carry scene_id and ``h``. Scenes with too few points below have no row.
    """
    cams = exact_quantiles(camera_heights, ["scene_id"], {"cam_median": ("h", 0.5)}).join(
        camera_heights.groupBy("scene_id").agg(F.min("h").alias("cam_min")), "scene_id"
    )
    below = point_heights.join(cams, "scene_id").filter(F.col("h") < F.col("cam_min") - 1e-6)
    extent = below.groupBy("scene_id").agg(
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n_below")
    ).filter(F.col("n_below") >= min_points)
    span = F.col("hi") - F.col("lo")
    spot = F.when(
        span > 0,
        F.least(F.lit(bins - 1), F.floor((F.col("h") - F.col("lo")) * bins / span)),
    ).otherwise(F.lit(bins // 2))
    counts = (
        below.join(extent, "scene_id")
        .withColumn("bin", spot)
        .filter(F.col("bin") <= bins // 2)
        .groupBy("scene_id", "lo", "hi", "cam_median", "cam_min", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = Window.partitionBy("scene_id").orderBy(F.desc("n"), F.asc("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        counts.withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") == 1)
        .select(
            "scene_id", "cam_median", "bin", F.col("n").alias("n_floor"),
            (F.col("lo") + (F.col("bin") + 0.5) * width).alias("floor_h"),
        )
    )


def alignments(points: DataFrame, poses: DataFrame, camera_height: float = 1.55) -> DataFrame:
    """``alignment`` struct (rotation, origin, scale) per scene; implausible scenes drop out."""
    down = gravity(poses)
    gx, gy, gz = (F.col(f"gravity.g{a}") for a in _AXES)

    def along(p):
        return p.x * gx + p.y * gy + p.z * gz

    raised = points.join(down, "scene_id").select("scene_id", "p", along(F.col("p")).alias("h"))
    cams = camera_centers(poses).join(down, "scene_id").select(
        "scene_id", along(F.col("center")).alias("h")
    )
    floor = floor_heights(raised, cams)
    scale = F.lit(camera_height) / (F.col("cam_median") - F.col("floor_h"))
    scaled = floor.filter(F.col("cam_median") - F.col("floor_h") > 0.05).withColumn(
        "scale", scale
    ).filter((F.col("scale") > 0.001) & (F.col("scale") < 1000.0))
    origin = (
        raised.join(scaled.select("scene_id", "floor_h"), "scene_id")
        .groupBy("scene_id")
        .agg(F.min_by("p", F.struct(F.abs(F.col("h") - F.col("floor_h")), "p")).alias("origin"))
    )
    # two horizontal axes from a reference axis that is not close to gravity
    flat = F.abs(gx) > 0.9
    rx, ry = F.when(flat, 0.0).otherwise(1.0), F.when(flat, 1.0).otherwise(0.0)
    ux, uy, uz = -gz * ry, gz * rx, gx * ry - gy * rx
    norm = F.sqrt(ux * ux + uy * uy + uz * uz)
    u = [ux / norm, uy / norm, uz / norm]
    v = [gy * u[2] - gz * u[1], gz * u[0] - gx * u[2], gx * u[1] - gy * u[0]]
    named = dict(zip(g.ROTATION_FIELDS, (*u, *v, gx, gy, gz)))
    named |= {"o" + a: F.col(f"origin.{a}") for a in _AXES} | {"scale": F.col("scale")}
    return (
        scaled.join(origin, "scene_id")
        .join(down, "scene_id")
        .select(
            "scene_id", "n_floor", "floor_h",
            F.struct(*[c.alias(n) for n, c in named.items()]).alias("alignment"),
        )
    )


def align_points(points: DataFrame, aligned: DataFrame) -> DataFrame:
    return points.join(aligned.select("scene_id", "alignment"), "scene_id").withColumn(
        "p", g.align_point(F.col("p"), F.col("alignment"))
    ).drop("alignment")


def align_poses(poses: DataFrame, aligned: DataFrame) -> DataFrame:
    return poses.join(aligned.select("scene_id", "alignment"), "scene_id").withColumn(
        "pose", g.align_pose(F.col("pose"), F.col("alignment"))
    ).drop("alignment")


def tracked_points(points: DataFrame, min_track: int = 3) -> DataFrame:
    return points.filter(F.col("track_len") >= min_track)


def main_model(images: DataFrame) -> DataFrame:
    """Keep, per scene, the model with most registered images (the lower id on ties)."""
    counts = images.groupBy("scene_id", "model").agg(F.count(F.lit(1)).alias("n_images"))
    best = counts.groupBy("scene_id").agg(
        F.max_by("model", F.struct("n_images", -F.col("model"))).alias("model"),
        F.max("n_images").alias("n_images"),
    )
    return best


def manifest_rows(extracted: DataFrame, timeline: DataFrame) -> DataFrame:
    """Extracted frame i of M takes timeline row round(i (N-1) / (M-1)), half to even.

    ``extracted`` carry scene_id and frame_no, ``timeline`` scene_id, row_no and its values.
    Without a timeline the frames stay with empty values; a single frame takes row 0.
    """
    frames = positions(extracted, ["scene_id"], "frame_no").withColumn(
        "extract_index", F.col("pos") - 1
    )
    m = extracted.groupBy("scene_id").agg(F.count(F.lit(1)).alias("m"))
    n = timeline.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    rows = positions(timeline, ["scene_id"], "row_no").withColumn("_at", F.col("pos") - 1)
    at = F.when(F.col("m") == 1, F.lit(0)).otherwise(
        F.bround(
            F.col("extract_index") * (F.col("n") - 1)
            / F.greatest(F.col("m") - 1, F.lit(1)).cast("double"),
            0,
        ).cast("long")
    )
    placed = frames.drop("pos").join(m, "scene_id").join(n, "scene_id", "left").withColumn("_at", at)
    return placed.join(rows.drop("pos"), ["scene_id", "_at"], "left").drop("_at", "m", "n")


def registered_poses(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows whose frame was registered."""
    return manifest.join(images, ["scene_id", "frame"])


def registration_rate(manifest: DataFrame, images: DataFrame) -> DataFrame:
    known = images.select("scene_id", "frame", F.lit(True).alias("hit"))
    return (
        manifest.join(known, ["scene_id", "frame"], "left")
        .groupBy("scene_id")
        .agg(F.count("hit").alias("registered"), F.count(F.lit(1)).alias("total"))
    )


# ---- trajectories --------------------------------------------------------------------------------


def steps(track: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Each station with its distance and time from the one before (frame_no order)."""
    before = {"cx": "_px", "cy": "_py", "cz": "_pz", "host_mono_ns": "_pt", "frame_no": "_pf"}
    linked = with_previous(track, ["scene_id"], "frame_no", before, bucket)
    d = [F.col(c) - F.col(p) for c, p in (("cx", "_px"), ("cy", "_py"), ("cz", "_pz"))]
    first = F.col("_pf").isNull()
    return linked.withColumns(
        {
            "step_m": F.when(~first, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])),
            "dt_s": (F.col("host_mono_ns") - F.col("_pt")) / 1e9,
        }
    ).drop("_px", "_py", "_pz", "_pt", "_pf")


def trajectory_stats(track: DataFrame, fallback_dt: float = 1.0 / 15.0) -> DataFrame:
    """Length, median speed, extent, largest jump, quaternion and clock checks per scene.

    Speed uses the median time step of the scene (1/15 s without clocks).
    """
    moved = steps(track)
    middle = exact_quantiles(
        moved, ["scene_id"], {"_step": ("step_m", 0.5), "_dt": ("dt_s", 0.5)}
    )
    unit = F.abs(F.sqrt(
        F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2 + F.col("qw") ** 2) - 1.0) < 1e-3
    # the first station decides whether the clock is used
    clocked = F.min_by("host_mono_ns", "frame_no").isNotNull()
    sums = moved.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum("step_m").alias("length_m"),
        F.max("step_m").alias("max_jump_m"),
        *[(F.max(f"c{a}") - F.min(f"c{a}")).alias(f"extent_{a}") for a in _AXES],
        F.every(unit).alias("quaternions_ok"),
        F.count("host_mono_ns").alias("timestamps"),
        clocked.alias("_clocked"),
    )
    dt = F.when(F.col("_clocked"), F.coalesce("_dt", F.lit(fallback_dt))).otherwise(
        F.lit(fallback_dt)
    )
    return (
        sums.join(middle, "scene_id")
        .withColumn("median_speed", F.try_divide(F.col("_step"), dt))
        .drop("_step", "_dt", "_clocked")
    )


#: First look-ahead of a run's end, in frame numbers, and its growth from one try to the next.
_AHEAD, _AHEAD_GROWTH = 64, 16


def _next_stations(ends: DataFrame, stations: DataFrame, max_jump: float) -> DataFrame:
    """For each run's end the earliest later station within ``max_jump``, if there is one.

    Ends look ahead in growing stretches of frame numbers: one try is an equi-join on the scene, a
    stretch and a cell of space, so no key holds more of a scene than that. An end that has found
    its station, or has looked past the scene's last one, takes no part in the next try.
    """
    cell = max_jump * 1.001  # a hair over the reach, against rounding
    at = {f"_g{a}": F.floor(F.col(f"c{a}") / F.lit(cell)) for a in _AXES}
    placed = stations.select("scene_id", "run", "frame_no", *[f"c{a}" for a in _AXES]).withColumns(at)
    last = stations.groupBy("scene_id").agg(F.max("frame_no").alias("_last_no"))
    open_ends, links, ahead = ends.join(last, "scene_id"), None, _AHEAD
    while True:
        open_ends = cut_lineage(open_ends.filter(F.col("end_no") < F.col("_last_no")))
        if open_ends.isEmpty():
            break
        stretch = F.floor(F.col("end_no") / F.lit(ahead))
        asked = open_ends.withColumn("_stretch", F.explode(F.array(stretch, stretch + 1)))
        for a in _AXES:
            own = F.floor(F.col(f"l{a}") / F.lit(cell))
            asked = asked.withColumn(f"_g{a}", F.explode(F.sequence(own - 1, own + 1)))
        there = placed.withColumn("_stretch", F.floor(F.col("frame_no") / F.lit(ahead))).select(
            "scene_id", "_stretch", *at, F.col("run").alias("next_run"), "frame_no",
            *[f"c{a}" for a in _AXES])
        d = [F.col(f"c{a}") - F.col(f"l{a}") for a in _AXES]
        found = cut_lineage(
            asked.join(there, ["scene_id", "_stretch", *at])
            .filter((F.col("frame_no") > F.col("end_no"))
                    & (F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= max_jump))
            .groupBy("scene_id", "run")
            .agg(F.min(F.struct("frame_no", "next_run")).alias("_m"))
            .select("scene_id", "run", F.col("_m.next_run").alias("next_run"),
                    F.col("_m.frame_no").alias("entry_no"))
        )
        links = found if links is None else links.unionByName(found)
        seen_to = (F.floor(F.col("end_no") / F.lit(ahead)) + 2) * F.lit(ahead) - 1
        open_ends = open_ends.join(found, ["scene_id", "run"], "left_anti").filter(
            seen_to < F.col("_last_no"))
        ahead *= _AHEAD_GROWTH
    if links is None:
        empty = ends.select("scene_id", "run", F.col("run").alias("next_run"),
                            F.col("end_no").alias("entry_no"))
        return empty.limit(0)
    return links


def _on_the_way(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Runs reached from each scene's first one along ``links``, by pointer doubling.

    After k rounds the first 2^k runs of a way are known and each pointer spans 2^k links.
    """
    reached, fresh = roots, roots
    jump = links.select("scene_id", "run", F.col("next_run").alias("far"))
    while True:
        # all known runs jump: those of the first 2^k reach the next 2^k
        fresh = cut_lineage(
            reached.join(jump, ["scene_id", "run"]).select("scene_id", F.col("far").alias("run")))
        if fresh.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(fresh))
        onward = jump.select("scene_id", F.col("run").alias("far"), F.col("far").alias("_far"))
        jump = cut_lineage(
            jump.join(onward, ["scene_id", "far"]).select("scene_id", "run", F.col("_far").alias("far")))


def drop_jumps(track: DataFrame, max_jump: float = 2.0, bucket: int = 100_000) -> DataFrame:
    """Drop stations farther than ``max_jump`` from the last *kept* station (frame_no order).

    A scene is first cut into runs of short steps: once a station of a run is kept, the rest of the
    run is, and the station kept after its end is the earliest later one within reach. These links
    between runs are found by joins on cells; pointer doubling from the scene's first run then
    tells in a logarithm of rounds which runs are entered, and a run is kept from where it is
    entered. No scene is walked in one task. A station without coordinates is dropped, unless it is
    the first, after which nothing follows.
    """
    linked = steps(track, bucket).withColumn(
        "_head", F.coalesce(F.col("step_m") > max_jump, F.lit(True)).cast("long")
    )
    stations = cut_lineage(
        running_total(linked, ["scene_id"], "frame_no", "_head", bucket, "run").drop(
            "_head", "step_m", "dt_s"
        )
    )
    at = F.struct("cx", "cy", "cz")
    ends = stations.groupBy("scene_id", "run").agg(
        F.max("frame_no").alias("end_no"), F.max_by(at, "frame_no").alias("l"),
    ).select("scene_id", "run", "end_no", *[F.col(f"l.c{a}").alias(f"l{a}") for a in _AXES])
    links = cut_lineage(_next_stations(ends, stations, max_jump))
    roots = cut_lineage(stations.groupBy("scene_id").agg(F.min("run").alias("run")))
    reached = _on_the_way(links, roots)
    entered = links.join(reached, ["scene_id", "run"]).select(
        "scene_id", F.col("next_run").alias("run"), "entry_no")
    first = roots.withColumn("entry_no", F.lit(None).cast(links.schema["entry_no"].dataType))
    return (
        stations.join(entered.unionByName(first), ["scene_id", "run"])
        .filter(F.coalesce(F.col("frame_no") >= F.col("entry_no"), F.lit(True)))
        .drop("run", "entry_no")
    )
