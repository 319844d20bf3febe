"""Walls and support surfaces: planes found by scoring sampled hypotheses."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomgraph.functions import geometry as g
from roomgraph.operators.scaling import by_size, exact_quantiles, top_k
from roomgraph.session import cut_lineage

#: Points of a scene that one block of plane voting holds.
_BLOCK = 4096
#: Points of a scene up to which one task searches all its planes.
_WHOLE = 100_000


def _draw(seed: int) -> Column:
    """The order in which points are drawn; equal places follow each other."""
    return F.xxhash64(F.lit(seed), "p.x", "p.y", "p.z")


def _hypotheses(points: DataFrame, count: int, seed: int, slope: tuple[float, float]) -> DataFrame:
    """Planes through triples of points drawn by hash order, at most ``count`` per scene.

    The draw is a top-k by hash, so it is repeatable and pruned before the shuffle. ``slope`` bounds
    the upright part of the unit normal.
    """
    drawn = top_k(
        points.select("scene_id", "p"), ["scene_id"], [_draw(seed).asc(), F.asc("p")], 3 * count)
    slot = (F.col("rn") - 1) % 3
    triples = drawn.groupBy("scene_id", F.floor((F.col("rn") - 1) / 3).alias("h")).agg(
        *[F.max(F.when(slot == i, F.col("p"))).alias(f"p{i}") for i in range(3)]
    ).filter(F.col("p2").isNotNull())
    a, b, c = F.col("p0"), F.col("p1"), F.col("p2")
    u, v = [b[k] - a[k] for k in "xyz"], [c[k] - a[k] for k in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    up = F.when(n[2] < 0, -1.0).otherwise(1.0)
    return (
        triples.withColumn("_s", size)
        .filter(F.col("_s") >= 1e-9)
        .withColumns({f"n{k}": up * n[i] / F.col("_s") for i, k in enumerate("xyz")})
        .withColumn("d", -(F.col("nx") * a.x + F.col("ny") * a.y + F.col("nz") * a.z))
        .filter(F.abs("nz").between(*slope))
        .select("scene_id", "h", "nx", "ny", "nz", "d")
    )


def _distance(prefix: str = "") -> Column:
    n = [F.col(f"{prefix}n{k}") for k in "xyz"]
    return F.abs(
        n[0] * F.col("p.x") + n[1] * F.col("p.y") + n[2] * F.col("p.z") + F.col(f"{prefix}d")
    )


def _placed(points: DataFrame) -> DataFrame:
    """Points of a scene with all three coordinates."""
    return points.select("scene_id", "p").filter(
        F.col("scene_id").isNotNull() & F.col("p.x").isNotNull() & F.col("p.y").isNotNull()
        & F.col("p.z").isNotNull())


def _in_blocks(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with a block of about ``_BLOCK`` points of their scene, and the blocks of each scene as
    their number ``_blocks``; points with a null are left out.

    Equal points share a block; voting merges them before they are moved.
    """
    whole = _placed(points)
    # stored, so that Spark can split a scene that holds a large part of the points in this join
    sizes = cut_lineage(whole.groupBy("scene_id").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("_blocks")))
    spot = F.pmod(F.xxhash64("p.x", "p.y", "p.z"), F.col("_blocks"))
    return whole.join(sizes, "scene_id").withColumn("_block", spot).drop("_blocks"), sizes


#: Points that are held against all planes at a time.
_SLICE = 512
_PLANE = ["scene_id", "h", "nx", "ny", "nz", "d"]
_VOTE = "scene_id long, h long, nx double, ny double, nz double, d double, n long"


def _within(planes, points, reach: float) -> np.ndarray:
    """Which points lie within ``reach`` of which planes, a row for each plane."""
    nx, ny, nz, d = (v[:, None] for v in planes)
    x, y, z = points
    # the same sums in the same order as in _distance, so the same bits
    far = nx * x[None]
    far += ny * y[None]
    far += nz * z[None]
    far += d
    return np.abs(far, out=far) <= reach


def _count_block(reach: float):
    """Count the points of a block, each ``w`` times, on each plane of its scene."""

    def count(points: pa.Table, planes: pa.Table) -> pa.Table:
        x, y, z, weight = (points.column(c).to_numpy() for c in ("x", "y", "z", "w"))
        sheets = [planes.column(c).to_numpy() for c in ("nx", "ny", "nz", "d")]
        n = np.zeros(planes.num_rows, np.int64)
        for at in range(0, points.num_rows, _SLICE):
            part = slice(at, at + _SLICE)
            hit = _within(sheets, (x[part], y[part], z[part]), reach)
            repeated = np.flatnonzero(weight[part] > 1)
            n += np.count_nonzero(hit, axis=1) + hit[:, repeated] @ (weight[part][repeated] - 1)
        return planes.select(_PLANE).append_column("n", pa.array(n))

    return count


def plane_votes(points: DataFrame, planes: DataFrame, reach: float) -> DataFrame:
    """Points within ``reach`` of each plane of their scene, as ``n_inliers`` beside the plane.

    ``planes`` carry scene_id, h (unique in the scene), the unit normal nx, ny, nz and d; a scene has
    at most some hundreds. A block of points is held against all of them at once and gives one
    vector of counts, so no row is made for a point and a plane. Planes of scenes without points
    don't come back.
    """
    return _votes(*_in_blocks(points), planes, reach)


def _votes(points: DataFrame, sizes: DataFrame, planes: DataFrame, reach: float) -> DataFrame:
    block = ["scene_id", "_block"]
    merged = points.groupBy(*block, "p").agg(F.count(F.lit(1)).alias("w")).select(*block, "p.x", "p.y", "p.z", "w")
    asked = planes.withColumn("h", F.col("h").cast("long")).join(sizes, "scene_id").select(
        F.col("scene_id").cast("long"), *_PLANE[1:],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    # a task holds one block and its planes at a time, however many blocks it gets
    return (
        merged.groupBy(*block).cogroup(asked.groupBy(*block)).applyInArrow(_count_block(reach), _VOTE)
        .groupBy(*_PLANE).agg(F.sum("n").alias("n_inliers"))
    )


def _best_planes(
    points: DataFrame, sizes: DataFrame, planes: DataFrame, reach: float, least: int
) -> DataFrame:
    """Best-supported plane per scene (the first drawn on ties), if ``least`` points are on it."""
    votes = _votes(points, sizes, planes, reach).filter(F.col("n_inliers") >= least)
    plane = F.struct("nx", "ny", "nz", "d", "n_inliers")
    return votes.groupBy("scene_id").agg(
        F.max_by(plane, F.struct("n_inliers", -F.col("h"))).alias("best")
    ).select("scene_id", "best.*")


def _peel_large(
    points: DataFrame, rounds: int, hypotheses: int, reach: float, least: int, seed: int,
    slope: tuple[float, float],
) -> DataFrame:
    """``_peel`` round by round over all scenes at once, with the points of a scene in blocks."""
    blocks, sizes = _in_blocks(points)
    left, found = cut_lineage(blocks), []
    for no in range(rounds):
        planes = _hypotheses(left, hypotheses, seed + no, slope)
        best = cut_lineage(_best_planes(left, sizes, planes, reach, least))
        if best.isEmpty():
            break
        judged = cut_lineage(left.join(best, "scene_id").withColumn("_in", _distance() <= reach))
        found.append(judged.filter("_in").drop("_in", "_block").withColumn("plane_no", F.lit(no)))
        left = judged.filter(~F.col("_in")).select("scene_id", "p", "_block")
    if not found:
        empty = points.select("scene_id", "p").limit(0)
        return empty.withColumns(
            {c: F.lit(0.0) for c in ("nx", "ny", "nz", "d")}
            | {"n_inliers": F.lit(0).cast("long"), "plane_no": F.lit(0)}
        )
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


_PEELED = ("scene_id long, x double, y double, z double, nx double, ny double, nz double, d double, "
           "n_inliers long, plane_no int")
_PEELED_ARROW = pa.schema([
    ("scene_id", pa.int64()), *[(c, pa.float64()) for c in ("x", "y", "z", "nx", "ny", "nz", "d")],
    ("n_inliers", pa.int64()), ("plane_no", pa.int32())])


def _peel_scene(rounds: int, hypotheses: int, reach: float, least: int, slope: tuple[float, float]):
    """All rounds of ``_peel`` over one scene; ``_draw<no>`` is the order in which a round draws."""

    def drawn(order: np.ndarray, xyz: np.ndarray) -> np.ndarray:
        """The points of the triples, in the order of the draw."""
        first = np.arange(len(order))
        if len(order) > 3 * hypotheses:
            first = np.flatnonzero(order <= np.partition(order, 3 * hypotheses - 1)[3 * hypotheses - 1])
        first = first[np.lexsort((*xyz[::-1, first], order[first]))][: 3 * hypotheses]
        return first[: len(first) // 3 * 3].reshape(-1, 3).T

    def planes(xyz: np.ndarray, triples: np.ndarray) -> list[np.ndarray]:
        # the same steps in the same order as in _hypotheses, so the same bits
        a, b, c = (xyz[:, t] for t in triples)
        u, v = b - a, c - a
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        size = np.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
        up = np.where(n[2] < 0, -1.0, 1.0)
        nx, ny, nz = (up * m / size for m in n)
        d = -(nx * a[0] + ny * a[1] + nz * a[2])
        fit = (size >= 1e-9) & (np.abs(nz) >= slope[0]) & (np.abs(nz) <= slope[1])
        return [m[fit] for m in (nx, ny, nz, d)]

    def peel(scene: pa.Table) -> pa.Table:
        xyz = np.array([scene.column(c).to_numpy() for c in "xyz"])
        left, found = np.arange(scene.num_rows), []
        for no in range(rounds):
            here = xyz[:, left]
            with np.errstate(all="ignore"):
                sheets = planes(here, drawn(scene.column(f"_draw{no}").to_numpy()[left], here))
                votes = np.zeros(len(sheets[0]), np.int64)
                for at in range(0, len(left), _SLICE):
                    votes += np.count_nonzero(_within(sheets, here[:, at:at + _SLICE], reach), axis=1)
                if not len(votes) or votes.max() < least:
                    break
                best = votes.argmax()
                hit = _within([m[best:best + 1] for m in sheets], here, reach)[0]
            rows = int(votes[best])
            found.append(pa.table(
                [scene.column("scene_id").take(pa.array(left[hit])), *here[:, hit],
                 *[np.full(rows, m[best]) for m in sheets], np.full(rows, rows),
                 np.full(rows, no, np.int32)], schema=_PEELED_ARROW))
            left = left[~hit]
        return pa.concat_tables(found) if found else _PEELED_ARROW.empty_table()

    return peel


def _peel(
    points: DataFrame, rounds: int, hypotheses: int, reach: float, least: int, seed: int,
    slope: tuple[float, float],
) -> DataFrame:
    """Take the best plane of every scene, remove its points, repeat.

    Returns the inlier points with ``plane_no`` and the plane. Scenes without a plane that
    is good enough leave the loop. A scene of up to ``_WHOLE`` points is moved once and goes through
    its rounds in one call; larger ones go round by round, spread over blocks.
    """
    small, large = by_size(_placed(points), ["scene_id"], _WHOLE)
    # the draws are hashed behind the exchange, so they are not moved
    scenes = small.repartition("scene_id").select(
        F.col("scene_id").cast("long"), "p.x", "p.y", "p.z",
        *[_draw(seed + no).alias(f"_draw{no}") for no in range(rounds)])
    out = scenes.groupBy("scene_id").applyInArrow(
        _peel_scene(rounds, hypotheses, reach, least, slope), _PEELED)
    out = out.select("scene_id", g.make_point(*map(F.col, "xyz")).alias("p"),
                     "nx", "ny", "nz", "d", "n_inliers", "plane_no")
    if large is not None:
        out = out.unionByName(_peel_large(large, rounds, hypotheses, reach, least, seed, slope))
    # stored, as its extents read it more than once
    return cut_lineage(out)


def _extent(inliers: DataFrame) -> DataFrame:
    """Axis-aligned extent of each plane, not below the floor."""
    p, keys = F.col("p"), ["scene_id", "plane_no"]
    middle = exact_quantiles(inliers.select(*keys, p.z.alias("_z")), keys, {"top_z": ("_z", 0.5)})
    return inliers.groupBy(*keys).agg(
        *[F.min(p[a]).alias(f"{a}min") for a in "xyz"],
        *[F.max(p[a]).alias(f"{a}max") for a in "xyz"],
        F.first(F.struct("nx", "ny", "nz")).alias("normal"),
        F.count(F.lit(1)).alias("n_inliers"),
    ).withColumn("zmin", F.greatest(F.lit(0.0), F.col("zmin"))).join(middle, keys)


def walls(points: DataFrame, hypotheses: int = 500, rounds: int = 6) -> DataFrame:
    """Upright planes between floor and ceiling, as anchors."""
    band = points.filter((F.col("p.z") > 0.3) & (F.col("p.z") < 3.0))
    upright = (0.0, math.sin(math.radians(20.0)))
    planes = _extent(_peel(band, rounds, hypotheses, 0.08, 50, 2, upright))
    return planes.select(
        "scene_id",
        F.concat(F.lit("wall_"), F.col("plane_no")).alias("anchor_id"),
        F.col("plane_no").cast("long").alias("ord"),
        F.lit("wall").alias("category"),
        g.make_box(*[F.col(f) for f in g.BOX_FIELDS]).alias("box"),
        "normal",
        "n_inliers",
        F.least(F.lit(1.0), F.col("n_inliers") / 300.0).alias("confidence"),
    )


def support_surfaces(points: DataFrame, hypotheses: int = 400, rounds: int = 8) -> DataFrame:
    """Level planes at furniture height, as thin slabs."""
    band = points.filter((F.col("p.z") >= 0.2) & (F.col("p.z") <= 2.2))
    level = (math.cos(math.radians(15.0)), math.inf)
    planes = _extent(_peel(band, rounds, hypotheses, 0.05, 40, 3, level))
    return support_summary(planes)


def support_summary(planes: DataFrame) -> DataFrame:
    top = F.col("top_z")
    return planes.select(
        "scene_id",
        F.concat(F.lit("support_"), F.col("plane_no")).alias("support_id"),
        F.col("plane_no").cast("long").alias("ord"),
        F.lit("support_surface").alias("category"),
        "top_z",
        g.make_box(F.col("xmin"), F.col("ymin"), top - 0.05, F.col("xmax"), F.col("ymax"),
                   top + 0.03).alias("box"),
        "n_inliers",
        F.array(
            F.bround(F.col("xmax") - F.col("xmin"), 2), F.bround(F.col("ymax") - F.col("ymin"), 2)
        ).alias("extent_xy"),
    )
