"""Typed relations of a scene: on, above, near, in, contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.fixed_values import (
    CONF_ABOVE,
    CONF_IN,
    CONF_NEAR,
    CONF_ON_OBJECT,
    CONF_ON_SUPPORT,
)
from roomgraph.functions.geometry import box_center, footprint_overlap, make_box
from roomgraph.operators.scaling import BUCKET, CONTEXT, prefix_top, shuffled
from roomgraph.operators.spatial import footprint_pairs, near_pairs, pair_box

SCENE = ["scene_id"]


# ---- predicates ---------------------------------------------------------------------------


def is_on(child: Column, support: Column, z_tol: float = 0.05, overlap: float = 0.15) -> Column:
    return (F.abs(child.zmin - support.zmax) <= z_tol) & (
        footprint_overlap(child, support) >= overlap
    )


def vertical_order(a: Column, b: Column, margin: float = 0.02) -> Column:
    """``above``, ``below`` or null by the middle heights."""
    za, zb = box_center(a).z, box_center(b).z
    return F.when(za - zb > margin, "above").when(zb - za > margin, "below")


def is_near(a: Column, b: Column, reach: float = 1.0) -> Column:
    ca, cb = box_center(a), box_center(b)
    dx, dy, dz = ca.x - cb.x, ca.y - cb.y, ca.z - cb.z
    return F.sqrt(dx * dx + dy * dy + dz * dz) <= reach


def contains(outer: Column, item: Column, margin: float = 0.0) -> Column:
    return (
        (item.xmin >= outer.xmin - margin)
        & (item.ymin >= outer.ymin - margin)
        & (item.xmax <= outer.xmax + margin)
        & (item.ymax <= outer.ymax + margin)
        & (item.zmin >= outer.zmin - margin)
        & (item.zmax <= outer.zmax + margin)
    )


def rests_on_support(box: Column, support: Column, top_z: Column, z_tol: float = 0.12) -> Column:
    return (F.abs(box.zmin - top_z) <= z_tol) & (footprint_overlap(box, support) >= 0.15)


# ---- edges --------------------------------------------------------------------------------
# Objects carry scene_id, ord, node_id, label, box; supports scene_id, support_id, box, top_z.


def _edge(subject, predicate, target, confidence) -> list[Column]:
    return [
        F.col("scene_id"),
        subject.alias("subject"),
        F.lit(predicate).alias("predicate"),
        target.alias("object"),
        F.lit(confidence).alias("confidence"),
    ]


def on_edges(objects: DataFrame, z_tol: float = 0.05) -> DataFrame:
    """Object on object. Where two thin boxes rest on each other the earlier one is on top."""
    pairs = footprint_pairs(
        objects, objects, SCENE, ["ord", "node_id"], ["ord", "node_id", "label"],
        "zmin", "zmax", z_tol,
    )
    child, support = pair_box("l"), pair_box("r")
    earlier = F.col("l_ord") < F.col("r_ord")
    return (
        pairs.filter(F.col("l_ord") != F.col("r_ord"))
        .filter(is_on(child, support, z_tol))
        .filter(earlier | ~is_on(support, child, z_tol))
        .select(
            *_edge(F.col("l_node_id"), "on", F.col("r_node_id"), CONF_ON_OBJECT),
            F.col("l_ord").alias("subject_ord"),
            F.col("r_ord").alias("object_ord"),
            F.col("r_label").alias("object_label"),
        )
    )


def near_edges(objects: DataFrame, reach: float = 1.0) -> DataFrame:
    """Earlier object near later object; the distance test is inclusive."""
    pairs = near_pairs(
        objects, SCENE, "ord", box_center(F.col("box")), reach, ["node_id", "label"]
    )
    return pairs.select(
        *_edge(F.col("a_node_id"), "near", F.col("b_node_id"), CONF_NEAR),
        F.col("a_ord").alias("subject_ord"),
        F.col("b_ord").alias("object_ord"),
        F.col("b_label").alias("object_label"),
        "distance",
    )


def support_edges(objects: DataFrame, supports: DataFrame, z_tol: float = 0.12) -> DataFrame:
    pairs = footprint_pairs(
        objects, supports, SCENE, ["ord", "node_id"], ["ord", "support_id", "top_z"],
        "zmin", "top_z", z_tol,
    )
    return pairs.filter(
        rests_on_support(pair_box("l"), pair_box("r"), F.col("r_top_z"), z_tol)
    ).select(
        *_edge(F.col("l_node_id"), "on", F.col("r_support_id"), CONF_ON_SUPPORT),
        F.col("l_ord").alias("subject_ord"),
        F.col("r_ord").alias("object_ord"),
        F.lit("support_surface").alias("object_label"),
    )


def in_room_edges(parts: DataFrame) -> DataFrame:
    """Anchors and supports are in their room (node_id, parent_id)."""
    return parts.select(*_edge(F.col("node_id"), "in", F.col("parent_id"), CONF_IN))


def contains_pairs(outer: DataFrame, items: DataFrame, margin: float = 0.0) -> DataFrame:
    """Containers and the items wholly inside them (both scene_id, node_id, box)."""
    box = F.col("box")
    grown = outer.withColumn(
        "box",
        make_box(
            box.xmin - margin, box.ymin - margin, box.zmin - margin,
            box.xmax + margin, box.ymax + margin, box.zmax + margin,
        ),
    )
    pairs = footprint_pairs(grown, items, SCENE, ["node_id"], ["node_id"])
    return (
        pairs.filter(F.col("l_node_id") != F.col("r_node_id"))
        .filter(contains(pair_box("l"), pair_box("r")))
        .select("scene_id", F.col("l_node_id").alias("container"), F.col("r_node_id").alias("item"))
    )


# ---- above, without writing every pair -------------------------------------------------------
# "above" holds for nearly every pair of a scene. It is fully described by heights, so the
# stored form is one row per object: how many objects lie more than the margin below and above.
# Pairs are spelled out only for the objects someone asks about.

_SLAB = 0.5


def _with_height(objects: DataFrame) -> DataFrame:
    return objects.withColumn("zc", box_center(F.col("box")).z)


def above_counts(objects: DataFrame, margin: float = 0.02) -> DataFrame:
    """Per object the number of objects it is above (``n_below``) and below (``n_above``)."""
    tall = _with_height(objects)
    downward = _count_lower(tall.select("scene_id", "zc"), margin, "n_below")
    upward = _count_lower(
        tall.select("scene_id", (-F.col("zc")).alias("zc")), margin, "n_above"
    ).withColumn("zc", -F.col("zc"))
    counts = shuffled(downward).join(upward, ["scene_id", "zc"])
    return shuffled(tall.select("scene_id", "ord", "node_id", "zc")).join(counts, ["scene_id", "zc"])


def _count_lower(heights: DataFrame, margin: float, name: str) -> DataFrame:
    """For each distinct height of a scene, how many rows lie more than the margin below.

    Equal heights are merged first. Inside a slab and its lower neighbour a window counts
    exactly; everything lower comes from slab totals.
    """
    levels = (
        heights.groupBy("scene_id", "zc")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn(BUCKET, F.floor(F.col("zc") / _SLAB))
    )
    places = F.array(
        F.struct(F.col(BUCKET).alias("b"), F.lit(False).alias("c")),
        F.struct((F.col(BUCKET) + 1).alias("b"), F.lit(True).alias("c")),
    )
    twice = levels.withColumn("_place", F.explode(places)).select(
        "scene_id", "zc", "_c", F.col("_place.b").alias(BUCKET), F.col("_place.c").alias(CONTEXT)
    )
    below = F.expr(
        f"sum(_c) OVER (PARTITION BY scene_id, {BUCKET} ORDER BY zc"
        f" RANGE BETWEEN UNBOUNDED PRECEDING AND {margin + 1e-12}D PRECEDING)"
    )
    two_down = Window.partitionBy("scene_id").orderBy(BUCKET).rangeBetween(
        Window.unboundedPreceding, -2
    )
    totals = (
        levels.groupBy("scene_id", BUCKET)
        .agg(F.sum("_c").alias("_b"))
        .withColumn("_far", F.coalesce(F.sum("_b").over(two_down), F.lit(0)))
        .select("scene_id", BUCKET, "_far")
    )
    return (
        twice.withColumn("_near", F.coalesce(below, F.lit(0)))
        .filter(~F.col(CONTEXT))
        .join(totals, ["scene_id", BUCKET])
        .select("scene_id", "zc", (F.col("_far") + F.col("_near")).alias(name))
    )


def above_edges(objects: DataFrame, subjects: DataFrame, margin: float = 0.02) -> DataFrame:
    """The pairs themselves, for asked-for subjects (scene_id, ord, node_id, box)."""
    asked = _with_height(subjects).select(
        "scene_id",
        F.col("ord").alias("subject_ord"),
        F.col("node_id").alias("subject"),
        F.col("zc").alias("_zs"),
    )
    return (
        _with_height(objects)
        .join(shuffled(asked), "scene_id")
        .filter(F.col("_zs") - F.col("zc") > margin)
        .select(
            *_edge(F.col("subject"), "above", F.col("node_id"), CONF_ABOVE),
            "subject_ord",
            F.col("ord").alias("object_ord"),
            F.col("label").alias("object_label"),
        )
    )


def first_below(objects: DataFrame, limit: int, margin: float = 0.02) -> DataFrame:
    """For each object the ``limit`` labels below it whose earliest objects come first, with these.

    Enough for texts, which name few labels, each once. Heights are swept in slabs, so no object
    meets another or the labels of its scene.
    """
    tall = _with_height(objects)
    tops = prefix_top(tall, SCENE, "zc", "ord", "label", limit, margin, _SLAB, "_tops")
    subjects = tall.select(
        "scene_id", "zc", F.col("node_id").alias("subject"), F.col("ord").alias("subject_ord"))
    return (
        shuffled(subjects).join(tops, ["scene_id", "zc"])
        .withColumn("_t", F.explode("_tops"))
        .select(
            "scene_id", "subject", "subject_ord", F.col("_t.l").alias("object_label"),
            F.col("_t.v").alias("object_ord"), F.lit("above").alias("predicate"),
            F.lit(CONF_ABOVE).alias("confidence"),
        )
    )
