"""Putting a scene together: nodes of the room tree, descriptions and relation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.fixed_values import PREDICATE_ZH, UNSURE
from roomgraph.functions import geometry as g
from roomgraph.functions import words as w
from roomgraph.operators import relations as rel
from roomgraph.operators.scaling import top_k

NODE_COLUMNS = [
    "scene_id", "node_id", "node_type", "label", "category", "box", "aliases", "confidence",
    "parent_id", "ord", "layer1_text", "layer2_text", "status", "center",
]


def rooms(points: DataFrame) -> DataFrame:
    """The extent of all points of a scene, standing on the floor."""
    p = F.col("p")
    extent = points.groupBy("scene_id").agg(
        *[F.min(p[a]).alias(f"{a}min") for a in "xy"],
        *[F.max(p[a]).alias(f"{a}max") for a in "xyz"],
    )
    return extent.select(
        "scene_id",
        F.lit("room_1").alias("node_id"),
        g.make_box(F.col("xmin"), F.col("ymin"), F.lit(0.0), F.col("xmax"), F.col("ymax"),
                   F.col("zmax")).alias("box"),
    )


def _filled(df: DataFrame) -> DataFrame:
    defaults = {
        "layer1_text": F.lit(""), "layer2_text": F.lit(""), "status": F.lit("active"),
        "center": F.lit(None).cast("struct<x:double,y:double,z:double>"),
        "aliases": F.array().cast("array<string>"),
        "parent_id": F.lit(None).cast("string"), "confidence": F.lit(1.0),
    }
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df.select(*NODE_COLUMNS)


def memory_nodes(
    points: DataFrame, anchors: DataFrame | None, supports: DataFrame, instances: DataFrame
) -> DataFrame:
    """Room, anchors, supports and objects of every scene as one table.

    ``ord`` keeps the order of insertion: room, anchors, supports, objects.
    """
    base = rooms(points)
    room = _filled(
        base.withColumns(
            {"node_type": F.lit("room"), "label": F.lit("室内"), "category": F.lit("indoor_scene"),
             "ord": F.lit(0).cast("long")}
        )
    )
    parent = F.lit("room_1")
    parts = [room]
    if anchors is not None:
        parts.append(
            _filled(
                anchors.select(
                    "scene_id", F.col("anchor_id").alias("node_id"), F.lit("anchor").alias("node_type"),
                    F.col("category").alias("label"), "category", "box",
                    F.coalesce("confidence", F.lit(0.9)).alias("confidence"),
                    parent.alias("parent_id"), (F.col("ord") + 1).alias("ord"),
                )
            )
        )
    parts.append(
        _filled(
            supports.select(
                "scene_id", F.col("support_id").alias("node_id"), F.lit("anchor").alias("node_type"),
                F.lit("support_surface").alias("label"), F.lit("support_surface").alias("category"),
                "box", F.lit(0.8).alias("confidence"), parent.alias("parent_id"),
                (F.col("ord") + (1 << 40)).alias("ord"),
            )
        )
    )
    family = F.coalesce("family", F.col("class"))
    known = F.coalesce("candidate_classes", F.array().cast("array<string>"))
    aliases = F.when(F.array_contains(known, F.col("class")), known).otherwise(
        F.concat(F.array("class"), known)
    )
    parts.append(
        _filled(
            instances.select(
                "scene_id", F.col("instance_id").alias("node_id"), F.lit("object").alias("node_type"),
                F.col("class").alias("label"), family.alias("category"), "box",
                aliases.alias("aliases"), F.col("median_conf").alias("confidence"),
                parent.alias("parent_id"), (F.col("ord") + (1 << 41)).alias("ord"),
            )
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def relation_texts(edges: DataFrame, limit: int = 3) -> DataFrame:
    """Outgoing relations of a node as one phrase list, best first, each wording once.

    ``edges`` carry scene_id, subject, predicate, object_label, confidence, and ``at``, the
    struct that orders equal confidences. Edges to rooms must not be among them.
    """
    worded = edges.filter(F.col("predicate").isin(*PREDICATE_ZH))
    once = worded.groupBy("scene_id", "subject", "predicate", "object_label").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), F.col("at"))).alias("key")
    )
    best = top_k(once, ["scene_id", "subject"], [F.asc("key")], limit)
    phrase = w.relation_phrase(F.col("predicate"), F.col("object_label"))
    return (
        best.groupBy("scene_id", "subject")
        .agg(F.sort_array(F.collect_list(F.struct("rn", phrase.alias("t")))).alias("_l"))
        .select(
            "scene_id",
            F.col("subject").alias("node_id"),
            F.array_join(F.transform("_l", lambda e: e.t), "；").alias("relation_text"),
        )
    )


def text_edges(objects: DataFrame, supports: DataFrame, limit: int = 3) -> DataFrame:
    """The edges relation texts draw on, in the order pairs are formed.

    Pairs of objects come before supports; within a pair on, above, near. For ``above``
    only the first ``limit`` labels are needed, as all have one confidence.
    """
    pair, place = F.lit(0), F.lit(1)
    rank = {"on": 0, "above": 1, "near": 2}

    def ordered(df: DataFrame, stage, step: int) -> DataFrame:
        return df.select(
            "scene_id", "subject", "predicate", "object_label", "confidence",
            F.struct(
                stage.alias("stage"), F.col("object_ord").alias("partner"), F.lit(step).alias("step")
            ).alias("at"),
        )

    return (
        ordered(rel.on_edges(objects), pair, rank["on"])
        .unionByName(ordered(rel.first_below(objects, limit), pair, rank["above"]))
        .unionByName(ordered(rel.near_edges(objects), pair, rank["near"]))
        .unionByName(ordered(rel.support_edges(objects, supports), place, 0))
    )


# ---- descriptions -----------------------------------------------------------------------------


def layer2_texts(observations: DataFrame, window: int = 3, agree: int = 2) -> DataFrame:
    """Stable text per node from its last ``window`` colours and sizes.

    ``observations`` carry scene_id, node_id, label, view (order), color, l_cm, w_cm, h_cm.
    The colour counts only when those last views agree, sizes are medians.
    """
    keys = ["scene_id", "node_id"]
    labels = observations.select(*keys, "label").distinct()
    last = [F.desc("view")]
    colors = (
        top_k(observations.filter(F.coalesce("color", F.lit("")) != ""), keys, last, window)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("color").alias("d"),
             F.max("color").alias("c"))
        .filter((F.col("n") >= agree) & (F.col("d") == 1))
        .select(*keys, F.col("c").alias("color"))
    )

    def mid(c: str):
        return F.bround(F.median(c), 0).cast("int").alias(c)

    sizes = (
        top_k(observations.filter(F.col("l_cm").isNotNull()), keys, last, window)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), mid("l_cm"), mid("w_cm"), mid("h_cm"))
        .filter(F.col("n") >= agree)
        .drop("n")
    )
    dims = F.array("l_cm", "w_cm", "h_cm")
    head = F.when(F.col("color").isNotNull(), F.concat("color", F.lit("的"), F.col("label")))
    size = F.when(F.col("l_cm").isNotNull(), w.size_text(dims))
    return (
        labels.join(colors, keys, "left")
        .join(sizes, keys, "left")
        .select(*keys, F.concat_ws("，", head, size).alias("layer2_text"))
    )


def latest_view_text(views: DataFrame) -> DataFrame:
    """Text of the last accepted view of each node."""
    return views.groupBy("scene_id", "node_id").agg(
        F.max_by("view_text", "view").alias("layer1_text")
    )


def evidence_frames(instances: DataFrame) -> DataFrame:
    """First, middle and last frame of an instance, one row each (``view`` 0..2)."""
    first, last = F.col("first_frame"), F.col("last_frame")
    a, b = w.frame_number(first), w.frame_number(last)
    middle = w.frame_name(a + F.floor((b - a) / 2))
    single = last.isNull() | (last == "") | (last == first)
    frames = F.when(single, F.array(first)).otherwise(F.array(first, middle, last))
    return instances.filter(F.coalesce(first, F.lit("")) != "").select(
        "*", F.posexplode(frames).alias("view", "frame")
    )


def best_detections(detections: DataFrame) -> DataFrame:
    """Most confident detection per frame and class (the earlier one on ties)."""
    return detections.groupBy("scene_id", "frame", "class").agg(
        F.max_by(F.struct("conf", "bbox", "ord"), F.struct("conf", -F.col("ord"))).alias("best")
    )


def described_views(
    instances: DataFrame, detections: DataFrame, poses: DataFrame, quality: DataFrame
) -> DataFrame:
    """Accepted views of each instance with direction, distance and the view sentence.

    ``quality`` carries scene_id, frame, ok and an optional colour of the crop; views of
    rejected frames are dropped. ``instances`` carry class, box, first and last frame.
    """
    views = evidence_frames(instances)
    ego = g.egocentric(g.box_center(F.col("box")), F.col("pose"))
    joined = (
        views.join(quality, ["scene_id", "frame"])
        .filter("ok")
        .join(best_detections(detections), ["scene_id", "frame", "class"], "left")
        .join(poses.select("scene_id", "frame", "pose"), ["scene_id", "frame"], "left")
    )
    seen = F.col("best").isNotNull() & F.col("pose").isNotNull()
    return (
        joined.withColumn("dims", g.box_dims_cm(F.col("box")))
        .withColumn("color", F.when(seen, F.col("crop_color")))
        .withColumn("ego", F.when(seen, ego))
        .withColumn(
            "view_text",
            w.view_text(w.zh_label(F.col("class")), F.col("color"), F.col("dims"),
                        w.zh_direction(F.col("ego.tag")), F.col("ego.distance")),
        )
    )


def consensus(values: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent usable value per key if it has at least max(2, half) of all rows.

    Empty, null and unsure values count towards the total only. First seen wins ties.
    """
    usable = (F.coalesce(F.col(value), F.lit("")) != "") & (F.col(value) != UNSURE)
    counts = values.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    top = top_k(counts.filter(usable), keys, [F.desc("n"), F.asc("first")], 1)
    need = F.greatest(F.lit(2), F.floor((F.col("total") + 1) / 2))
    agreed = F.coalesce(F.col("n") >= need, F.lit(False))
    return totals.join(top.select(*keys, value, "n"), keys, "left").select(
        *keys, F.when(agreed, F.col(value)).alias(value), agreed.alias("agreed"), "total"
    )


def consensus_text(name, name_ok, color, color_ok, dims):
    """Sentence from agreed name and colour, then the size."""
    head = (
        F.when(name_ok & color_ok, F.concat(color, F.lit("的"), name))
        .when(name_ok, name)
        .when(color_ok, F.concat(F.lit("颜色"), color))
    )
    return F.concat_ws("，", head, w.size_text(dims))


def dominant_colors(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Colour word per crop from the medians of its pixel samples (h, s, v on 0..255)."""
    med = samples.groupBy(*keys).agg(*[F.median(c).alias(c) for c in "hsv"])
    return med.select(*keys, w.colour_name(F.col("h"), F.col("s"), F.col("v")).alias("color"))


def last_color(observations: DataFrame) -> DataFrame:
    """Latest known colour of each node."""
    seen = observations.filter(F.coalesce("color", F.lit("")) != "")
    return seen.groupBy("scene_id", "node_id").agg(F.max_by("color", "view").alias("color"))


def objects_on(nodes: DataFrame, relations: DataFrame, supports: DataFrame) -> DataFrame:
    """Objects with an active ``on`` relation to any of the given supports."""
    resting = relations.filter((F.col("status") == "active") & (F.col("predicate") == "on")).join(
        supports.select("scene_id", F.col("node_id").alias("object")), ["scene_id", "object"],
        "left_semi",
    )
    return nodes.filter(F.col("node_type") == "object").join(
        resting.select("scene_id", F.col("subject").alias("node_id")), ["scene_id", "node_id"],
        "left_semi",
    )


def first_by_label(nodes: DataFrame) -> DataFrame:
    """Earliest inserted node of each label."""
    return nodes.groupBy("scene_id", "label").agg(F.min_by("node_id", "ord").alias("node_id"))
