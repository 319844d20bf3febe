"""Evidence of instances, work lists for labelling, and the combined memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.functions import geometry as g
from roomgraph.functions import words as w
from roomgraph.operators.assemble import best_detections


def fill_evidence(instances: DataFrame, detections: DataFrame, least_px: float = 4.0) -> DataFrame:
    """Replace missing or too narrow evidence by the best detection of the first frame.

    ``instances`` carry class, first_frame and ``evidence`` (frame, conf, bbox), which stays
    where the first frame has no detection of the class.
    """
    best = best_detections(detections).select(
        "scene_id", "class", F.col("frame").alias("first_frame"),
        F.struct(F.col("frame").alias("frame"), F.col("best.conf").alias("conf"),
                 F.col("best.bbox").alias("bbox")).alias("_best"),
    )
    e = F.col("evidence")
    usable = (
        e.isNotNull() & (F.coalesce(e.frame, F.lit("")) != "") & e.bbox.isNotNull()
        & (e.bbox.x2 - e.bbox.x1 >= least_px)
    )
    return (
        instances.join(best, ["scene_id", "class", "first_frame"], "left")
        .withColumn(
            "evidence",
            F.when(F.coalesce(usable, F.lit(False)), e).otherwise(F.coalesce("_best", "evidence")),
        )
        .drop("_best")
    )


def crops(evidence: DataFrame, margin: int = 12, least_px: int = 8) -> DataFrame:
    """Pixel rectangles to cut out: grown, clipped to the image, too small ones dropped.

    ``evidence`` carry bbox, width and height.
    """
    cut = g.crop_box(F.col("bbox"), F.col("width"), F.col("height"), margin)
    c = F.col("crop")
    return evidence.withColumn("crop", cut).filter(
        (c.x2 - c.x1 >= least_px) & (c.y2 - c.y1 >= least_px)
    )


def with_cached_labels(items: DataFrame, cache: DataFrame, key: str = "crop_key") -> DataFrame:
    """Labels already known for an item; null where a labeller still has to be asked."""
    return items.join(cache.select(key, "name", "color"), key, "left")


def label_work(items: DataFrame, cache: DataFrame, key: str = "crop_key") -> DataFrame:
    """Items without a cache entry, once per key: the work list for a labeller."""
    return items.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def combined_memory(instances: DataFrame, descriptions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Instances under their agreed name (else the class word) together with confirmed nodes.

    ``descriptions`` carry instance_id, said_name, said_color and agreed; ``confirmed``
    candidate_id, name, color, sources, confidence, center and label_hint.
    """
    agreed = F.coalesce("agreed", F.lit(False))
    name = F.when(agreed, F.col("said_name")).otherwise(w.zh_label(F.col("class")))
    seen = instances.join(
        descriptions.select("scene_id", "instance_id", "said_name", "said_color", "agreed"),
        ["scene_id", "instance_id"], "left",
    ).select(
        "scene_id", F.col("instance_id").alias("node_id"),
        F.coalesce(F.nullif(name, F.lit("")), "class").alias("name"),
        F.when(agreed, F.col("said_color")).otherwise("").alias("color"),
        F.lit("instance").alias("source"),
        F.coalesce("median_conf", F.lit(0.5)).alias("confidence"),
        "center", F.col("class").alias("label_hint"), "ord",
    )
    learned = confirmed.select(
        "scene_id", F.col("candidate_id").alias("node_id"), "name", "color",
        F.coalesce(F.get("sources", F.lit(0)), F.lit("multi_view")).alias("source"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "center", "label_hint",
        (F.col("ord") + (1 << 40)).alias("ord"),
    )
    return seen.unionByName(learned)
