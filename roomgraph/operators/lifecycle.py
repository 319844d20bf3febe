"""Changes over time: relation and node upserts, corrections, moves, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomgraph.operators.scaling import last_known, positions, top_k, with_previous

RELATION = ["scene_id", "subject", "predicate", "object"]

# ---- relations ------------------------------------------------------------------------------------


def _latest_entries(rows: DataFrame, keys: list[str], map_col: str, order: str) -> DataFrame:
    """Maps of a key merged entry by entry, the later value winning."""
    entries = rows.select(*keys, order, F.explode(map_col).alias("_k", "_v"))
    last = entries.groupBy(*keys, "_k").agg(F.max_by("_v", order).alias("_v"))
    return last.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(map_col)
    )


def upsert_relations(
    observed: DataFrame, existing: DataFrame | None = None, min_confirmations: int = 1
) -> DataFrame:
    """Fold observed relations (and the stored table) into one row per relation.

    ``observed`` carry the key, confidence, t_s, ord and view_tags. Confidence and last
    sight are maxima, first values stay, sightings are counted; a relation is active once
    it has been seen ``min_confirmations`` times.
    """
    shape = [*RELATION, "confidence", "first_ord", "first_seen_s", "last_seen_s",
             "confirmations", "view_tags"]
    fresh = observed.select(
        *RELATION, "confidence", F.col("ord").alias("first_ord"), F.col("t_s").alias("first_seen_s"),
        F.col("t_s").alias("last_seen_s"), F.lit(1).cast("long").alias("confirmations"), "view_tags",
    )
    rows = fresh if existing is None else existing.select(*shape).unionByName(fresh)
    merged = rows.groupBy(*RELATION).agg(
        F.max("confidence").alias("confidence"),
        F.min("first_ord").alias("first_ord"),
        F.min_by("first_seen_s", "first_ord").alias("first_seen_s"),
        F.max("last_seen_s").alias("last_seen_s"),
        F.sum("confirmations").alias("confirmations"),
    )
    tags = _latest_entries(rows, RELATION, "view_tags", "first_ord")
    active = F.col("confirmations") >= min_confirmations
    return (
        merged.join(tags, RELATION, "left")
        .withColumn("view_tags", F.coalesce("view_tags", F.create_map().cast("map<string,string>")))
        .withColumn("status", F.when(active, "active").otherwise("archived"))
    )


def archive_relations(relations: DataFrame, ended: DataFrame) -> DataFrame:
    """Mark active relations named in ``ended`` (key, t_s) as archived at that time."""
    stamp = ended.groupBy(*RELATION).agg(F.max("t_s").alias("_t"))
    hit = F.col("_t").isNotNull() & (F.col("status") == "active")
    return (
        relations.join(stamp, RELATION, "left")
        .withColumn("last_seen_s", F.when(hit, F.col("_t")).otherwise(F.col("last_seen_s")))
        .withColumn("status", F.when(hit, "archived").otherwise(F.col("status")))
        .drop("_t")
    )


# ---- nodes ---------------------------------------------------------------------------------------------


def touch(nodes: DataFrame, sightings: DataFrame) -> DataFrame:
    """Last sight is a maximum; last update is the time of the latest arrival, even if earlier."""
    last = sightings.groupBy("scene_id", "node_id").agg(
        F.max("t_s").alias("_max"), F.max_by("t_s", "ord").alias("_latest")
    )
    return (
        nodes.join(last, ["scene_id", "node_id"], "left")
        .withColumn("last_seen_s", F.greatest("last_seen_s", "_max"))
        .withColumn("last_updated_s", F.coalesce("_latest", "last_updated_s"))
        .drop("_max", "_latest")
    )


def ingest_objects(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Node table after a batch: new nodes as first seen, known ones updated.

    ``batch`` carry scene_id, node_id, ord, t_s, label, category, parent_id, confidence, box
    and attributes. Label, parent and confidence stay as first written; the box is the latest
    known; attributes merge entry by entry.
    """
    keys = ["scene_id", "node_id"]
    shape = [*keys, "ord", "last_ord", "label", "category", "parent_id", "confidence", "box",
             "attributes", "first_seen_s", "last_seen_s", "last_updated_s"]
    fresh = batch.select(
        *keys, "ord", F.col("ord").alias("last_ord"), "label", "category", "parent_id", "confidence",
        "box", "attributes", F.col("t_s").alias("first_seen_s"), F.col("t_s").alias("last_seen_s"),
        F.col("t_s").alias("last_updated_s"),
    )
    rows = fresh if existing is None else existing.select(*shape).unionByName(fresh)
    boxed = F.when(F.col("box").isNotNull(), F.col("last_ord"))
    first = ["label", "category", "parent_id", "confidence", "first_seen_s"]
    merged = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*first), "ord").alias("_first"),
        F.max_by("box", boxed).alias("box"),
        F.max("last_seen_s").alias("last_seen_s"),
        F.max_by("last_updated_s", "last_ord").alias("last_updated_s"),
        F.min("ord").alias("ord"),
        F.max("last_ord").alias("last_ord"),
    )
    attributes = _latest_entries(
        rows.filter(F.col("attributes").isNotNull()), keys, "attributes", "last_ord"
    )
    return (
        merged.select("*", "_first.*").drop("_first").join(attributes, keys, "left")
        .withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
        .select(*shape)
    )


def observed_rows(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of observations: the object, its support where one is named, and ``on``.

    ``observations`` carry scene_id, ord, t_s, object_name, support_name, confidence; rows without
    an object name say nothing. Nodes are named by what they are called.
    """
    said = observations.withColumns({
        "_o": F.btrim(F.coalesce("object_name", F.lit(""))),
        "_s": F.btrim(F.coalesce("support_name", F.lit("")))}).filter(F.col("_o") != "")
    parts = F.array(F.struct(F.col("_o").alias("label"), F.lit("object").alias("node_type")),
                    F.struct(F.col("_s").alias("label"), F.lit("anchor").alias("node_type")))
    nodes = said.withColumn("_p", F.explode(F.filter(parts, lambda p: p.label != ""))).select(
        "scene_id", F.concat(F.lit("seen_"), F.col("_p.label")).alias("node_id"), "_p.label",
        "_p.node_type", "confidence", "t_s", "ord")
    edges = said.filter(F.col("_s") != "").select(
        "scene_id", F.concat(F.lit("seen_"), F.col("_o")).alias("subject"), F.lit("on").alias("predicate"),
        F.concat(F.lit("seen_"), F.col("_s")).alias("object"), "confidence", "t_s", "ord")
    return nodes, edges


def ingest_relations(batch: DataFrame) -> DataFrame:
    """``on`` and ``in`` sightings that come with ingested objects (support_id, room_id)."""
    links = F.array(
        F.struct(F.lit("on").alias("predicate"), F.col("support_id").alias("object")),
        F.struct(F.lit("in").alias("predicate"), F.col("room_id").alias("object")),
    )
    return (
        batch.withColumn("_l", F.explode(links))
        .filter(F.coalesce(F.col("_l.object"), F.lit("")) != "")
        .select(
            "scene_id", F.col("node_id").alias("subject"), "_l.predicate", "_l.object",
            "confidence", "t_s", "ord",
            F.create_map().cast("map<string,string>").alias("view_tags"),
        )
    )


# ---- corrections ------------------------------------------------------------------------------------------


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def apply_corrections(
    nodes: DataFrame, corrections: DataFrame, factor: float = 0.5, bucket: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """Corrected nodes and the correction log, corrections taken in ``ord`` order.

    Empty names and colours change nothing. Every correction multiplies the confidence by
    ``factor`` (0 to 1), rounded to three digits each time.
    """
    if not 0 <= factor <= 1:
        raise ValueError("factor must lie between 0 and 1")
    cleaned = corrections.withColumns(
        {"_n": _present(F.col("new_name")), "_c": _present(F.col("new_color"))}
    )
    history = last_known(cleaned, ["node_id"], "ord", {"_n": "_pn", "_c": "_pc"}, bucket)
    start = nodes.select("node_id", F.col("name").alias("_name"), F.col("color").alias("_color"))
    linked = history.join(start, "node_id")
    old_name = F.coalesce("_pn", "_name", F.lit(""))
    old_color = F.coalesce("_pc", "_color", F.lit(""))
    log = linked.select(
        "node_id", "ord", "t_s", "source",
        old_name.alias("old_name"), F.coalesce(F.col("_n"), old_name).alias("new_name"),
        old_color.alias("old_color"), F.coalesce(F.col("_c"), old_color).alias("new_color"),
    )
    final = cleaned.groupBy("node_id").agg(
        F.max_by("_n", F.when(F.col("_n").isNotNull(), F.col("ord"))).alias("_n"),
        F.max_by("_c", F.when(F.col("_c").isNotNull(), F.col("ord"))).alias("_c"),
        F.count(F.lit(1)).alias("n_corrections"),
    )
    # a step lowers the value by a thousandth at least or leaves it for good, so the value stands
    # still after this many steps however many corrections follow
    settled = F.ceil(F.abs("confidence") * 1000) + 1
    times = F.sequence(F.lit(1), F.least(F.col("n_corrections"), settled).cast("int"))
    lowered = F.aggregate(
        times, F.col("confidence"), lambda acc, _: F.bround(acc * factor, 3)
    )
    changed = F.col("n_corrections").isNotNull()
    corrected = (
        nodes.join(final, "node_id", "left")
        .withColumn("name", F.coalesce("_n", "name"))
        .withColumn("color", F.coalesce("_c", "color"))
        .withColumn("confidence", F.when(changed, lowered).otherwise(F.col("confidence")))
        .withColumn("n_corrections", F.coalesce("n_corrections", F.lit(0)))
        .drop("_n", "_c")
    )
    return corrected, log


def node_sources(nodes: DataFrame, corrections: DataFrame, bucket: int = 100_000) -> DataFrame:
    """(node_id, place, source): each node's own ``sources`` and then those of its corrections in ``ord``
    order. A row each, so a node that is corrected very often is no long list. Corrections of unknown
    nodes are left out, as ``apply_corrections`` does."""
    own = nodes.select("node_id", F.coalesce("sources", F.array().cast("array<string>")).alias("_s"))
    first = own.select("node_id", F.posexplode("_s").alias("_p", "source")).select(
        "node_id", (F.col("_p") + 1).cast("long").alias("place"), "source")
    later = positions(corrections.select("node_id", "ord", "source"), ["node_id"], "ord", bucket, "_p").join(
        own.select("node_id", F.size("_s").alias("_n")), "node_id")
    return first.unionByName(later.select("node_id", (F.col("_p") + F.col("_n")).cast("long").alias("place"), "source"))


def move_nodes(
    nodes: DataFrame, moves: DataFrame, bucket: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """Nodes at their latest centre, and every centre they left with the time they left it.

    ``moves`` carry node_id, ord, t_s and center.
    """
    linked = with_previous(moves, ["node_id"], "ord", {"center": "_left"}, bucket)
    start = nodes.select("node_id", F.col("center").alias("_start"))
    archived = (
        linked.join(start, "node_id")
        .withColumn("old_center", F.coalesce("_left", "_start"))
        .filter(F.col("old_center").isNotNull())
        .select("node_id", "ord", "old_center", F.col("t_s").alias("archived_at_s"))
    )
    last = moves.groupBy("node_id").agg(F.max_by("center", "ord").alias("_c"))
    moved = nodes.join(last, "node_id", "left").withColumn(
        "center", F.coalesce("_c", "center")
    ).drop("_c")
    return moved, archived


def stale_status(last_seen: Column, now_s: Column, max_age_s: float) -> Column:
    """``stale`` after ``max_age_s`` without a sight; never seen counts as active."""
    old = (last_seen.isNotNull()) & (now_s - last_seen > max_age_s)
    return F.when(old, "stale").otherwise("active")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return top_k(rows, keys, [F.desc(order)], 1).drop("rn")
