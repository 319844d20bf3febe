"""Registered queries: geometry, relations and hierarchy of scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgraph.functions import geometry as g
from roomgraph.operators import relations as rel
from roomgraph.operators.spatial import footprint_pairs, pair_box
from roomgraph.operators.spatial import ray_hits as hit_by_rays
from roomgraph.plans.catalog import query
from roomgraph.sources import testtables as t

# SQL twins of the box expressions, over two aliases
_OVERLAP = """
 (greatest(0.0, least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin)) * greatest(0.0, least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin)))
 / least(greatest(1e-9,(a.xmax-a.xmin)*(a.ymax-a.ymin)), greatest(1e-9,(b.xmax-b.xmin)*(b.ymax-b.ymin)))"""
_OVERLAP_BA = _OVERLAP  # symmetric
_DIST = """sqrt(power((a.xmin+a.xmax)/2-(b.xmin+b.xmax)/2,2)+power((a.ymin+a.ymax)/2-(b.ymin+b.ymax)/2,2)
 +power((a.zmin+a.zmax)/2-(b.zmin+b.zmax)/2,2))"""


@query("geo_boxes", """
SELECT node_id, round((xmin+xmax)/2,6) AS cx, round((ymin+ymax)/2,6) AS cy, round((zmin+zmax)/2,6) AS cz,
       round(zmin,6) AS bottom_z, round(zmax,6) AS top_z,
       round((xmax-xmin)*(ymax-ymin),6) AS floor_area FROM {a_objects}""")
def geo_boxes(spark, sf):
    box = F.col("box")
    c = g.box_center(box)
    return t.objects(spark, sf).select(
        "node_id",
        F.round(c.x, 6).alias("cx"), F.round(c.y, 6).alias("cy"), F.round(c.z, 6).alias("cz"),
        F.round(box.zmin, 6).alias("bottom_z"), F.round(box.zmax, 6).alias("top_z"),
        F.round(g.footprint_area(box), 6).alias("floor_area"),
    )


@query("geo_dims_cm", """
SELECT node_id, d[1] AS l_cm, d[2] AS w_cm, d[3] AS h_cm,
       concat('约 ', d[1], '×', d[2], '×', d[3], ' 厘米') AS size_text
FROM (SELECT node_id, list_transform(list_reverse_sort([abs(xmax-xmin),abs(ymax-ymin),abs(zmax-zmin)]),
        lambda v: greatest(1, CAST(round_even(v*100, 0) AS INTEGER))) AS d FROM {a_objects}) q""")
def geo_dims_cm(spark, sf):
    d = g.box_dims_cm(F.col("box"))
    out = t.objects(spark, sf).withColumn("d", d)
    return out.select(
        "node_id", F.col("d")[0].alias("l_cm"), F.col("d")[1].alias("w_cm"),
        F.col("d")[2].alias("h_cm"),
        F.concat(F.lit("约 "), F.col("d")[0], F.lit("×"), F.col("d")[1], F.lit("×"),
                 F.col("d")[2], F.lit(" 厘米")).alias("size_text"),
    )


@query("geo_overlap_pairs", f"""
SELECT a.scene_id, a.node_id AS a_id, b.node_id AS b_id, round({_OVERLAP},6) AS overlap
FROM {{a_objects}} a JOIN {{a_objects}} b ON a.scene_id=b.scene_id AND a.ord<b.ord
WHERE {_OVERLAP} > 0""")
def geo_overlap_pairs(spark, sf):
    o = t.objects(spark, sf)
    pairs = footprint_pairs(o, o, ["scene_id"], ["ord", "node_id"], ["ord", "node_id"])
    return (
        pairs.filter(F.col("l_ord") < F.col("r_ord"))
        .select(
            "scene_id", F.col("l_node_id").alias("a_id"), F.col("r_node_id").alias("b_id"),
            g.footprint_overlap(pair_box("l"), pair_box("r")).alias("overlap"),
        )
        .filter(F.col("overlap") > 0)
        .withColumn("overlap", F.round("overlap", 6))
    )


@query("ray_hits", """
SELECT o.scene_id, p.frame_no, o.node_id FROM
 (SELECT scene_id, frame_no, -(r00*tx+r10*ty+r20*tz) AS ox, -(r01*tx+r11*ty+r21*tz) AS oy, -(r02*tx+r12*ty+r22*tz) AS oz,
         r20 AS dx, r21 AS dy, r22 AS dz FROM {a_poses}) p
JOIN {a_objects} o ON o.scene_id = p.scene_id
WHERE greatest(0.0,
  CASE WHEN abs(dx)<1e-12 THEN (CASE WHEN ox BETWEEN xmin AND xmax THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END) ELSE least((xmin-ox)/dx,(xmax-ox)/dx) END,
  CASE WHEN abs(dy)<1e-12 THEN (CASE WHEN oy BETWEEN ymin AND ymax THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END) ELSE least((ymin-oy)/dy,(ymax-oy)/dy) END,
  CASE WHEN abs(dz)<1e-12 THEN (CASE WHEN oz BETWEEN zmin AND zmax THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END) ELSE least((zmin-oz)/dz,(zmax-oz)/dz) END)
 <= least(
  CASE WHEN abs(dx)<1e-12 THEN (CASE WHEN ox BETWEEN xmin AND xmax THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END) ELSE greatest((xmin-ox)/dx,(xmax-ox)/dx) END,
  CASE WHEN abs(dy)<1e-12 THEN (CASE WHEN oy BETWEEN ymin AND ymax THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END) ELSE greatest((ymin-oy)/dy,(ymax-oy)/dy) END,
  CASE WHEN abs(dz)<1e-12 THEN (CASE WHEN oz BETWEEN zmin AND zmax THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END) ELSE greatest((zmin-oz)/dz,(zmax-oz)/dz) END)""")
def ray_hits(spark, sf):
    """What stands in the line of sight of each camera."""
    looks = t.poses(spark, sf).select(
        "scene_id", "frame_no", g.camera_center(F.col("pose")).alias("eye"),
        g.make_point(F.col("pose.r20"), F.col("pose.r21"), F.col("pose.r22")).alias("look"),
    )
    return hit_by_rays(looks, t.objects(spark, sf), ["scene_id"]).select("scene_id", "frame_no", "node_id")


_EGO = """
SELECT o.scene_id, p.frame_no, o.node_id,
  r00*(cx-tx)+r10*(cy-ty)+r20*(cz-tz) AS lx, r01*(cx-tx)+r11*(cy-ty)+r21*(cz-tz) AS ly, r02*(cx-tx)+r12*(cy-ty)+r22*(cz-tz) AS lz
FROM (SELECT *, (xmin+xmax)/2 AS cx,(ymin+ymax)/2 AS cy,(zmin+zmax)/2 AS cz FROM {a_objects}) o JOIN {a_poses} p ON o.scene_id=p.scene_id"""
_TAG = """CASE WHEN abs(b)<=45 THEN 'front' WHEN b>45 AND b<=90 THEN 'left_front' WHEN b< -45 AND b>= -90 THEN 'right_front'
 WHEN abs(b)>112.5 THEN 'behind' WHEN b>0 THEN 'left' ELSE 'right' END"""


@query("egocentric_tags", f"""
SELECT scene_id, frame_no, node_id, round(sqrt(lx*lx+ly*ly),6) AS distance, round(b,6) AS bearing_deg, {_TAG} AS tag, round(lz,6) AS z_rel
FROM (SELECT *, degrees(atan2(ly,lx)) AS b FROM ({_EGO}) e) q""")
def egocentric_tags(spark, sf):
    seen = t.objects(spark, sf).join(t.poses(spark, sf), "scene_id").withColumn(
        "e", g.egocentric(g.box_center(F.col("box")), F.col("pose"))
    )
    return seen.select(
        "scene_id", "frame_no", "node_id",
        F.round("e.distance", 6).alias("distance"),
        F.round("e.bearing_deg", 6).alias("bearing_deg"),
        "e.tag", F.round("e.z_rel", 6).alias("z_rel"),
    )


_ON = f"abs(a.zmin-b.zmax)<=0.05 AND {_OVERLAP}>=0.15"
_ON_BA = f"abs(b.zmin-a.zmax)<=0.05 AND {_OVERLAP}>=0.15"
ON_SQL = f"""
SELECT a.scene_id, a.node_id AS subject, b.node_id AS object, a.ord AS subject_ord, b.ord AS object_ord, b.label AS object_label
FROM {{a_objects}} a JOIN {{a_objects}} b ON a.scene_id=b.scene_id AND a.ord<>b.ord
WHERE {_ON} AND (a.ord<b.ord OR NOT ({_ON_BA}))"""
NEAR_SQL = f"""
SELECT a.scene_id, a.node_id AS subject, b.node_id AS object, a.ord AS subject_ord, b.ord AS object_ord, b.label AS object_label, {_DIST} AS distance
FROM {{a_objects}} a JOIN {{a_objects}} b ON a.scene_id=b.scene_id AND a.ord<b.ord WHERE {_DIST}<=1.0"""
SUPPORT_SQL = f"""
SELECT a.scene_id, a.node_id AS subject, b.support_id AS object, a.ord AS subject_ord, b.ord AS object_ord
FROM {{a_objects}} a JOIN {{a_supports}} b ON a.scene_id=b.scene_id
WHERE abs(a.zmin-b.top_z)<=0.12 AND {_OVERLAP}>=0.15"""


@query("relations_on", f"SELECT scene_id, subject, object FROM ({ON_SQL}) q")
def relations_on(spark, sf):
    return rel.on_edges(t.objects(spark, sf)).select("scene_id", "subject", "object")


@query("relations_near",
       f"SELECT scene_id, subject, object, round(distance,6) AS distance FROM ({NEAR_SQL}) q")
def relations_near(spark, sf):
    return rel.near_edges(t.objects(spark, sf)).select(
        "scene_id", "subject", "object", F.round("distance", 6).alias("distance")
    )


@query("relations_above", """
SELECT a.scene_id, a.node_id,
  count(*) FILTER (WHERE (a.zmin+a.zmax)/2-(b.zmin+b.zmax)/2 > 0.02) AS n_below,
  count(*) FILTER (WHERE (b.zmin+b.zmax)/2-(a.zmin+a.zmax)/2 > 0.02) AS n_above
FROM {a_objects} a JOIN {a_objects} b ON a.scene_id=b.scene_id GROUP BY 1,2""")
def relations_above(spark, sf):
    return rel.above_counts(t.objects(spark, sf)).select(
        "scene_id", "node_id", "n_below", "n_above"
    )


@query("on_support", f"SELECT scene_id, subject, object FROM ({SUPPORT_SQL}) q")
def on_support(spark, sf):
    return rel.support_edges(t.objects(spark, sf), t.supports(spark, sf)).select(
        "scene_id", "subject", "object"
    )


@query("contains_pairs", """
SELECT a.scene_id, a.node_id AS container, b.node_id AS item
FROM {a_objects} a JOIN {a_objects} b ON a.scene_id=b.scene_id AND a.ord<>b.ord
WHERE b.xmin>=a.xmin-0.1 AND b.ymin>=a.ymin-0.1 AND b.xmax<=a.xmax+0.1 AND b.ymax<=a.ymax+0.1
  AND b.zmin>=a.zmin-0.1 AND b.zmax<=a.zmax+0.1""")
def contains_pairs(spark, sf):
    o = t.objects(spark, sf)
    return rel.contains_pairs(o, o, margin=0.1)
