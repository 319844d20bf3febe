"""Registered queries: lifting, association, learning and changes over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgraph.fixed_values import NAME_FAMILY
from roomgraph.functions import geometry as g
from roomgraph.operators import align, associate, evidence, learn, lift, lifecycle, planes
from roomgraph.operators.similarity import best_matches
from roomgraph.plans.catalog import query
from roomgraph.sources import testtables as t

def lens():
    return F.struct(
        F.lit(500.0).alias("f"), F.lit(320.0).alias("cx"), F.lit(180.0).alias("cy"),
        F.lit(0.05).alias("k"),
    )


def detections(spark, sf):
    return t.detections(spark, sf).withColumn("det_id", F.col("ord"))


def tracked(spark, sf):
    return align.tracked_points(t.points(spark, sf))


# ---- projection and lifting -----------------------------------------------------------------

_SHOTS = """
 shots AS (SELECT *, 500.0*xn*(1.0+0.05*(xn*xn+yn*yn))+320.0 AS u, 500.0*yn*(1.0+0.05*(xn*xn+yn*yn))+180.0 AS v FROM (
  SELECT *, camx/greatest(depth,1e-9) AS xn, camy/greatest(depth,1e-9) AS yn FROM (
   SELECT p.scene_id, q.frame, q.frame_no, p.x, p.y, p.z, p.track_len, r00*x+r01*y+r02*z+tx AS camx, r10*x+r11*y+r12*z+ty AS camy, r20*x+r21*y+r22*z+tz AS depth
   FROM {a_points} p JOIN {a_poses} q ON p.scene_id=q.scene_id WHERE p.track_len>=3) a) b)"""


@query("projected_points", f"""
WITH {_SHOTS}
SELECT scene_id, frame, count(*) AS n, round(avg(u),3) AS mean_u, round(avg(v),3) AS mean_v, round(max(depth),6) AS far
FROM shots WHERE depth>0.1 GROUP BY 1,2""")
def projected_points(spark, sf):
    shots = lift.project_frames(tracked(spark, sf), t.poses(spark, sf).select("scene_id", "frame", "pose"), lens())
    return shots.filter(F.col("depth") > 0.1).groupBy("scene_id", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 3).alias("mean_u"),
        F.round(F.avg("v"), 3).alias("mean_v"), F.round(F.max("depth"), 6).alias("far"),
    )


@query("lift_boxes", f"""
WITH {_SHOTS},
 hits AS (SELECT d.scene_id, d.ord, s.* EXCLUDE (scene_id) FROM {{a_detections}} d JOIN shots s ON s.scene_id=d.scene_id AND s.frame=d.frame
   AND u>=x1-3 AND u<=x2+3 AND v>=y1-3 AND v<=y2+3 AND depth>0.1),
 slab AS (SELECT * FROM (SELECT *, min(depth) OVER (PARTITION BY scene_id, ord) AS zmin FROM hits) q WHERE depth<=zmin+0.6)
SELECT scene_id, ord, count(*) AS n_points, round(median(x),6) AS cx, round(median(y),6) AS cy, round(median(z),6) AS cz,
 round(quantile_cont(x,0.1),6) AS xmin, round(quantile_cont(y,0.1),6) AS ymin, round(quantile_cont(z,0.1),6) AS zmin,
 round(quantile_cont(x,0.9),6) AS xmax, round(quantile_cont(y,0.9),6) AS ymax, round(quantile_cont(z,0.9),6) AS zmax
FROM slab GROUP BY 1,2 HAVING count(*)>=5""")
def lift_boxes(spark, sf):
    out = lift.lift_by_points(
        detections(spark, sf), tracked(spark, sf), t.poses(spark, sf), lens()
    )
    return out.select(
        "scene_id", "ord", "n_points",
        *[F.round(f"center.{a}", 6).alias(f"c{a}") for a in "xyz"],
        *[F.round(f"box.{f}", 6).alias(f) for f in g.BOX_FIELDS],
    )


_DEPTH = """
 samples AS (SELECT d.scene_id, d.frame, CAST(d.x1 AS BIGINT)+10+l_partkey%30 AS px, CAST(d.y1 AS BIGINT)+10+l_suppkey%30 AS py,
   CAST(l_quantity AS DOUBLE)/10 AS depth FROM {lineitem} l JOIN {a_detections} d ON d.ord=l.l_orderkey)"""


@query("depth_lift", f"""
WITH {_DEPTH},
 roi AS (SELECT d.*, CAST(trunc(x1+0.275*(x2-x1)) AS INT) AS l, CAST(trunc(x1+0.725*(x2-x1)) AS INT) AS r, CAST(trunc(y1+0.275*(y2-y1)) AS INT) AS t, CAST(trunc(y1+0.725*(y2-y1)) AS INT) AS b FROM {{a_detections}} d),
 med AS (SELECT r.scene_id, r.ord, median(s.depth) AS dm FROM roi r JOIN samples s ON s.scene_id=r.scene_id AND s.frame=r.frame AND px>=l AND px<r AND py>=t AND py<b AND depth>0.15 GROUP BY 1,2 HAVING count(*)>=5),
 m AS (SELECT d.*, q.* EXCLUDE (scene_id, frame, frame_no), dm, ((x1+x2)/2-320.0)/500.0 AS xd, ((y1+y2)/2-180.0)/500.0 AS yd, (x2-x1)/500.0*dm AS w, (y2-y1)/500.0*dm AS h
  FROM {{a_detections}} d JOIN med ON med.scene_id=d.scene_id AND med.ord=d.ord JOIN {{a_poses}} q ON q.scene_id=d.scene_id AND q.frame=d.frame),
 c AS (SELECT *, r00*(camx-tx)+r10*(camy-ty)+r20*(dm-tz) AS cx, r01*(camx-tx)+r11*(camy-ty)+r21*(dm-tz) AS cy, r02*(camx-tx)+r12*(camy-ty)+r22*(dm-tz) AS cz, greatest(0.05, least(0.6, 0.15*greatest(w,h))) AS th
  FROM (SELECT *, xd/(1.0+0.05*(xd*xd+yd*yd))*dm AS camx, yd/(1.0+0.05*(xd*xd+yd*yd))*dm AS camy FROM m) z)
SELECT scene_id, ord, round(dm,6) AS depth_m, round(cx-w/2,6) AS xmin, round(cy-greatest(h/2,0.1),6) AS ymin, round(cz-th/2,6) AS zmin, round(cx+w/2,6) AS xmax, round(cy+greatest(h/2,0.1),6) AS ymax, round(cz+th/2,6) AS zmax FROM c""")
def depth_lift(spark, sf):
    d = detections(spark, sf)
    items = t.view(spark, sf, "lineitem")
    samples = items.join(d.withColumnRenamed("ord", "l_orderkey"), "l_orderkey").select(
        "scene_id", "frame",
        (F.col("bbox.x1").cast("long") + 10 + F.col("l_partkey") % 30).alias("px"),
        (F.col("bbox.y1").cast("long") + 10 + F.col("l_suppkey") % 30).alias("py"),
        (F.col("l_quantity") / 10).alias("depth"),
    )
    out = lift.lift_by_depth(d, samples, t.poses(spark, sf), lens())
    return out.select(
        "scene_id", "ord", F.round("depth_m", 6).alias("depth_m"),
        *[F.round(f"box.{f}", 6).alias(f) for f in g.BOX_FIELDS],
    )


@query("depth_scale", f"""
WITH {_SHOTS},
 s AS (SELECT *, (8+track_len)/(10.0*depth) AS disp FROM shots WHERE u>=1 AND u<639 AND v>=1 AND v<359 AND depth>0.2),
 r AS (SELECT scene_id, frame, CASE WHEN disp>1e-4 THEN depth*disp END AS ratio FROM s),
 b AS (SELECT scene_id, frame, count(*) AS n, count(ratio) AS k, quantile_cont(ratio,0.1) AS lo, quantile_cont(ratio,0.9) AS hi FROM r GROUP BY 1,2),
 c AS (SELECT r.scene_id, r.frame, median(ratio) AS scale FROM r JOIN b ON b.scene_id=r.scene_id AND b.frame=r.frame WHERE n>20 AND k>=10 AND ratio>=lo AND ratio<=hi GROUP BY 1,2)
SELECT f.scene_id, f.frame, coalesce(b.n,0) AS n_seen, round(CASE WHEN scale>0 THEN scale END,6) AS scale
FROM (SELECT DISTINCT scene_id, frame FROM shots) f LEFT JOIN b ON b.scene_id=f.scene_id AND b.frame=f.frame LEFT JOIN c ON c.scene_id=f.scene_id AND c.frame=f.frame""")
def depth_scale(spark, sf):
    shots = lift.project_frames(tracked(spark, sf), t.poses(spark, sf).select("scene_id", "frame", "pose"), lens())
    disp = F.when(F.col("depth") > 0.2, (8 + F.col("track_len")) / (10.0 * F.col("depth"))).otherwise(0.0)
    return lift.depth_scales(shots.withColumn("disp", disp)).withColumn("scale", F.round("scale", 6))


@query("camera_track", """
SELECT scene_id, frame, round(-(r00*tx+r10*ty+r20*tz),6) AS x, round(-(r01*tx+r11*ty+r21*tz),6) AS y, round(-(r02*tx+r12*ty+r22*tz),6) AS z,
 round(atan2(r10,r00),6) AS yaw,
 round(CASE WHEN r00+r11+r22>0 THEN sqrt(r00+r11+r22+1.0)*2*0.25 WHEN r00>r11 AND r00>r22 THEN (r21-r12)/(sqrt(1.0+r00-r11-r22)*2) WHEN r11>r22 THEN (r02-r20)/(sqrt(1.0+r11-r00-r22)*2) ELSE (r10-r01)/(sqrt(1.0+r22-r00-r11)*2) END,6) AS qw,
 round(CASE WHEN r00+r11+r22>0 THEN (r02-r20)/(sqrt(r00+r11+r22+1.0)*2) WHEN r00>r11 AND r00>r22 THEN (r01+r10)/(sqrt(1.0+r00-r11-r22)*2) WHEN r11>r22 THEN sqrt(1.0+r11-r00-r22)*2*0.25 ELSE (r12+r21)/(sqrt(1.0+r22-r00-r11)*2) END,6) AS qy,
 round(CASE WHEN r00+r11+r22>0 THEN (r21-r12)/(sqrt(r00+r11+r22+1.0)*2) WHEN r00>r11 AND r00>r22 THEN sqrt(1.0+r00-r11-r22)*2*0.25 WHEN r11>r22 THEN (r01+r10)/(sqrt(1.0+r11-r00-r22)*2) ELSE (r02+r20)/(sqrt(1.0+r22-r00-r11)*2) END,6)+0.0 AS qx,
 round(CASE WHEN r00+r11+r22>0 THEN (r10-r01)/(sqrt(r00+r11+r22+1.0)*2) WHEN r00>r11 AND r00>r22 THEN (r02+r20)/(sqrt(1.0+r00-r11-r22)*2) WHEN r11>r22 THEN (r12+r21)/(sqrt(1.0+r11-r00-r22)*2) ELSE sqrt(1.0+r22-r00-r11)*2*0.25 END,6)+0.0 AS qz
FROM {a_poses}""")
def camera_track(spark, sf):
    poses = align.camera_centers(t.poses(spark, sf)).withColumn(
        "q", g.quaternion_from_pose(F.col("pose"))
    )
    return poses.select(
        "scene_id", "frame", *[F.round(f"center.{a}", 6).alias(a) for a in "xyz"],
        F.round(g.yaw_from_pose(F.col("pose")), 6).alias("yaw"),
        F.round("q.qw", 6).alias("qw"), F.round("q.qy", 6).alias("qy"),
        (F.round("q.qx", 6) + 0.0).alias("qx"), (F.round("q.qz", 6) + 0.0).alias("qz"),
    )


@query("detection_remap", """
SELECT ord, round(greatest(0.0,(x1+w/2-w/2-4)/0.5),6) AS x1, round(greatest(0.0,(y1+h/2-h/2-140)/0.5),6) AS y1,
 round(least(1280.0,(x1+w/2+w/2-4)/0.5),6) AS x2, round(least(720.0,(y1+h/2+h/2-140)/0.5),6) AS y2,
 round(y1,6) AS rx1, round(640.0-1-x2,6) AS ry1, round(y2,6) AS rx2, round(640.0-1-x1,6) AS ry2
FROM (SELECT *, x2-x1 AS w, y2-y1 AS h FROM {a_detections}) d""")
def detection_remap(spark, sf):
    b = F.col("bbox")
    w_, h_ = b.x2 - b.x1, b.y2 - b.y1
    unboxed = g.unletterbox(
        b.x1 + w_ / 2, b.y1 + h_ / 2, w_, h_, F.lit(4), F.lit(140), F.lit(0.5), F.lit(1280), F.lit(720)
    )
    turned = g.unrotate_quarter(b, F.lit(640.0))
    out = t.detections(spark, sf).withColumns({"u": unboxed, "r": turned})
    return out.select(
        "ord", *[F.round(f"u.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")],
        *[F.round(f"r.{c}", 6).alias("r" + c) for c in ("x1", "y1", "x2", "y2")],
    )


@query("crop_manifest", """
SELECT * FROM (SELECT scene_id, ord, greatest(0, CAST(x1 AS INT)-12) AS x1, greatest(0, CAST(y1 AS INT)-12) AS y1, least(560, CAST(x2 AS INT)+12) AS x2, least(300, CAST(y2 AS INT)+12) AS y2 FROM {a_detections}) c
WHERE x2-x1>=8 AND y2-y1>=8""")
def crop_manifest(spark, sf):
    sized = t.detections(spark, sf).withColumns({"width": F.lit(560), "height": F.lit(300)})
    return evidence.crops(sized).select("scene_id", "ord", "crop.*")


# ---- alignment and trajectories ------------------------------------------------------------------


@query("floor_hist", """
WITH cam AS (SELECT scene_id, min(cz) AS cmin, median(cz) AS cmed FROM {a_track} GROUP BY 1),
 below AS (SELECT p.scene_id, p.z AS h, cmed FROM {a_points} p JOIN cam ON cam.scene_id=p.scene_id WHERE p.z < cmin-1e-6),
 ext AS (SELECT scene_id, min(h) AS lo, max(h) AS hi FROM below GROUP BY 1 HAVING count(*)>=50),
 bins AS (SELECT b.scene_id, lo, hi, cmed, CAST(least(199, floor((h-lo)*200/(hi-lo))) AS BIGINT) AS bin, count(*) AS n FROM below b JOIN ext e ON e.scene_id=b.scene_id GROUP BY ALL)
SELECT scene_id, round(cmed,6) AS cam_median, bin, n AS n_floor, round(lo+(bin+0.5)*((hi-lo)/200),6) AS floor_h
FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, bin) AS rn FROM bins WHERE bin<=100) q WHERE rn=1""")
def floor_hist(spark, sf):
    cams = t.view(spark, sf, "a_track").select("scene_id", F.col("cz").alias("h"))
    heights = t.view(spark, sf, "a_points").select("scene_id", F.col("z").alias("h"))
    return align.floor_heights(heights, cams).select(
        "scene_id", F.round("cam_median", 6).alias("cam_median"), "bin", "n_floor",
        F.round("floor_h", 6).alias("floor_h"),
    )


def track_poses(spark, sf):
    """Upright cameras along the walk, with raw axes: x right, y down, z forward."""
    k = t.view(spark, sf, "a_track")
    zero, one = F.lit(0.0), F.lit(1.0)
    return k.withColumn(
        "pose",
        g.make_pose((one, zero, zero, zero, zero, -one, zero, one, zero),
                    (-F.col("cx"), F.col("cz"), -F.col("cy"))),
    ).select("scene_id", "frame_no", "pose")


@query("scene_alignment")
def scene_alignment(spark, sf):
    """Gravity, floor and scale of each scene from its walk and its points."""
    out = align.alignments(t.points(spark, sf), track_poses(spark, sf))
    a = F.col("alignment")
    return out.select(
        "scene_id", "n_floor", F.round("floor_h", 6).alias("floor_h"),
        F.round(a.scale, 6).alias("scale"), F.round(a.r22, 6).alias("r22"),
    )


@query("trajectory_stats", """
WITH s AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(cz) OVER w AS pz, lag(host_mono_ns) OVER w AS pt FROM {a_track} WINDOW w AS (PARTITION BY scene_id ORDER BY frame_no)),
 d AS (SELECT *, sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py)+(cz-pz)*(cz-pz)) AS step, (host_mono_ns-pt)/1e9 AS dt FROM s)
SELECT scene_id, count(*) AS frames, round(sum(step),6) AS length_m, round(max(step),6) AS max_jump_m, round(max(cx)-min(cx),6) AS extent_x, round(max(cy)-min(cy),6) AS extent_y, round(max(cz)-min(cz),6) AS extent_z,
 bool_and(abs(sqrt(qw*qw)-1.0)<1e-3) AS quaternions_ok, count(host_mono_ns) AS timestamps, round(median(step)/median(dt),6) AS median_speed FROM d GROUP BY 1""")
def trajectory_stats(spark, sf):
    track = t.view(spark, sf, "a_track").withColumns({q: F.lit(0.0) for q in ("qx", "qy", "qz")})
    out = align.trajectory_stats(track)
    floats = ["length_m", "max_jump_m", "extent_x", "extent_y", "extent_z", "median_speed"]
    return out.select(
        "scene_id", "frames", "quaternions_ok", "timestamps",
        *[F.round(c, 6).alias(c) for c in floats],
    )


@query("jump_filter", """
WITH RECURSIVE o AS (SELECT scene_id, frame_no, cx, cy, cz, row_number() OVER (PARTITION BY scene_id ORDER BY frame_no) AS i FROM {a_track}),
 k AS (SELECT scene_id, frame_no, i, cx AS kx, cy AS ky, cz AS kz, true AS kept FROM o WHERE i=1
  UNION ALL SELECT o.scene_id, o.frame_no, o.i, CASE WHEN ok THEN o.cx ELSE kx END, CASE WHEN ok THEN o.cy ELSE ky END, CASE WHEN ok THEN o.cz ELSE kz END, ok
  FROM (SELECT o.*, kx, ky, kz, sqrt((o.cx-kx)*(o.cx-kx)+(o.cy-ky)*(o.cy-ky)+(o.cz-kz)*(o.cz-kz))<=2.0 AS ok FROM k JOIN o ON o.scene_id=k.scene_id AND o.i=k.i+1) o)
SELECT scene_id, frame_no FROM k WHERE kept""")
def jump_filter(spark, sf):
    return align.drop_jumps(t.view(spark, sf, "a_track")).select("scene_id", "frame_no")


@query("manifest_map", """
WITH f AS (SELECT scene_id, frame_no, row_number() OVER (PARTITION BY scene_id ORDER BY frame_no)-1 AS i, count(*) OVER (PARTITION BY scene_id) AS m FROM {a_poses}),
 r AS (SELECT scene_id, host_mono_ns, row_number() OVER (PARTITION BY scene_id ORDER BY frame_no)-1 AS i, count(*) OVER (PARTITION BY scene_id) AS n FROM {a_track})
SELECT f.scene_id, f.frame_no, f.i AS extract_index, r.host_mono_ns FROM (SELECT f.*, CASE WHEN m=1 THEN 0 ELSE CAST(round_even(f.i*(n-1)/CAST(m-1 AS DOUBLE),0) AS BIGINT) END AS at
  FROM f LEFT JOIN (SELECT DISTINCT scene_id, n FROM r) c ON c.scene_id=f.scene_id) f LEFT JOIN r ON r.scene_id=f.scene_id AND r.i=f.at""")
def manifest_map(spark, sf):
    frames = t.poses(spark, sf).select("scene_id", "frame_no")
    timeline = t.view(spark, sf, "a_track").select(
        "scene_id", F.col("frame_no").alias("row_no"), "host_mono_ns"
    )
    return align.manifest_rows(frames, timeline).select(
        "scene_id", "frame_no", "extract_index", "host_mono_ns"
    )


@query("main_model", """
SELECT scene_id, arg_max(model, n*1000-model) AS model, max(n) AS n_images FROM (SELECT scene_id, class_id % 3 AS model, count(*) AS n FROM {a_detections} GROUP BY 1,2) c GROUP BY 1""")
def main_model(spark, sf):
    images = t.detections(spark, sf).select("scene_id", (F.col("class_id") % 3).alias("model"))
    return align.main_model(images)


@query("registration_rate", """
SELECT d.scene_id, count(p.frame) AS registered, count(*) AS total FROM {a_detections} d LEFT JOIN (SELECT * FROM {a_poses} WHERE r00>0) p ON p.scene_id=d.scene_id AND p.frame=d.frame GROUP BY 1""")
def registration_rate(spark, sf):
    known = t.poses(spark, sf).filter(F.col("pose.r00") > 0)
    return align.registration_rate(t.detections(spark, sf), known)


# ---- planes ------------------------------------------------------------------------------------------


@query("plane_votes", """
SELECT p.scene_id, q.frame_no, count(*) FILTER (WHERE abs(q.r20*p.x+q.r21*p.y+q.r22*p.z-2.0) <= 0.2) AS n_inliers
FROM {a_points} p JOIN {a_poses} q ON q.scene_id=p.scene_id GROUP BY 1,2""")
def plane_votes(spark, sf):
    """How many points lie on each camera's plane of depth 2 through its scene."""
    facing = t.poses(spark, sf).select(
        "scene_id", F.col("frame_no").alias("h"), F.col("pose.r20").alias("nx"),
        F.col("pose.r21").alias("ny"), F.col("pose.r22").alias("nz"), F.lit(-2.0).alias("d"),
    )
    return planes.plane_votes(t.points(spark, sf), facing, 0.2).select(
        "scene_id", F.col("h").alias("frame_no"), "n_inliers"
    )


@query("support_planes")
def support_planes(spark, sf):
    return planes.support_surfaces(t.points(spark, sf)).select(
        "scene_id", "support_id", F.round("top_z", 4).alias("top_z"), "n_inliers"
    )


@query("wall_planes")
def wall_planes(spark, sf):
    return planes.walls(t.points(spark, sf)).select(
        "scene_id", "anchor_id", F.round("confidence", 4).alias("confidence"), "n_inliers"
    )


@query("plane_summary", """
SELECT scene_id, ord AS plane_no, round(median(z),6) AS top_z, round(min(x),6) AS xmin, round(max(y),6) AS ymax, round(median(z)-0.05,6) AS zmin, round(median(z)+0.03,6) AS zmax, count(*) AS n_inliers,
 round(round_even(max(x)-min(x),2),6) AS extent_x FROM (SELECT *, track_len AS ord FROM {a_points}) p GROUP BY 1,2""")
def plane_summary(spark, sf):
    """Slab summary of given planes (here: points of one track length)."""
    inliers = t.points(spark, sf).select(
        "scene_id", F.col("track_len").alias("plane_no"), "p",
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"),
    )
    slabs = planes.support_summary(planes._extent(inliers))
    b = F.col("box")
    return slabs.select(
        "scene_id", F.col("ord").alias("plane_no"), F.round("top_z", 6).alias("top_z"),
        F.round(b.xmin, 6).alias("xmin"), F.round(b.ymax, 6).alias("ymax"),
        F.round(b.zmin, 6).alias("zmin"), F.round(b.zmax, 6).alias("zmax"), "n_inliers",
        F.round(F.col("extent_xy")[0], 6).alias("extent_x"),
    )


# ---- association ---------------------------------------------------------------------------------------


@query("nms_keep", """
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame, class ORDER BY conf DESC, ord) AS i FROM {a_detections}),
 k AS (SELECT scene_id, frame, class, i, [{{'x1':x1,'y1':y1,'x2':x2,'y2':y2,'ord':ord}}] AS kept FROM d WHERE i=1
  UNION ALL SELECT d.scene_id, d.frame, d.class, d.i, CASE WHEN len(list_filter(k.kept, lambda q:
    greatest(0.0,least(q.x2,d.x2)-greatest(q.x1,d.x1))*greatest(0.0,least(q.y2,d.y2)-greatest(q.y1,d.y1)) >
    0.45*((q.x2-q.x1)*(q.y2-q.y1)+(d.x2-d.x1)*(d.y2-d.y1)-greatest(0.0,least(q.x2,d.x2)-greatest(q.x1,d.x1))*greatest(0.0,least(q.y2,d.y2)-greatest(q.y1,d.y1)))))>0
    THEN k.kept ELSE list_append(k.kept, {{'x1':d.x1,'y1':d.y1,'x2':d.x2,'y2':d.y2,'ord':d.ord}}) END
  FROM k JOIN d ON d.scene_id=k.scene_id AND d.frame=k.frame AND d.class=k.class AND d.i=k.i+1)
SELECT scene_id, frame, class, e.ord AS ord FROM (SELECT scene_id, frame, class, unnest(kept) AS e FROM (SELECT *, max(i) OVER (PARTITION BY scene_id, frame, class) AS m FROM k) z WHERE i=m) u""")
def nms_keep(spark, sf):
    return associate.suppress_overlaps(t.detections(spark, sf)).select(
        "scene_id", "frame", "class", "ord"
    )


_ORDERS = ["frame_no", "k1", "k2", "k3", "k4"]


@query("associate_instances")
def associate_instances(spark, sf):
    """Greedy association of all sightings, rolled up to labelled instances."""
    seen = associate.associate(t.view(spark, sf, "a_sightings"), _ORDERS)
    half = F.col("s") / 2
    boxed = seen.withColumn(
        "box",
        g.make_box(F.col("x") - half, F.col("y") - half, F.col("z") - half,
                   F.col("x") + half, F.col("y") + half, F.col("z") + half),
    )
    return associate.instances(boxed, F.struct(*_ORDERS)).select(
        "scene_id", "instance_id", "class", "family", "n_observations", "first_no", "last_no",
        F.round("median_conf", 6).alias("median_conf"),
    )


@query("class_votes", """
WITH f AS (SELECT scene_id, k3 % 40 AS inst, frame_no, class, max(conf) AS c FROM {a_sightings} GROUP BY 1,2,3,4),
 v AS (SELECT scene_id, inst, class, sum(c) AS votes, max(c) AS max_conf, count(*) AS n_frames, min(frame_no) AS seen FROM f GROUP BY 1,2,3),
 r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, inst ORDER BY round(votes,6) DESC, max_conf DESC, seen, class) AS rank FROM v)
SELECT scene_id, inst, rank, class, round(votes,2) AS votes, round(max_conf,2) AS max_conf, n_frames FROM r WHERE rank<=3""")
def class_votes(spark, sf):
    seen = t.view(spark, sf, "a_sightings").withColumn("inst", F.col("k3") % 40)
    return associate.class_votes(seen, ["scene_id", "inst"]).withColumns(
        {"votes": F.round("votes", 2), "max_conf": F.round("max_conf", 2)}
    )


@query("instance_rollup", """
WITH o AS (SELECT scene_id, instance_id, frame_no, conf, class, x,y,z, x-s/2 AS x0, x+s/2 AS x1, z-s/2 AS z0, k1,k2,k3,k4 FROM {a_instance_obs}),
 fr AS (SELECT scene_id, instance_id, frame_no, avg(x0) AS x0, avg(x1) AS x1, avg(z0) AS z0 FROM o GROUP BY 1,2,3),
 b AS (SELECT scene_id, instance_id, quantile_cont(x0,0.25) AS x0, quantile_cont(x1,0.25) AS x1, quantile_cont(z0,0.25) AS z0 FROM fr GROUP BY 1,2),
 a AS (SELECT scene_id, instance_id, count(DISTINCT frame_no) AS n_observations, min(frame_no) AS first_no, max(frame_no) AS last_no, median(x) AS cx, median(conf) AS median_conf FROM o GROUP BY 1,2 HAVING count(DISTINCT frame_no)>=2),
 e AS (SELECT * FROM (SELECT scene_id, instance_id, frame_no AS ev_frame, row_number() OVER (PARTITION BY scene_id, instance_id ORDER BY conf DESC, frame_no DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) AS rn FROM o) q WHERE rn=1)
SELECT a.scene_id, a.instance_id, n_observations, first_no, last_no, round(cx,6) AS cx, round(median_conf,6) AS median_conf, ev_frame, round(b.x0,6) AS xmin, round(b.x1,6) AS xmax, round(b.z0,6) AS zmin
FROM a JOIN b ON a.scene_id=b.scene_id AND a.instance_id=b.instance_id JOIN e ON e.scene_id=a.scene_id AND e.instance_id=a.instance_id""")
def instance_rollup(spark, sf):
    half = F.col("s") / 2
    seen = t.view(spark, sf, "a_instance_obs").withColumn(
        "box",
        g.make_box(F.col("x") - half, F.col("y") - half, F.col("z") - half,
                   F.col("x") + half, F.col("y") + half, F.col("z") + half),
    )
    out = associate.roll_up(seen, ["scene_id", "instance_id"], F.struct(*_ORDERS))
    b = F.col("box")
    return out.select(
        "scene_id", "instance_id", "n_observations", "first_no", "last_no",
        F.round("center.x", 6).alias("cx"), F.round("median_conf", 6).alias("median_conf"),
        F.col("evidence.frame_no").alias("ev_frame"), F.round(b.xmin, 6).alias("xmin"),
        F.round(b.xmax, 6).alias("xmax"), F.round(b.zmin, 6).alias("zmin"),
    )


# ---- learning ----------------------------------------------------------------------------------------------

_FAMILY = "CASE trim({x}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAME_FAMILY.items()) + " ELSE lower(trim({x})) END"


def fam(x: str) -> str:
    return _FAMILY.replace("{x}", x)


def candidate_rows(spark, sf):
    r = t.view(spark, sf, "a_candidate_rows")
    return r.withColumn("feature", F.array("f1", "f2", "f3", "f4")).drop("f1", "f2", "f3", "f4")


def known_nodes(spark, sf):
    m = t.view(spark, sf, "a_memory")
    j = F.col("ord") % 50
    feature = F.array(*[(c).cast("double") for c in (1 + j % 4, 1 + j % 6, j % 5 - 2, j % 3 - 1)])
    return m.select(
        "scene_id", "node_id", F.when(j % 5 != 0, F.col("name")).alias("name"), "color",
        feature.alias("feature"),
    )


_KNOWN = """
 known AS (SELECT scene_id, node_id, CASE WHEN ord%50%5<>0 THEN name END AS name, color, CAST(1+ord%50%4 AS DOUBLE) AS g1, CAST(1+ord%50%6 AS DOUBLE) AS g2, CAST(ord%50%5-2 AS DOUBLE) AS g3, CAST(ord%50%3-1 AS DOUBLE) AS g4 FROM {a_memory})"""
_NOVEL = f"""
 novel AS (SELECT r.* FROM {{a_candidate_rows}} r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.scene_id=r.scene_id AND (
   (r.name IS NOT NULL AND k.name IS NOT NULL AND {fam('r.name')}={fam('k.name')} AND (r.color='' OR k.color='' OR r.color=k.color))
   OR (r.name IS NULL AND (f1*g1+f2*g2+f3*g3+f4*g4)/greatest(sqrt(f1*f1+f2*f2+f3*f3+f4*f4)*sqrt(g1*g1+g2*g2+g3*g3+g4*g4),1e-9)>=0.9))))"""


@query("novel_candidates", f"WITH {_KNOWN},{_NOVEL} SELECT scene_id, ord, name, color FROM novel")
def novel_candidates(spark, sf):
    return learn.novel(candidate_rows(spark, sf), known_nodes(spark, sf), 0.9).select(
        "scene_id", "ord", "name", "color"
    )


_POOLED = f"""
 firsts AS (SELECT *, CASE WHEN name IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY scene_id, name IS NULL, CASE WHEN name IS NOT NULL THEN {fam('name')} END, color) END AS first_ord FROM {{a_candidate_rows}}),
 numbered AS (SELECT *, concat('cand_', dense_rank() OVER (PARTITION BY scene_id ORDER BY first_ord)) AS candidate_id FROM firsts)"""


def pooled(spark, sf):
    rows = candidate_rows(spark, sf).withColumn("center", F.lit(None).cast("struct<x:double,y:double,z:double>"))
    return learn.pool_candidates(rows)


@query("candidate_pool", f"""
WITH {_POOLED}
SELECT scene_id, candidate_id, arg_min(frame, ord) AS first_seen, arg_max(frame, ord) AS last_seen, count(*) AS n_observations, arg_min(label_hint, ord) AS label_hint,
 arg_max(name, ord) AS name, CASE WHEN max(name) IS NOT NULL THEN arg_max(color, ord) END AS color FROM numbered GROUP BY 1,2""")
def candidate_pool(spark, sf):
    """Pool of all rows by meaning alone: no row carries a place."""
    return learn.candidates(pooled(spark, sf)).drop("center")


@query("candidate_appearances", f"""
WITH {_POOLED}
SELECT scene_id, candidate_id, row_number() OVER (PARTITION BY scene_id, candidate_id ORDER BY ord) AS place, frame, CAST(trunc(cx*37.3) AS INT) AS x1, CAST(trunc(cy*21.7-30) AS INT) AS y1,
 CAST(trunc(cx*37.3+10.9) AS INT) AS x2, CAST(trunc(cy*21.7-15.2) AS INT) AS y2, concat('crop_', ord) AS crop_file FROM numbered""")
def candidate_appearances(spark, sf):
    sides = {"x1": F.col("cx") * 37.3, "y1": F.col("cy") * 21.7 - 30, "x2": F.col("cx") * 37.3 + 10.9, "y2": F.col("cy") * 21.7 - 15.2}
    seen = pooled(spark, sf).withColumns({
        "bbox": F.struct(*[v.alias(k) for k, v in sides.items()]), "crop_file": F.concat(F.lit("crop_"), F.col("ord").cast("string"))})
    return learn.appearances(seen).select("scene_id", "candidate_id", "place", "frame", "bbox.*", "crop_file")


@query("candidate_pool_placed")
def candidate_pool_placed(spark, sf):
    """Pool of the novel rows with places, where arrival order matters."""
    rows = learn.novel(candidate_rows(spark, sf), known_nodes(spark, sf), 0.9).withColumn(
        "center", g.make_point(F.col("cx"), F.col("cy"), F.lit(0.5))
    )
    return learn.candidates(learn.pool_candidates(rows)).drop("center")


@query("pool_stats", f"""
WITH {_POOLED}, {_KNOWN}, {_NOVEL}
SELECT a.scene_id, CASE WHEN n.ord IS NULL THEN 'known_skip' WHEN n.name IS NULL OR n.ord=f.first_ord THEN 'new' ELSE 'merged' END AS action, count(*) AS n
FROM {{a_candidate_rows}} a LEFT JOIN novel n ON n.scene_id=a.scene_id AND n.ord=a.ord
LEFT JOIN (SELECT scene_id, {fam('name')} AS fm, color, min(ord) AS first_ord FROM novel WHERE name IS NOT NULL GROUP BY 1,2,3) f ON f.scene_id=n.scene_id AND f.fm={fam('n.name')} AND f.color=n.color
GROUP BY 1,2""")
def pool_stats(spark, sf):
    rows = candidate_rows(spark, sf)
    fresh = learn.novel(rows, known_nodes(spark, sf), 0.9).withColumn(
        "center", F.lit(None).cast("struct<x:double,y:double,z:double>")
    )
    return learn.pool_stats(rows, learn.pool_candidates(fresh))


@query("covered_detections", """
WITH i AS (SELECT scene_id, class, min(frame_no) AS f, max(frame_no) AS l, arg_max(frame, conf*1000000000-ord) AS ef, arg_max(x1, conf*1000000000-ord) AS a1, arg_max(y1, conf*1000000000-ord) AS b1, arg_max(x2, conf*1000000000-ord) AS a2, arg_max(y2, conf*1000000000-ord) AS b2 FROM {a_detections} GROUP BY 1,2)
SELECT d.scene_id, d.ord FROM {a_detections} d WHERE conf>=0.45 AND NOT EXISTS (SELECT 1 FROM i WHERE i.scene_id=d.scene_id AND i.class=d.class AND i.ef=d.frame AND d.frame_no BETWEEN f AND l
 AND (x1+x2)/2 BETWEEN a1-(a2-a1)*0.5 AND a2+(a2-a1)*0.5 AND (y1+y2)/2 BETWEEN b1-(b2-b1)*0.5 AND b2+(b2-b1)*0.5)""")
def covered_detections(spark, sf):
    d = t.detections(spark, sf)
    best = F.struct("conf", -F.col("ord"))
    inst = d.groupBy("scene_id", "class").agg(
        F.min("frame_no").alias("first_no"), F.max("frame_no").alias("last_no"),
        F.max_by("frame", best).alias("evidence_frame"), F.max_by("bbox", best).alias("evidence_box"),
    )
    return learn.uncovered(d, inst).select("scene_id", "ord")


@query("merge_duplicates")
def merge_duplicates(spark, sf):
    """Instances per scene, class and look, merged where they are the same object."""
    o = t.view(spark, sf, "a_candidate_rows")
    look = F.col("f1").cast("long")
    inst = o.groupBy("scene_id", "label_hint", "f1").agg(
        F.min("ord").alias("ord"), F.max_by("name", "ord").alias("name"),
        F.max_by("color", "ord").alias("color"), F.median("cx").alias("x"), F.median("cy").alias("y"),
        F.min("frame_no").alias("first_no"), F.max("frame_no").alias("last_no"),
        F.countDistinct("frame_no").alias("n_observations"), F.count(F.lit(1)).alias("n"),
    ).select(
        "scene_id", "ord",
        F.concat("label_hint", F.lit("_"), look.cast("string")).alias("instance_id"),
        F.col("label_hint").alias("class"), F.when(look % 3 != 0, F.col("name")).alias("name"),
        F.when(look % 5 != 0, F.col("color")).otherwise("").alias("color"),
        F.array(F.lit(1.0), look % 4, look % 3).cast("array<double>").alias("feature"),
        g.make_point(F.col("x"), F.col("y"), F.lit(1.0)).alias("center"),
        "first_no", "last_no", "n_observations", (F.col("n") / 100).alias("median_conf"),
    )
    rows, _ = learn.merge_duplicates(inst)
    return rows.select("scene_id", "instance_id", "class", "first_no", "last_no", "n_observations")


_VIEWS = """
 views AS (SELECT concat(CAST(scene_id AS VARCHAR),'_',CAST(k3%40 AS VARCHAR)) AS cand, k1*1000000000+k2*100000000+k3*10000+k4 AS ord, CASE k4%3 WHEN 0 THEN '椅子' WHEN 1 THEN '办公椅' ELSE class END AS name, CASE WHEN k4%7=0 THEN '' ELSE color END AS color, k4, k1 FROM {a_sightings}),
 conf AS (SELECT cand, ord, name, color, CASE k4%2 WHEN 0 THEN 'ocr' ELSE 'interactive' END AS source, CASE WHEN k4%4=0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM views WHERE k1%20=0)"""


@query("confirm_upgrade", f"""
WITH {_VIEWS},
 vg AS (SELECT cand, {fam('name')} AS f, trim(color) AS c, count(*) AS n, arg_max(name, ord) AS name, min(ord) AS "at" FROM views WHERE name<>'' GROUP BY 1,2,3 HAVING count(*)>=2),
 u AS (SELECT cand, f, c, name, 0.7::DOUBLE AS weight, 'multi_view' AS source, 0 AS stage, vg.at AS "at" FROM vg
   UNION ALL SELECT cand, {fam('name')}, trim(color), name, weight, source, 1, ord FROM conf WHERE name<>''),
 g AS (SELECT cand, f, c, round(sum(weight),9) AS weight, arg_max(name, [stage, u."at"]) AS name, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min([stage,u."at"]) AS "at" FROM u GROUP BY 1,2,3),
 b AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY weight DESC, contains(sources,'interactive') DESC, contains(sources,'ocr') DESC, g."at") AS rn FROM g)
SELECT a.cand AS candidate_id, coalesce(weight>=0.7,false) AS upgrade, CASE WHEN weight>=0.7 THEN name ELSE '' END AS name, CASE WHEN weight>=0.7 THEN c ELSE '' END AS color, CASE WHEN weight>=0.7 THEN sources ELSE '' END AS sources,
 round(CASE WHEN weight>=0.7 THEN least(1.0, weight/0.7) ELSE 0 END,6) AS confidence FROM (SELECT DISTINCT cand FROM views) a LEFT JOIN b ON b.cand=a.cand AND rn=1""")
def confirm_upgrade(spark, sf):
    s = t.view(spark, sf, "a_sightings")
    views = s.select(
        F.concat(F.col("scene_id").cast("string"), F.lit("_"), (F.col("k3") % 40).cast("string")).alias("candidate_id"),
        (F.col("k1") * 1000000000 + F.col("k2") * 100000000 + F.col("k3") * 10000 + F.col("k4")).alias("ord"),
        F.when(F.col("k4") % 3 == 0, "椅子").when(F.col("k4") % 3 == 1, "办公椅").otherwise(F.col("class")).alias("name"),
        F.when(F.col("k4") % 7 == 0, "").otherwise(F.col("color")).alias("color"), "k4", "k1",
    )
    conf = views.filter(F.col("k1") % 20 == 0).select(
        "candidate_id", "ord", "name", "color",
        F.when(F.col("k4") % 2 == 0, "ocr").otherwise("interactive").alias("source"),
        F.when(F.col("k4") % 4 == 0, 0.5).otherwise(1.0).alias("weight"),
    )
    return learn.decide_upgrades(views, conf).withColumn(
        "confidence", F.round("confidence", 6)
    ).drop("reason")


@query("remaining_candidates", f"""
WITH {_POOLED}, c AS (SELECT scene_id, candidate_id, count(*) AS n FROM numbered GROUP BY 1,2)
SELECT scene_id, candidate_id, n AS n_observations FROM c WHERE n<3""")
def remaining_candidates(spark, sf):
    everyone = learn.candidates(pooled(spark, sf))
    confirmed = everyone.filter(F.col("n_observations") >= 3)
    return learn.remaining(everyone, confirmed, ["scene_id", "candidate_id"]).select(
        "scene_id", "candidate_id", "n_observations"
    )


def _turned(c: str, n: int):
    return F.transform(c, lambda v, i: F.when(i < n, -v.cast("double")).otherwise(v.cast("double")))


_COS = "list_cosine_similarity(CAST(list_transform(q.embedding, lambda v, i: CASE WHEN i<={n} THEN -v ELSE v END) AS DOUBLE[]), CAST(m.embedding AS DOUBLE[]))"


@query("reid_best", f"""
WITH s AS (SELECT q.scene_id, q.query_id, min(m.vec_id) AS sid FROM {{a_vector_asks}} q JOIN {{a_features}} m ON m.scene_id=q.scene_id AND q.name IS NOT NULL AND m.name IS NOT NULL AND lower(q.name)=lower(m.name) AND (q.color='' OR m.color='' OR q.color=m.color) GROUP BY 1,2),
 c AS (SELECT q.scene_id, q.query_id, m.vec_id, round({_COS.replace('{n}','2')},9) AS sim FROM {{a_vector_asks}} q JOIN {{a_features}} m ON m.scene_id=q.scene_id
   WHERE NOT (q.name IS NOT NULL AND m.name IS NOT NULL AND q.color<>'' AND m.color<>'' AND q.color<>m.color)),
 w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rn FROM c WHERE sim>0) z WHERE rn=1)
SELECT q.scene_id, q.query_id, CASE WHEN sid IS NOT NULL THEN sid WHEN sim>=0.95 THEN w.vec_id END AS match_id,
 CASE WHEN sid IS NOT NULL THEN 'strong' WHEN sim>=0.95 THEN 'weak' ELSE 'none' END AS tier, round(CASE WHEN sid IS NOT NULL THEN 1.0 ELSE coalesce(sim,0) END,6) AS similarity
FROM {{a_vector_asks}} q LEFT JOIN s ON s.query_id=q.query_id LEFT JOIN w ON w.query_id=q.query_id""")
def reid_best(spark, sf):
    asks = t.view(spark, sf, "a_vector_asks").withColumn("feature", _turned("embedding", 2))
    known = t.view(spark, sf, "a_features").select(
        "scene_id", F.col("vec_id").alias("ord"), F.col("vec_id").alias("node_id"),
        F.col("embedding").cast("array<double>").alias("feature"), "name", "color",
    )
    return learn.reidentify(asks, known).select(
        "scene_id", "query_id", "match_id", "tier", F.round("similarity", 6).alias("similarity")
    )


@query("kb_topk", f"""
SELECT query_id, rank, match_id, round(sim,6) AS similarity FROM (
 SELECT q.query_id, m.vec_id AS match_id, sim, row_number() OVER (PARTITION BY q.query_id ORDER BY sim DESC, m.vec_id) AS rank
 FROM (SELECT q.query_id, m.vec_id, round({_COS.replace('{n}','6')},9) AS sim FROM {{a_vector_asks}} q, {{a_features}} m) x(query_id, vec_id, sim)
 JOIN {{a_vector_asks}} q ON q.query_id=x.query_id JOIN {{a_features}} m ON m.vec_id=x.vec_id WHERE sim>=0.7) r WHERE rank<=3""")
def kb_topk(spark, sf):
    """Three closest stored vectors of each asked one, if close enough."""
    asks = t.view(spark, sf, "a_vector_asks").select(
        F.lit(0).alias("kb"), "query_id", _turned("embedding", 6).alias("feature"), F.lit("").alias("conflict")
    )
    store = t.view(spark, sf, "a_features").select(
        F.lit(0).alias("kb"), F.col("vec_id").alias("match_id"), F.col("vec_id").alias("match_ord"),
        F.col("embedding").cast("array<double>").alias("feature"), F.lit("").alias("conflict"),
    )
    return best_matches(asks, store, ["kb"], 3, 0.7, digits=9).select(
        "query_id", "rank", "match_id", F.round("similarity", 6).alias("similarity")
    )


@query("evidence_fallback", """
WITH i AS (SELECT scene_id, class, min(frame) AS first_frame, count(*) AS n FROM {a_detections} GROUP BY 1,2),
 b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame, class ORDER BY conf DESC, ord) AS rn FROM {a_detections})
SELECT i.scene_id, i.class, CASE WHEN n%3=0 THEN 'frame_000001.jpg' ELSE b.frame END AS frame, CASE WHEN n%3=0 THEN 0.5 ELSE b.conf END AS conf
FROM i JOIN b ON b.scene_id=i.scene_id AND b.class=i.class AND b.frame=i.first_frame AND rn=1""")
def evidence_fallback(spark, sf):
    d = t.detections(spark, sf)
    own = F.struct(
        F.lit("frame_000001.jpg").alias("frame"), F.lit(0.5).alias("conf"),
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (0.0, 0.0, 50.0, 50.0))]).alias("bbox"),
    )
    narrow = F.struct(
        F.lit("frame_000001.jpg").alias("frame"), F.lit(0.5).alias("conf"),
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (0.0, 0.0, 3.0, 50.0))]).alias("bbox"),
    )
    inst = d.groupBy("scene_id", "class").agg(
        F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("n")
    ).withColumn(
        "evidence", F.when(F.col("n") % 3 == 0, own).when(F.col("n") % 3 == 1, narrow)
    )
    return evidence.fill_evidence(inst, d).select(
        "scene_id", "class", "evidence.frame", "evidence.conf"
    )


@query("label_work", """
SELECT crop_key, min(ord) AS first_ord FROM (SELECT concat('det:',scene_id,'/',frame,':',class) AS crop_key, ord FROM {a_detections}) k
WHERE crop_key NOT IN (SELECT concat('det:',scene_id,'/',frame,':',class) FROM {a_detections} WHERE conf>0.6 AND ord%2=0) GROUP BY 1""")
def label_work(spark, sf):
    """Crops a labeller has still to be asked about."""
    d = t.detections(spark, sf).withColumn("crop_key", F.concat(F.lit("det:"), F.col("scene_id").cast("string"), F.lit("/"), "frame", F.lit(":"), "class"))
    items = d.groupBy("crop_key").agg(F.min("ord").alias("first_ord"))
    cache = d.filter((F.col("conf") > 0.6) & (F.col("ord") % 2 == 0)).select(
        "crop_key", F.lit("n").alias("name"), F.lit("c").alias("color")
    ).dropDuplicates(["crop_key"])
    return evidence.label_work(items, cache)


@query("combined_memory", f"""
WITH {_POOLED}, c AS (SELECT scene_id, candidate_id, count(*) AS n, arg_max(name, ord) AS name, CASE WHEN max(name) IS NOT NULL THEN arg_max(color, ord) END AS color, arg_min(label_hint, ord) AS hint FROM numbered GROUP BY 1,2)
SELECT scene_id, node_id, CASE WHEN j%2=0 THEN name ELSE label END AS name, CASE WHEN j%2=0 THEN m.color ELSE '' END AS color, 'instance' AS source, label AS label_hint
FROM (SELECT o.scene_id, o.node_id, o.j, o.label, x.name, x.color FROM {{a_objects}} o JOIN {{a_memory}} x ON x.ord=o.ord) m
UNION ALL SELECT scene_id, candidate_id, name, color, 'multi_view', hint FROM c WHERE n>=3""")
def combined_memory(spark, sf):
    o = t.objects(spark, sf).select(
        "scene_id", F.col("node_id").alias("instance_id"), "ord", F.col("label").alias("class"),
        F.col("conf").alias("median_conf"), g.box_center(F.col("box")).alias("center"), "j",
    )
    said = t.view(spark, sf, "a_memory").select(
        "scene_id", F.col("node_id").alias("instance_id"), F.col("name").alias("said_name"),
        F.col("color").alias("said_color"), (F.col("ord") % 50 % 2 == 0).alias("agreed"),
    )
    confirmed = learn.candidates(pooled(spark, sf)).filter(F.col("n_observations") >= 3).withColumns(
        {"sources": F.array(F.lit("multi_view")), "confidence": F.lit(1.0), "ord": F.lit(0).cast("long")}
    )
    return evidence.combined_memory(o, said, confirmed).select(
        "scene_id", "node_id", "name", "color", "source", "label_hint"
    )


# ---- changes over time ------------------------------------------------------------------------------------------

_CORR = """
 corr AS (SELECT concat('obj_', CAST(l_partkey AS VARCHAR)) AS node_id, l_orderkey*100000000000+l_linenumber*10000000000+l_partkey*10000+l_suppkey AS ord, l_orderkey AS t_s,
   CASE l_suppkey%3 WHEN 0 THEN '' WHEN 1 THEN concat('n',CAST(l_suppkey%5 AS VARCHAR)) ELSE '暖风机' END AS new_name, CASE l_suppkey%4 WHEN 0 THEN '白色' WHEN 1 THEN '' ELSE concat('c',CAST(l_orderkey%4 AS VARCHAR)) END AS new_color FROM {lineitem})"""


_ORDERS_1000 = 10**14  # a thousand orders in units of the line order


def _line_order():
    return (
        F.col("l_orderkey") * 10**11 + F.col("l_linenumber") * 10**10
        + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    )


def _corrections(spark, sf):
    li = t.view(spark, sf, "lineitem")
    k, o = F.col("l_suppkey"), F.col("l_orderkey")
    return li.select(
        F.concat(F.lit("obj_"), F.col("l_partkey").cast("string")).alias("node_id"),
        _line_order().alias("ord"), o.alias("t_s"),
        F.lit("interactive").alias("source"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("n"), (k % 5).cast("string"))).otherwise("暖风机").alias("new_name"),
        F.when(k % 4 == 0, "白色").when(k % 4 == 1, "").otherwise(F.concat(F.lit("c"), (o % 4).cast("string"))).alias("new_color"),
    )


def _named_nodes(spark, sf):
    return t.objects(spark, sf).select(
        "node_id", F.col("label").alias("name"), "color", F.col("conf").alias("confidence"),
        F.when(F.col("j") % 4 != 0, g.box_center(F.col("box"))).alias("center"),
    )


@query("corrections_applied", f"""
WITH RECURSIVE {_CORR.strip()}, n AS (SELECT node_id, count(*) AS n, arg_max(new_name, ord) FILTER (WHERE new_name<>'') AS nn, arg_max(new_color, ord) FILTER (WHERE new_color<>'') AS nc FROM corr GROUP BY 1),
 fold AS (SELECT o.node_id, conf AS c, 0 AS i, coalesce(n.n,0) AS n FROM {{a_objects}} o LEFT JOIN n ON n.node_id=o.node_id UNION ALL SELECT node_id, CAST(round_even(c*0.5,3) AS DOUBLE), i+1, n FROM fold WHERE i<n)
SELECT o.node_id, coalesce(nn, label) AS name, coalesce(nc, color) AS color, round(f.c,6) AS confidence, coalesce(n.n,0) AS n_corrections
FROM {{a_objects}} o LEFT JOIN n ON n.node_id=o.node_id JOIN fold f ON f.node_id=o.node_id AND f.i=f.n""")
def corrections_applied(spark, sf):
    nodes, _ = lifecycle.apply_corrections(
        _named_nodes(spark, sf), _corrections(spark, sf), bucket=_ORDERS_1000
    )
    return nodes.select("node_id", "name", "color", F.round("confidence", 6).alias("confidence"), "n_corrections")


@query("corrections_slow_fade", f"""
WITH RECURSIVE {_CORR.strip()}, n AS (SELECT node_id, count(*) AS n FROM corr GROUP BY 1),
 fold AS (SELECT o.node_id, conf AS c, 0 AS i, coalesce(n.n,0) AS n FROM {{a_objects}} o LEFT JOIN n ON n.node_id=o.node_id UNION ALL SELECT node_id, CAST(round_even(c*0.95,3) AS DOUBLE), i+1, n FROM fold WHERE i<n)
SELECT node_id, round(c,6) AS confidence, n AS n_corrections FROM fold WHERE i=n""")
def corrections_slow_fade(spark, sf):
    nodes, _ = lifecycle.apply_corrections(
        _named_nodes(spark, sf), _corrections(spark, sf), factor=0.95, bucket=_ORDERS_1000
    )
    return nodes.select("node_id", F.round("confidence", 6).alias("confidence"), "n_corrections")


@query("correction_log", f"""
WITH {_CORR}, h AS (SELECT c.*, label, color, last_value(nullif(new_name,'') IGNORE NULLS) OVER w AS pn, last_value(nullif(new_color,'') IGNORE NULLS) OVER w AS pc
 FROM corr c JOIN {{a_objects}} o ON o.node_id=c.node_id WINDOW w AS (PARTITION BY c.node_id ORDER BY c.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT node_id, ord, coalesce(pn,label) AS old_name, coalesce(nullif(new_name,''),pn,label) AS new_name, coalesce(pc,color) AS old_color, coalesce(nullif(new_color,''),pc,color) AS new_color FROM h""")
def correction_log(spark, sf):
    _, log = lifecycle.apply_corrections(
        _named_nodes(spark, sf), _corrections(spark, sf), bucket=_ORDERS_1000
    )
    return log.drop("t_s", "source")


@query("node_sources", f"""
WITH {_CORR}, n AS (SELECT node_id, CASE j%3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['vlm'] ELSE ['vlm','user'] END AS own FROM {{a_objects}})
SELECT node_id, CAST(unnest(range(1, len(own)+1)) AS BIGINT) AS place, unnest(own) AS source FROM n
UNION ALL SELECT c.node_id, len(own) + row_number() OVER (PARTITION BY c.node_id ORDER BY ord), concat('s', t_s % 3) FROM corr c JOIN n ON n.node_id=c.node_id""")
def node_sources(spark, sf):
    j = F.col("j") % 3
    own = F.when(j == 0, F.array().cast("array<string>")).when(j == 1, F.array(F.lit("vlm"))).otherwise(
        F.array(F.lit("vlm"), F.lit("user")))
    said = _corrections(spark, sf).withColumn("source", F.concat(F.lit("s"), (F.col("t_s") % 3).cast("string")))
    return lifecycle.node_sources(t.objects(spark, sf).select("node_id", own.alias("sources")), said, _ORDERS_1000)


@query("moves_history", """
WITH mv AS (SELECT concat('obj_', CAST(l_partkey AS VARCHAR)) AS node_id, l_orderkey*100000000000+l_linenumber*10000000000+l_partkey*10000+l_suppkey AS ord, l_orderkey AS t_s, CAST(l_suppkey%60 AS DOUBLE)/10 AS x FROM {lineitem}),
 p AS (SELECT m.node_id, m.ord, t_s, lag(x) OVER (PARTITION BY m.node_id ORDER BY m.ord) AS px, j, (xmin+xmax)/2 AS sx FROM mv m JOIN {a_objects} o ON o.node_id=m.node_id)
SELECT node_id, ord, round(CASE WHEN px IS NOT NULL THEN px ELSE sx END,6) AS old_x, t_s AS archived_at_s FROM p WHERE px IS NOT NULL OR j%4<>0""")
def moves_history(spark, sf):
    moves = t.view(spark, sf, "lineitem").select(
        F.concat(F.lit("obj_"), F.col("l_partkey").cast("string")).alias("node_id"),
        _line_order().alias("ord"),
        F.col("l_orderkey").alias("t_s"),
        g.make_point((F.col("l_suppkey") % 60) / 10, 0.0, 0.0).alias("center"),
    )
    _, archived = lifecycle.move_nodes(_named_nodes(spark, sf), moves, _ORDERS_1000)
    return archived.select(
        "node_id", "ord", F.round("old_center.x", 6).alias("old_x"), "archived_at_s"
    )


@query("stale_nodes", """
SELECT device_id, round(max(epoch_s),3) AS last_seen_s, CASE WHEN (SELECT max(epoch_s) FROM {a_frames}) - max(epoch_s) > 36000 THEN 'stale' ELSE 'active' END AS status FROM {a_frames} GROUP BY 1""")
def stale_nodes(spark, sf):
    seen = t.view(spark, sf, "a_frames").groupBy("device_id").agg(F.max("epoch_s").alias("last"))
    now = seen.agg(F.max("last").alias("now_s"))
    return seen.join(F.broadcast(now)).select(
        "device_id", F.round("last", 3).alias("last_seen_s"),
        lifecycle.stale_status(F.col("last"), F.col("now_s"), 36000.0).alias("status"),
    )


_SIGHT = """
 sight AS (SELECT l_orderkey%50 AS scene_id, concat('o',CAST(l_partkey%40 AS VARCHAR)) AS subject, CASE l_linenumber%3 WHEN 0 THEN 'on' WHEN 1 THEN 'near' ELSE 'in' END AS predicate, concat('s',CAST(l_suppkey%4 AS VARCHAR)) AS object,
   l_quantity/50 AS confidence, CAST(l_orderkey%977 AS DOUBLE) AS t_s, l_orderkey*100000000000+l_linenumber*10000000000+l_partkey*10000+l_suppkey AS ord, concat('v',CAST(l_suppkey%3 AS VARCHAR)) AS tag, l_returnflag AS val FROM {lineitem})"""


def _relation_sightings(spark, sf):
    li = t.view(spark, sf, "lineitem")
    n = F.col("l_linenumber") % 3
    return li.select(
        (F.col("l_orderkey") % 50).alias("scene_id"),
        F.concat(F.lit("o"), (F.col("l_partkey") % 40).cast("string")).alias("subject"),
        F.when(n == 0, "on").when(n == 1, "near").otherwise("in").alias("predicate"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("object"),
        (F.col("l_quantity") / 50).alias("confidence"),
        (F.col("l_orderkey") % 977).cast("double").alias("t_s"),
        _line_order().alias("ord"),
        F.create_map(F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")), "l_returnflag").alias("view_tags"),
    )


@query("relation_upsert", f"""
WITH {_SIGHT}, a AS (SELECT scene_id, subject, predicate, object, max(confidence) AS confidence, arg_min(t_s, ord) AS first_seen_s, max(t_s) AS last_seen_s, count(*) AS confirmations FROM sight GROUP BY 1,2,3,4),
 tg AS (SELECT scene_id, subject, predicate, object, string_agg(concat(tag,'=',val), ',' ORDER BY tag) AS tags FROM (SELECT scene_id, subject, predicate, object, tag, arg_max(val, ord) AS val FROM sight GROUP BY 1,2,3,4,5) x GROUP BY 1,2,3,4)
SELECT a.*, tags, CASE WHEN confirmations>=2 THEN 'active' ELSE 'archived' END AS status FROM a JOIN tg USING (scene_id, subject, predicate, object)""")
def relation_upsert(spark, sf):
    out = lifecycle.upsert_relations(_relation_sightings(spark, sf), min_confirmations=2)
    tags = F.array_join(
        F.transform(F.map_entries("view_tags"), lambda e: F.concat(e.key, F.lit("="), e.value)), ","
    )
    return out.withColumn("tags", tags).drop("view_tags", "first_ord")


@query("archived_split", f"""
WITH {_SIGHT}, a AS (SELECT scene_id, subject, predicate, object, count(*) AS n FROM sight GROUP BY 1,2,3,4), e AS (SELECT scene_id, subject, predicate, object, max(t_s) AS t FROM sight WHERE val='R' GROUP BY 1,2,3,4)
SELECT scene_id, CASE WHEN n>=2 AND e.t IS NULL THEN 'active' ELSE 'archived' END AS status, count(*) AS n FROM a LEFT JOIN e USING (scene_id, subject, predicate, object) GROUP BY 1,2""")
def archived_split(spark, sf):
    """Active and archived relations after some were ended."""
    seen = _relation_sightings(spark, sf)
    ended = seen.filter(F.array_contains(F.map_values("view_tags"), "R"))
    table = lifecycle.archive_relations(lifecycle.upsert_relations(seen, min_confirmations=2), ended)
    return table.groupBy("scene_id", "status").agg(F.count(F.lit(1)).alias("n"))


def _ingest_batch(spark, sf):
    li = t.view(spark, sf, "lineitem")
    k = F.col("l_suppkey")
    zero = F.lit(0.0)
    return li.select(
        (F.col("l_orderkey") % 50).alias("scene_id"),
        F.concat(F.lit("o"), (F.col("l_partkey") % 40).cast("string")).alias("node_id"),
        _line_order().alias("ord"),
        (F.col("l_orderkey") % 977).cast("double").alias("t_s"),
        F.concat(F.lit("l"), (k % 6).cast("string")).alias("label"), F.lit("").alias("category"),
        F.lit("room_1").alias("parent_id"), (F.col("l_quantity") / 50).alias("confidence"),
        F.when(k % 5 != 0, g.make_box(k, zero, zero, k, zero, zero)).alias("box"),
        F.create_map("l_returnflag", "l_linestatus").alias("attributes"),
    )


@query("object_ingest", """
WITH b AS (SELECT l_orderkey%50 AS scene_id, concat('o',CAST(l_partkey%40 AS VARCHAR)) AS node_id, l_orderkey*100000000000+l_linenumber*10000000000+l_partkey*10000+l_suppkey AS ord, CAST(l_orderkey%977 AS DOUBLE) AS t_s,
  concat('l',CAST(l_suppkey%6 AS VARCHAR)) AS label, l_quantity/50 AS confidence, CASE WHEN l_suppkey%5<>0 THEN CAST(l_suppkey AS DOUBLE) END AS bx, l_returnflag AS k, l_linestatus AS v FROM {lineitem}),
 a AS (SELECT scene_id, node_id, arg_min(label, ord) AS label, arg_min(confidence, ord) AS confidence, min(ord) AS mo, max(t_s) AS last_seen_s, arg_max(t_s, ord) AS last_updated_s, arg_min(t_s, ord) AS first_seen_s, arg_max(bx, ord) FILTER (WHERE bx IS NOT NULL) AS bx FROM b GROUP BY 1,2),
 tg AS (SELECT scene_id, node_id, string_agg(concat(k,'=',v), ',' ORDER BY k) AS attrs FROM (SELECT scene_id, node_id, k, arg_max(v, ord) AS v FROM b GROUP BY 1,2,3) x GROUP BY 1,2)
SELECT a.scene_id, a.node_id, label, confidence, first_seen_s, last_seen_s, last_updated_s, bx AS xmin, attrs FROM a JOIN tg USING (scene_id, node_id)""")
def object_ingest(spark, sf):
    out = lifecycle.ingest_objects(_ingest_batch(spark, sf))
    attrs = F.array_join(
        F.transform(F.map_entries("attributes"), lambda e: F.concat(e.key, F.lit("="), e.value)), ","
    )
    return out.select(
        "scene_id", "node_id", "label", "confidence", "first_seen_s", "last_seen_s", "last_updated_s",
        F.col("box.xmin").alias("xmin"), attrs.alias("attrs"),
    )
