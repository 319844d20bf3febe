"""Box, pose and camera expressions over struct columns (all inside codegen).

A *box* is ``struct<xmin,ymin,zmin,xmax,ymax,zmax>``, a *point* ``struct<x,y,z>`` and a
*pose* ``struct<r00..r22,tx,ty,tz>``, all DOUBLE; z is up, lengths are metres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX_FIELDS = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")
ROTATION_FIELDS = tuple(f"r{i}{j}" for i in range(3) for j in range(3))
POSE_FIELDS = (*ROTATION_FIELDS, "tx", "ty", "tz")
TINY = 1e-9


def _named(fields, values) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(f) if not isinstance(v, Column)
                      else v.cast("double").alias(f) for f, v in zip(fields, values)])


def make_box(*extent) -> Column:
    return _named(BOX_FIELDS, extent)


def make_point(x, y, z) -> Column:
    return _named(("x", "y", "z"), (x, y, z))


def make_pose(rotation, translation) -> Column:
    """``rotation`` is nine columns row by row, ``translation`` three."""
    return _named(POSE_FIELDS, (*rotation, *translation))


def box_columns(prefix: str = "") -> Column:
    """Six flat columns of a table seen as a box."""
    return make_box(*[F.col(prefix + f) for f in BOX_FIELDS])


# ---- boxes -----------------------------------------------------------------------------


def box_center(box: Column) -> Column:
    return make_point(
        (box.xmin + box.xmax) / 2, (box.ymin + box.ymax) / 2, (box.zmin + box.zmax) / 2
    )


def position(center: Column, box: Column) -> Column:
    """Explicit centre, else the middle of the box, else the origin."""
    return F.coalesce(
        center, F.when(box.isNotNull(), box_center(box)), make_point(0.0, 0.0, 0.0)
    )


def footprint_area(box: Column) -> Column:
    return F.greatest(F.lit(TINY), (box.xmax - box.xmin) * (box.ymax - box.ymin))


def footprint_overlap(a: Column, b: Column) -> Column:
    """Shared floor area over the smaller floor area."""
    width = F.greatest(F.lit(0.0), F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin))
    depth = F.greatest(F.lit(0.0), F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin))
    return (width * depth) / F.least(footprint_area(a), footprint_area(b))


def euclidean(a: Column, b: Column) -> Column:
    dx, dy, dz = a.x - b.x, a.y - b.y, a.z - b.z
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def horizontal_distance(a: Column, b: Column) -> Column:
    dx, dy = a.x - b.x, a.y - b.y
    return F.sqrt(dx * dx + dy * dy)


def box_dims_cm(box: Column) -> Column:
    """Extents in whole centimetres (half-even, at least 1), longest first."""
    sides = F.array(
        F.abs(box.xmax - box.xmin), F.abs(box.ymax - box.ymin), F.abs(box.zmax - box.zmin)
    )
    longest_first = F.sort_array(sides, asc=False)
    return F.transform(
        longest_first, lambda v: F.greatest(F.lit(1), F.bround(v * 100, 0).cast("int"))
    )


def _slab(origin: Column, step: Column, low: Column, high: Column):
    """Entry and exit of one axis; a parallel ray is in the slab for ever or never."""
    parallel = F.abs(step) < 1e-12
    inside = (origin >= low) & (origin <= high)
    t1, t2 = F.try_divide(low - origin, step), F.try_divide(high - origin, step)
    forever, never = F.lit(float("inf")), F.lit(float("-inf"))
    enter = F.when(parallel, F.when(inside, never).otherwise(forever)).otherwise(F.least(t1, t2))
    leave = F.when(parallel, F.when(inside, forever).otherwise(never)).otherwise(
        F.greatest(t1, t2)
    )
    return enter, leave


def ray_hits_box(origin: Column, direction: Column, box: Column) -> Column:
    axes = [
        _slab(origin[a], direction[a], box[a + "min"], box[a + "max"]) for a in ("x", "y", "z")
    ]
    return F.greatest(F.lit(0.0), *[enter for enter, _ in axes]) <= F.least(
        *[leave for _, leave in axes]
    )


# ---- poses -----------------------------------------------------------------------------


def _rotate(pose: Column, p) -> list[Column]:
    return [pose[f"r{i}0"] * p[0] + pose[f"r{i}1"] * p[1] + pose[f"r{i}2"] * p[2] for i in range(3)]


def _rotate_back(pose: Column, p) -> list[Column]:
    return [pose[f"r0{i}"] * p[0] + pose[f"r1{i}"] * p[1] + pose[f"r2{i}"] * p[2] for i in range(3)]


def pose_from_quaternion(qx, qy, qz, qw, tx, ty, tz) -> Column:
    rotation = (
        1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw),
        2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw),
        2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy),
    )
    return make_pose(rotation, (tx, ty, tz))


def quaternion_from_pose(pose: Column) -> Column:
    """``struct<qx,qy,qz,qw>``; the largest diagonal term picks the stable branch."""
    m = {f: pose[f] for f in ROTATION_FIELDS}
    trace = m["r00"] + m["r11"] + m["r22"]

    def branch(root: Column, parts) -> Column:
        s = F.sqrt(root) * 2
        return _named(
            ("qx", "qy", "qz", "qw"), [s * 0.25 if p is None else p / s for p in parts]
        )

    up, side, back = m["r21"] - m["r12"], m["r02"] - m["r20"], m["r10"] - m["r01"]
    xy, xz, yz = m["r01"] + m["r10"], m["r02"] + m["r20"], m["r12"] + m["r21"]
    return (
        F.when(trace > 0, branch(trace + 1.0, (up, side, back, None)))
        .when(
            (m["r00"] > m["r11"]) & (m["r00"] > m["r22"]),
            branch(1.0 + m["r00"] - m["r11"] - m["r22"], (None, xy, xz, up)),
        )
        .when(
            m["r11"] > m["r22"],
            branch(1.0 + m["r11"] - m["r00"] - m["r22"], (xy, None, yz, side)),
        )
        .otherwise(branch(1.0 + m["r22"] - m["r00"] - m["r11"], (xz, yz, None, back)))
    )


def camera_center(pose: Column) -> Column:
    """Where a world-to-camera pose stands: minus the rotated-back translation."""
    back = _rotate_back(pose, (pose.tx, pose.ty, pose.tz))
    return make_point(*[-c for c in back])


def yaw_from_pose(pose: Column) -> Column:
    return F.atan2(pose.r10, pose.r00)


def pose_translate(point: Column, pose: Column) -> Column:
    """Rotated-back offset from the pose translation (kept exactly as callers expect it)."""
    return make_point(
        *_rotate_back(pose, (point.x - pose.tx, point.y - pose.ty, point.z - pose.tz))
    )


def to_camera(point: Column, pose: Column) -> Column:
    x, y, z = _rotate(pose, (point.x, point.y, point.z))
    return make_point(x + pose.tx, y + pose.ty, z + pose.tz)


def project(point: Column, pose: Column, lens: Column) -> Column:
    """Pinhole with one radial term: ``struct<u,v,z>``. ``lens`` is ``struct<f,cx,cy,k>``."""
    cam = to_camera(point, pose)
    x = cam.x / F.greatest(cam.z, F.lit(TINY))
    y = cam.y / F.greatest(cam.z, F.lit(TINY))
    stretch = 1.0 + lens.k * (x * x + y * y)
    return _named(
        ("u", "v", "z"), (lens.f * x * stretch + lens.cx, lens.f * y * stretch + lens.cy, cam.z)
    )


def back_project(u: Column, v: Column, depth: Column, pose: Column, lens: Column) -> Column:
    """Pixel and depth to a world point; distortion undone by one division."""
    x, y = (u - lens.cx) / lens.f, (v - lens.cy) / lens.f
    squeeze = 1.0 + lens.k * (x * x + y * y)
    return pose_translate(make_point(x / squeeze * depth, y / squeeze * depth, depth), pose)


def align_point(point: Column, alignment: Column) -> Column:
    """``alignment`` is ``struct<r00..r22,ox,oy,oz,scale>``."""
    p = _rotate(
        alignment, (point.x - alignment.ox, point.y - alignment.oy, point.z - alignment.oz)
    )
    return make_point(*[alignment.scale * c for c in p])


def align_pose(pose: Column, alignment: Column) -> Column:
    """A world-to-camera pose expressed in the aligned frame."""
    rotation = [
        sum((pose[f"r{i}{k}"] * alignment[f"r{j}{k}"] for k in range(1, 3)),
            pose[f"r{i}0"] * alignment[f"r{j}0"])
        for i in range(3) for j in range(3)
    ]
    center = align_point(camera_center(pose), alignment)
    shift = [
        -(rotation[3 * i] * center.x + rotation[3 * i + 1] * center.y
          + rotation[3 * i + 2] * center.z)
        for i in range(3)
    ]
    return make_pose(rotation, shift)


def egocentric(target: Column, pose: Column, front: float = 45.0, side: float = 45.0) -> Column:
    """``struct<distance,bearing_deg,tag,z_rel>`` of a point as the viewer sees it."""
    local = pose_translate(target, pose)
    bearing = F.degrees(F.atan2(local.y, local.x))
    tag = (
        F.when(F.abs(bearing) <= front, "front")
        .when((bearing > front) & (bearing <= front + side), "left_front")
        .when((bearing < -front) & (bearing >= -(front + side)), "right_front")
        .when(F.abs(bearing) > 90 + side / 2, "behind")
        .when(bearing > 0, "left")
        .otherwise("right")
    )
    return F.struct(
        F.sqrt(local.x * local.x + local.y * local.y).alias("distance"),
        bearing.alias("bearing_deg"),
        tag.alias("tag"),
        local.z.alias("z_rel"),
    )


# ---- image boxes -------------------------------------------------------------------------


def unletterbox(cx, cy, w, h, pad_x, pad_y, scale, width, height) -> Column:
    """Centre-size box on a padded canvas to a corner box on the image, clipped."""
    return _named(
        ("x1", "y1", "x2", "y2"),
        (
            F.greatest(F.lit(0.0), (cx - w / 2 - pad_x) / scale),
            F.greatest(F.lit(0.0), (cy - h / 2 - pad_y) / scale),
            F.least(width.cast("double"), (cx + w / 2 - pad_x) / scale),
            F.least(height.cast("double"), (cy + h / 2 - pad_y) / scale),
        ),
    )


def unrotate_quarter(bbox: Column, height: Column) -> Column:
    """Box found on a clockwise-turned image, back on the original of that height."""
    return _named(
        ("x1", "y1", "x2", "y2"),
        (bbox.y1, height - 1 - bbox.x2, bbox.y2, height - 1 - bbox.x1),
    )


def crop_box(bbox: Column, width: Column, height: Column, margin: int = 0) -> Column:
    """Whole-pixel crop clipped to the image; the caller drops crops that are too small."""
    return F.struct(
        F.greatest(F.lit(0), bbox.x1.cast("int") - margin).alias("x1"),
        F.greatest(F.lit(0), bbox.y1.cast("int") - margin).alias("y1"),
        F.least(width.cast("int"), bbox.x2.cast("int") + margin).alias("x2"),
        F.least(height.cast("int"), bbox.y2.cast("int") + margin).alias("y2"),
    )


def bbox_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))
