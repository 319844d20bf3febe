"""Pair finding by grid cells: equi-joins on cells plus an exact filter, never a cross join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomgraph.functions.geometry import BOX_FIELDS, box_center, make_box, ray_hits_box
from roomgraph.operators.scaling import shuffled

# Half of the eight neighbours: with it every unordered pair of cells is visited once.
_HALF_STENCIL = ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))
# A hair over the reach, so that rounding never puts touching rows two cells apart.
_SLACK = 1.001


def near_pairs(
    objects: DataFrame,
    keys: Sequence[str],
    order: str,
    point: Column,
    reach: float,
    keep: Sequence[str],
) -> DataFrame:
    """Pairs whose points are at most ``reach`` apart, once each, lower ``order`` first.

    Columns come back as ``a_<c>`` and ``b_<c>`` for ``c`` in ``keep`` and ``order``, with
    ``distance``.
    """
    keys = list(keys)
    cell = reach * _SLACK
    cols = list(dict.fromkeys([order, *keep]))
    placed = objects.select(
        *keys, *cols, point.x.alias("px"), point.y.alias("py"), point.z.alias("pz")
    )
    cells = {"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)}
    held = [*cols, "px", "py", "pz"]
    right = placed.withColumns(cells).select(
        *keys, "_cx", "_cy", *[F.col(c).alias(f"r_{c}") for c in held]
    )
    steps = F.array(
        *[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _HALF_STENCIL]
    )
    left = (
        placed.withColumns(cells)
        .withColumn("_step", F.explode(steps))
        .select(
            *keys,
            (F.col("_cx") + F.col("_step.x")).alias("_cx"),
            (F.col("_cy") + F.col("_step.y")).alias("_cy"),
            ((F.col("_step.x") == 0) & (F.col("_step.y") == 0)).alias("_same"),
            *[F.col(c).alias(f"l_{c}") for c in held],
        )
    )
    d = [F.col(f"l_{c}") - F.col(f"r_{c}") for c in ("px", "py", "pz")]
    lower = F.col(f"l_{order}") < F.col(f"r_{order}")
    pairs = (
        shuffled(left).join(right, [*keys, "_cx", "_cy"])
        .filter(~F.col("_same") | lower)
        .withColumn("distance", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
        .filter(F.col("distance") <= reach)
    )
    return pairs.select(
        *keys,
        *[F.when(lower, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"a_{c}") for c in cols],
        *[F.when(lower, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(f"b_{c}") for c in cols],
        "distance",
    )


def _level(extent: Column) -> Column:
    """Grid level whose cells (1, 4, 16, ... metres) are at least as wide as the box."""
    return F.ceil(F.log(4.0, F.greatest(extent, F.lit(1.0)))).cast("int")


def _side_of(level: Column) -> Column:
    return F.pow(F.lit(4.0), level)


def _flat(df: DataFrame, keys: list[str], side: str, keep: Sequence[str]) -> DataFrame:
    """Box extents and kept columns as flat ``<side>_...`` columns, with the own grid level."""
    box = F.col("box")
    flat = df.select(
        *keys,
        *[box[f].alias(f"{side}_{f}") for f in BOX_FIELDS],
        *[F.col(c).alias(f"{side}_{c}") for c in keep],
    )
    extent = F.greatest(
        F.col(f"{side}_xmax") - F.col(f"{side}_xmin"), F.col(f"{side}_ymax") - F.col(f"{side}_ymin")
    )
    return flat.withColumn(f"{side}_level", _level(extent))


def _on_grid(df: DataFrame, keys: list[str], other_levels: DataFrame, side: str) -> DataFrame:
    """One row per covered cell, on every level the other side needs.

    A pair meets on the coarser of its two levels, so a box is placed on its own level and
    on the coarser levels that occur on the other side of the same key. A box never covers
    more than a few cells of a level that is at least as wide as itself.
    """
    own = F.col(f"{side}_level")
    levels = F.array_distinct(F.concat(F.array(own), F.filter("_levels", lambda v: v > own)))
    placed = (
        shuffled(df).join(other_levels, keys)
        .withColumn("_lv", F.explode(levels))
        .withColumn("_s", _side_of(F.col("_lv")))
    )
    for axis in ("x", "y"):
        placed = placed.withColumn(
            f"_c{axis}",
            F.explode(
                F.sequence(
                    F.floor(F.col(f"{side}_{axis}min") / F.col("_s")),
                    F.floor(F.col(f"{side}_{axis}max") / F.col("_s")),
                )
            ),
        )
    return placed.drop("_levels", "_s")


def footprint_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_keep: Sequence[str],
    right_keep: Sequence[str],
    left_z: str | None = None,
    right_z: str | None = None,
    z_tol: float | None = None,
) -> DataFrame:
    """Pairs whose floor rectangles touch, each exactly once, as flat ``l_*`` and ``r_*``.

    Both sides carry the ``keys`` and a ``box``. With ``z_tol`` the pairs are also narrowed
    to those whose ``l_<left_z>`` and ``r_<right_z>`` can be that close; the caller applies
    the exact test.
    """
    keys = list(keys)
    l_flat, r_flat = _flat(left, keys, "l", left_keep), _flat(right, keys, "r", right_keep)
    l_levels = l_flat.groupBy(*keys).agg(F.collect_set("l_level").alias("_levels"))
    r_levels = r_flat.groupBy(*keys).agg(F.collect_set("r_level").alias("_levels"))
    a, b = _on_grid(l_flat, keys, r_levels, "l"), _on_grid(r_flat, keys, l_levels, "r")
    on = [*keys, "_lv", "_cx", "_cy"]
    if z_tol is not None:
        width, reach = 2 * z_tol * _SLACK, z_tol * _SLACK
        height = F.col(f"l_{left_z}")
        bands = F.array(F.floor((height - reach) / width), F.floor((height + reach) / width))
        a = a.withColumn("_band", F.explode(F.array_distinct(bands)))
        b = b.withColumn("_band", F.floor(F.col(f"r_{right_z}") / width))
        on.append("_band")
    side = _side_of(F.col("_lv"))
    low = {axis: F.greatest(f"l_{axis}min", f"r_{axis}min") for axis in ("x", "y")}
    pairs = shuffled(a).join(b, on).filter(F.col("_lv") == F.greatest("l_level", "r_level"))
    for axis in ("x", "y"):
        # the cell that holds the lower corner of the shared rectangle reports the pair
        pairs = pairs.filter(
            (low[axis] <= F.least(f"l_{axis}max", f"r_{axis}max"))
            & (F.floor(low[axis] / side) == F.col(f"_c{axis}"))
        )
    return pairs.drop("_lv", "_cx", "_cy", "_band", "l_level", "r_level")


def pair_box(side: str) -> Column:
    """The box of one side of a pair row."""
    return make_box(*[F.col(f"{side}_{f}") for f in BOX_FIELDS])


# ---- things met by a view or a ray ------------------------------------------------------------

#: Edges of the nested cells in metres, from the widest to the leaf.
CELL_EDGES = (64.0, 8.0, 1.0)
LEAF = ("_lx", "_ly", "_lz")


def with_leaf(items: DataFrame, at: Column) -> DataFrame:
    """Add the leaf cell of the place ``at``; the columns are named in ``LEAF``."""
    return items.withColumns(
        {c: F.floor(at[a] / F.lit(CELL_EDGES[-1])) for c, a in zip(LEAF, "xyz")})


def cells_met(viewers: DataFrame, items: DataFrame, keys: Sequence[str], box: Column, meets) -> DataFrame:
    """Each viewer with the leaf cells whose content it may meet.

    ``items`` come from ``with_leaf``; ``box`` is what one of them covers (a point has its corners
    in the same place). Each cell knows the box around its content, so an item may be larger than its cell
    and belongs to one all the same, and empty space costs nothing. Cells are nested: a viewer goes
    from a cell to the ones inside only where ``meets(viewers, low, high)`` allows it, a function that
    adds the columns it needs and keeps the viewers which may meet something between the corners ``low``
    and ``high``, column names by axis. It must never lose a real meeting. Only the
    widest cells, of which a scene has few, are joined on ``keys`` alone.
    """
    keys = list(keys)
    corners = {f"_{side}{a}": box[f"{a}{side}"] for side in ("min", "max") for a in "xyz"}
    around = [getattr(F, c[1:4])(c).alias(c) for c in corners]
    level = items.select(*keys, *LEAF, *[v.alias(c) for c, v in corners.items()])
    level = level.groupBy(*keys, *LEAF).agg(*around)
    cells = [level]
    for inner, outer in zip(CELL_EDGES[:0:-1], CELL_EDGES[-2::-1]):
        ratio = round(outer / inner)
        up = {f"_up{a}": F.floor(F.col(c) / F.lit(ratio)) for c, a in zip(LEAF, "xyz")}
        cells[0] = cells[0].withColumns(up)
        level = cells[0].groupBy(*keys, *up).agg(*around).select(
            *keys, *[F.col(u).alias(c) for u, c in zip(up, LEAF)], *corners)
        cells.insert(0, level)
    low, high = ({a: f"_{side}{a}" for a in "xyz"} for side in ("min", "max"))
    kept = viewers.columns
    met = meets(shuffled(viewers).join(cells[0], keys), low, high).select(*kept, *LEAF)
    for level in cells[1:]:
        above = met.select(*kept, *[F.col(c).alias(f"_up{a}") for c, a in zip(LEAF, "xyz")])
        met = meets(shuffled(above).join(level, [*keys, "_upx", "_upy", "_upz"]), low, high).select(*kept, *LEAF)
    return met


def ray_hits(rays: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every ray (``eye``, ``look``) with each object whose ``box`` it hits, by nested cells.

    Columns are those of both sides, the keys once. A ray or box with a null or NaN hits nothing.
    """
    whole = [F.col(f"box.{f}").isNotNull() & ~F.isnan(f"box.{f}") for f in BOX_FIELDS]
    placed = with_leaf(objects.filter(reduce(lambda a, b: a & b, whole)), box_center(F.col("box")))

    def meets(df: DataFrame, low: dict, high: dict) -> DataFrame:
        # the box around a cell's content holds each box in it, and a slab that is entered later or
        # left earlier only shrinks; rounding is monotone, so no hit is lost to it either
        around = make_box(*[F.col(side[a]) for side in (low, high) for a in "xyz"])
        return df.filter(ray_hits_box(F.col("eye"), F.col("look"), around))

    met = cells_met(rays, placed, keys, F.col("box"), meets)
    return (
        shuffled(placed).join(met, [*keys, *LEAF])
        .filter(ray_hits_box(F.col("eye"), F.col("look"), F.col("box")))
        .drop(*LEAF)
    )
