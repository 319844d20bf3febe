"""Detections kept by suppression, sightings joined to instances, instance roll-ups."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roomgraph.fixed_values import CLASS_FAMILY, TIGHT_FAMILIES
from roomgraph.functions import geometry as g
from roomgraph.functions import words as w
from roomgraph.operators.scaling import (
    by_size,
    exact_quantiles,
    islands,
    positions,
    rows_and_fullest,
    shuffled,
    top_k,
)
from roomgraph.session import cut_lineage

# ---- suppression ------------------------------------------------------------------------------


def suppress_overlaps(detections: DataFrame, iou: float = 0.45, cell: int = 128) -> DataFrame:
    """Greedy non-maximum suppression per frame and class, best confidence first.

    Boxes in different pixel islands cannot overlap, so an island is the unit of work; the
    walk over it is a fold that carries only the kept boxes.
    """
    b = F.col("bbox")
    keys = ["scene_id", "frame", "class"]
    parts = islands(detections, keys, b.x1, b.x2, cell, "_ix")
    parts = islands(parts, [*keys, "_ix"], b.y1, b.y2, cell, "_iy")
    row = F.struct((-F.col("conf")).alias("c"), "ord", "bbox")
    groups = parts.groupBy(*keys, "_ix", "_iy").agg(F.sort_array(F.collect_list(row)).alias("all"))
    kept = F.aggregate(
        "all",
        F.filter("all", lambda r: F.lit(False)),
        lambda acc, r: F.when(
            F.exists(acc, lambda k: g.bbox_iou(k.bbox, r.bbox) > iou), acc
        ).otherwise(F.concat(acc, F.array(r))),
    )
    return groups.select(*keys, F.explode(kept).alias("k")).select(
        *keys, F.col("k.ord").alias("ord"), (-F.col("k.c")).alias("conf"),
        F.col("k.bbox").alias("bbox"),
    )


# ---- association ---------------------------------------------------------------------------------


def _walk(dist: float, family_dist: float) -> Callable[..., np.ndarray]:
    """Join the sightings of one island, row by row, to the closest instance: the place of its first sighting."""

    def walk(xyz: np.ndarray, classes: np.ndarray, families: np.ndarray, tight: np.ndarray) -> np.ndarray:
        members: list[list[int]] = []
        ordered: list[list[list[float]]] = []  # the members' places by axis, sorted
        plain = not np.isnan(xyz).any()
        centers = np.empty((16, 3))
        first_class, first_family = np.empty((2, 16), dtype=np.int64)
        out = np.empty(len(xyz), dtype=np.int64)
        for i in range(len(xyz)):
            pick, n = -1, len(members)
            if n:
                gap = np.sqrt(((centers[:n] - xyz[i]) ** 2).sum(axis=1))
                same = np.where(first_class[:n] == classes[i], gap, np.inf)
                j = int(same.argmin())
                best = same[j]
                if best < dist:
                    pick = j
                if tight[i]:
                    kin = np.where(first_family[:n] == families[i], gap, np.inf)
                    k = int(kin.argmin())
                    if kin[k] < family_dist and (pick < 0 or kin[k] <= best):
                        pick = k
            if pick < 0:
                pick = n
                members.append([])
                ordered.append([[], [], []])
                if pick == len(centers):
                    centers = np.vstack([centers, np.empty_like(centers)])
                    first_class = np.concatenate([first_class, np.empty_like(first_class)])
                    first_family = np.concatenate([first_family, np.empty_like(first_family)])
                first_class[pick], first_family[pick] = classes[i], families[i]
            mine = members[pick]
            mine.append(i)
            for values, v in zip(ordered[pick], xyz[i].tolist()):
                insort(values, v)
            low, high = (len(mine) - 1) // 2, len(mine) // 2
            if len(mine) < 3:
                centers[pick] = xyz[i]
            elif plain:
                centers[pick] = [(s[low] + s[high]) / 2 if low < high else s[low] for s in ordered[pick]]
            else:
                centers[pick] = np.median(xyz[mine], axis=0)
            out[i] = mine[0]
        return out

    return walk


def _walk_together(
    xyz: np.ndarray, classes: np.ndarray, tight: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
    dist: float, family_dist: float, head: np.ndarray,
) -> None:
    """``_walk`` of many short islands at once, a row of each at a time; same bits. Fills ``head``.

    Islands begin at ``starts`` of the rows and are sorted by their ``sizes``, the longest first;
    an island is of one class or, where ``tight``, of one family. Places must be finite.
    """
    n, longest = len(starts), int(sizes[0])
    centers = np.full((n, longest, 3), np.inf)
    first_class = np.full((n, longest), -1, dtype=np.int64)
    first_row, members = np.zeros((2, n, longest), dtype=np.int64)
    joined = np.full((n, longest), -1, dtype=np.int64)
    found = np.zeros(n, dtype=np.int64)
    for t in range(longest):
        n = int(np.searchsorted(-sizes, -t))  # islands that have a row left
        at, rows = np.arange(n), starts[:n] + t
        p, c = xyz[rows], classes[rows]
        pick = np.full(n, -1, dtype=np.int64)
        if t:
            most = int(found[:n].max())
            away = (centers[:n, :most] - p[:, None, :]) ** 2
            gap = np.sqrt(away[..., 0] + away[..., 1] + away[..., 2])
            same = np.where(first_class[:n, :most] == c[:, None], gap, np.inf)
            j = same.argmin(axis=1)
            best = same[at, j]
            pick = np.where(best < dist, j, -1)
            k = gap.argmin(axis=1)
            kin = gap[at, k]
            pick = np.where(tight[rows] & (kin < family_dist) & ((pick < 0) | (kin <= best)), k, pick)
        new = np.flatnonzero(pick < 0)
        pick[new] = found[new]
        found[new] += 1
        first_class[new, pick[new]], first_row[new, pick[new]] = c[new], t
        joined[:n, t] = pick
        members[at, pick] += 1
        centers[at, pick] = p
        full = np.flatnonzero(members[at, pick] >= 3)
        if len(full):
            mine = joined[full, : t + 1] == pick[full, None]
            places = xyz[starts[full, None] + np.arange(t + 1)].transpose(0, 2, 1)
            places = np.sort(np.where(mine[:, None, :], places, np.inf), axis=2)
            count = members[full, pick[full]]
            low, high = (count - 1) // 2, count // 2
            a, b = (np.take_along_axis(places, k[:, None, None], axis=2)[..., 0] for k in (low, high))
            centers[full, pick[full]] = np.where((low < high)[:, None], (a + b) / 2, a)
        head[rows] = starts[:n] + first_row[at, pick]


def _greedy(keys: list[str], orders: list[str], dist: float, family_dist: float):
    """Walk each island of sorted rows in order and join sightings to the closest instance."""
    walk = _walk(dist, family_dist)

    def starts(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), dtype=bool)
        new[:1] = True
        for c in keys:
            values = rows[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        xyz, tight = rows[["x", "y", "z"]].to_numpy(dtype=float), rows["tight"].to_numpy()
        classes, families = (pd.factorize(rows[c])[0] for c in ("class", "family"))
        head, at = np.arange(len(rows)), [*starts(rows), len(rows)]
        for low, high in zip(at, at[1:]):
            if high - low > 1:
                part = slice(low, high)
                head[part] = low + walk(xyz[part], classes[part], families[part], tight[part])
        return rows.assign(**{"first_" + c: rows[c].to_numpy()[head] for c in orders})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the island that may go on in the next batch
        for batch in batches:
            if batch.empty:
                continue
            at = starts(batch)
            if held and all(held[-1][c].iloc[-1] == batch[c].iloc[0] for c in keys):
                at = at[1:]
            if len(at):
                held.append(batch.iloc[: at[-1]])
                whole = pd.concat(held)
                if len(whole):
                    yield joined(whole)
                held = []
            held.append(batch.iloc[at[-1] if len(at) else 0:])
        if held:
            yield joined(pd.concat(held))

    return run


#: Sightings of a scene up to which it is walked in one place, and of the scenes packed together.
_SCENE, _TOGETHER = 100_000, 131_072
#: Rows that a task holds before it packs them, and an island's rows up to which it is walked with others.
_HELD, _SHORT = 400_000, 256


def _block(rows: pa.Table) -> bytes:
    """Rows in compressed columns; texts once each."""
    for i, field in enumerate(rows.schema):
        if pa.types.is_string(field.type):
            rows = rows.set_column(i, field.name, rows.column(i).dictionary_encode())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    return pa.compress(sink.getvalue(), codec="zstd", asbytes=True)


def _unblock(block: pa.Buffer) -> pa.Table:
    """The rows of a ``_block``."""
    rows = pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(block), "zstd")).read_all()
    return rows.cast(pa.schema([
        pa.field(f.name, f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in rows.schema]))


def _pack(parts: int):
    """Rows of a task in compressed column blocks, one for each group of scenes among ``_HELD`` rows."""

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        scene = rows["_scene"].to_numpy()
        part = scene % parts
        order = np.lexsort((scene, part))
        part = part[order]
        rows = rows.drop_columns(["_scene"]).take(order).combine_chunks()
        at = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        out = [_block(rows.slice(low, high - low)) for low, high in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[at[:-1]], pa.int64()), pa.array(out, pa.binary())], names=["_part", "_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _HELD:
                yield blocks(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield blocks(pa.Table.from_batches(held))

    return run


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers in the order of the values, equal for equal ones; for nulls one below all others."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    ranks = pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    return np.where(column.is_null().to_numpy(), -1, ranks.to_numpy().astype(np.int64))


def _strings(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """Distinct values and the place of each row's among them."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _numpy(column: pa.ChunkedArray) -> np.ndarray:
    """The values as Arrow takes them back; Python's own where numpy has no such value."""
    kind = column.type
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy()
    if not column.null_count and pa.types.is_string(kind):
        values, place = _strings(column)
        return np.array(values, dtype=object)[place]
    return np.fromiter(column.to_pylist(), dtype=object, count=len(column))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before; the first does."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _islands(group: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Groups cut where a cell along an axis is empty, as ``scaling.islands`` does."""
    order = np.lexsort((cell, group))
    new = _changes(group[order])
    new[1:] |= cell[order][1:] - cell[order][:-1] > 1
    out = np.empty(len(group), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _heads(
    match: list[np.ndarray], orders: list[np.ndarray], xyz: np.ndarray, classes: np.ndarray, families: np.ndarray,
    tight: np.ndarray, dist: float, family_dist: float,
) -> np.ndarray:
    """For each row the first row of its instance."""
    by = np.lexsort(match)
    group = np.empty(len(by), dtype=np.int64)
    group[by] = np.cumsum(_changes(*[m[by] for m in match])) - 1
    cells = np.nan_to_num(np.floor(xyz / max(dist, family_dist)), nan=0.0, posinf=np.inf, neginf=-np.inf)
    for axis in range(3):
        group = _islands(group, cells[:, axis])
    by = np.lexsort((*orders[::-1], group))
    xyz, classes, families, tight = xyz[by], classes[by], families[by], tight[by]
    starts = np.flatnonzero(_changes(group[by]))
    sizes = np.diff(starts, append=len(by))
    finite = np.logical_and.reduceat(np.isfinite(xyz).all(axis=1), starts)
    head = np.arange(len(by))
    walk = _walk(dist, family_dist)
    for i in np.flatnonzero((sizes > 1) & ~(finite & (sizes <= _SHORT))):
        part = slice(starts[i], starts[i] + sizes[i])
        head[part] = starts[i] + walk(xyz[part], classes[part], families[part], tight[part])
    short = np.flatnonzero((sizes > 1) & finite & (sizes <= _SHORT))
    short = short[np.argsort(-sizes[short], kind="stable")]
    while len(short):  # about as many rows in each turn
        now, short = np.split(short, [max(1, 65_536 // int(sizes[short[0]]))])
        _walk_together(xyz, classes, tight, starts[now], sizes[now], dist, family_dist, head)
    out = np.empty_like(by)
    out[by] = by[head]
    return out


def _numbers(scene: np.ndarray, orders: list[np.ndarray], head: np.ndarray, whole: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their instance's place among all and that in its scene, by the rows that lie where an instance begins.

    Rows come by instance, in order. Where several of them have equal orders, each has a place of its own, and the sightings of that
    beginning come back with each. Rows whose instance begins without all of its orders don't.
    """
    by = np.lexsort((*orders[::-1], scene))
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.cumsum(_changes(scene[by], *[o[by] for o in orders])) - 1
    first = place[head]
    count = np.bincount(first[place == first], minlength=len(by))
    before = np.cumsum(count) - count
    begins = _changes(scene[by])
    base = np.empty(len(by), dtype=np.int64)
    base[by] = before[place[by]][begins][np.cumsum(begins) - 1]
    times = np.where(whole[head], count[first], 0)
    rows = np.repeat(np.arange(len(by)), times)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    number = before[first][rows] + nth
    by = np.lexsort((place[rows], number))
    rows, number = rows[by], number[by]
    return rows, number, number - base[rows]


def _walk_packed(orders: list[str], dist: float, family_dist: float):
    """Unpack the scenes of a group, walk their islands and number their instances: columns as lists."""

    def run(blocks: pa.Array) -> dict:
        rows = pa.concat_tables([_unblock(b.as_buffer()) for b in blocks]).combine_chunks()
        names, classes = _strings(rows["class"])
        family = [CLASS_FAMILY.get(c, c) for c in names]
        known = {f: i for i, f in enumerate(dict.fromkeys(family))}
        families = np.array([known[f] for f in family], dtype=np.int64)
        tight = np.array([f in TIGHT_FAMILIES for f in family], dtype=bool)
        match = np.where(tight, families, len(known) + np.arange(len(names)))
        scene, placed = _ranks(rows["scene_id"]), [_ranks(rows[c]) for c in orders]
        missing = [rows[c].is_null().to_numpy() for c in orders]
        late = [key for m, p in zip(missing, placed) for key in ((m, p) if m.any() else (p,))]  # nulls last
        early = [key for m, p in zip(missing, placed) for key in ((~m, p) if m.any() else (p,))]
        xyz = np.column_stack([rows[c].cast(pa.float64()).to_numpy() for c in "xyz"])
        head = _heads([match[classes], scene], late, xyz, classes, families[classes], tight[classes], dist, family_dist)
        at, place, number = _numbers(scene, early, head, ~np.any(missing, axis=0))
        out = {c: _numpy(rows[c]) for c in rows.column_names}
        first = {"first_" + c: out[c][head[at]] for c in orders}
        return {c: v[at] for c, v in out.items()} | first | {"instance_no": number, "_place": place}

    return run


def _associated_at_once(
    sightings: DataFrame, orders: list[str], dist: float, family_dist: float, rows: int
) -> DataFrame:
    """Sightings of scenes of up to ``_SCENE`` of them, moved once, in packed columns.

    ``_part`` tells the group of scenes that lies in one place: what is grouped by it and other columns
    afterwards isn't moved again. ``_place`` numbers its instances, by which the rows are sorted.
    """
    cores = sightings.sparkSession.sparkContext.defaultParallelism
    together = min(_TOGETHER, max(4096, rows // (3 * cores)))
    parts = rows // together + 1
    block = T.StructType([T.StructField("_part", T.LongType(), False), T.StructField("_rows", T.BinaryType())])
    packed = sightings.withColumn("_scene", F.xxhash64("scene_id")).mapInArrow(_pack(parts), block)
    fields = [
        *sightings.schema.fields,
        *[T.StructField("first_" + c, sightings.schema[c].dataType) for c in orders],
        T.StructField("instance_no", T.LongType()), T.StructField("_place", T.LongType()),
    ]
    lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])
    walk = F.arrow_udf(_walk_packed(orders, dist, family_dist), lists)
    walked = packed.repartition(parts, "_part").groupBy("_part").agg(walk("_rows").alias("_w"))
    zipped = F.arrays_zip(*[F.col("_w")[f.name] for f in fields])
    return walked.select("_part", F.inline(zipped).alias(*[f.name for f in fields])).withColumn(
        "family", w.class_family(F.col("class")))


def _associated_spread(
    sightings: DataFrame, orders: list[str], dist: float, family_dist: float
) -> DataFrame:
    """``_associated_at_once`` of scenes that may hold most of the rows."""
    family = w.class_family(F.col("class"))
    tight = family.isin(*TIGHT_FAMILIES)
    reach = max(dist, family_dist)
    base = sightings.withColumns(
        {"family": family, "tight": tight, "match": F.when(tight, family).otherwise(F.col("class"))}
        | {f"_c{axis}": F.floor(F.col(axis) / F.lit(reach)) for axis in "xyz"}
    )
    place = ["scene_id", "match", "_cx", "_cy", "_cz"]
    keys = ["scene_id", "match"]
    # islands are a matter of occupied cells alone; stored, as each axis reads the one before twice
    cells = cut_lineage(base.select(*place).distinct())
    for axis in "xyz":
        cell = F.col(f"_c{axis}")
        cells = cut_lineage(islands(cells, keys, cell, cell, 1, f"_i{axis}"))
        keys = [*keys, f"_i{axis}"]
    placed = shuffled(base).join(cells, place).drop("_cx", "_cy", "_cz")
    firsts = ["first_" + c for c in orders]
    schema = T.StructType(
        [*placed.schema.fields,
         *[T.StructField(f, placed.schema[c].dataType) for c, f in zip(orders, firsts)]]
    )
    walked = (
        placed.repartition(*keys)
        .sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in orders])
        .mapInPandas(_greedy(keys, orders, dist, family_dist), schema)
        .drop("_ix", "_iy", "_iz", "tight", "match")
    )
    # stored, so that numbering does not walk again
    walked = cut_lineage(walked)
    numbered = positions(
        walked.filter(" AND ".join(f"{c} <=> {f}" for c, f in zip(orders, firsts))).select(
            "scene_id", *firsts
        ),
        ["scene_id"], firsts[0], width=1, name="instance_no", ties=firsts[1:],
    )
    return shuffled(walked).join(
        numbered.withColumn("instance_no", F.col("instance_no") - 1), ["scene_id", *firsts]
    )


def associate(
    sightings: DataFrame,
    orders: list[str],
    dist: float = 0.6,
    family_dist: float = 0.2,
) -> DataFrame:
    """Join sightings of a scene to instances, greedily in input order.

    ``sightings`` carry scene_id, class, x, y, z and the ``orders`` columns, which together
    give the input order (the first must be a whole number). Every row comes back with
    ``first_<order>`` of the first sighting of its instance and ``instance_no``, the place
    of that instance among all of its scene (from 0).

    Only equal classes, or equal families where labels are interchangeable, can meet, and
    never across a gap wider than the reach along any axis: the reference point of an
    instance is a per-axis median of its members. These parts are walked on their own.

    Scenes of up to ``_SCENE`` sightings are moved whole, in one exchange of packed columns; ``_part``
    tells which lie together and ``_place`` is the instance there. Of larger ones the parts are spread,
    and both are null.
    """
    rows, fullest = rows_and_fullest(sightings.filter("scene_id IS NOT NULL"), ["scene_id"])
    sightings = sightings.dropna(subset=["scene_id", "class", "x", "y", "z"])
    small, large = by_size(sightings, ["scene_id"], _SCENE) if fullest > _SCENE else (sightings, None)
    columns = ["scene_id", *["first_" + c for c in orders], *[c for c in sightings.columns if c != "scene_id"],
               "family", "instance_no"]
    out = _associated_at_once(small, orders, dist, family_dist, rows).select(*columns, "_part", "_place")
    if large is not None:
        spread = _associated_spread(large, orders, dist, family_dist).select(*columns)
        out = out.unionByName(spread.withColumns({c: F.lit(None).cast("long") for c in ("_part", "_place")}))
    return out


# ---- roll-ups ---------------------------------------------------------------------------------------


def class_votes(observations: DataFrame, keys: list[str], topk: int = 3) -> DataFrame:
    """Best-voted classes per instance: sum over frames of the best confidence per frame."""
    per_frame = observations.groupBy(*keys, "frame_no", "class").agg(F.max("conf").alias("c"))
    votes = per_frame.groupBy(*keys, "class").agg(
        F.sum("c").alias("votes"), F.max("c").alias("max_conf"), F.count(F.lit(1)).alias("n_frames"),
        F.min("frame_no").alias("_seen"),
    )
    # sums are compared to a micro-vote, so their last bits never decide
    order = [F.desc(F.round("votes", 6)), F.desc("max_conf"), F.asc("_seen"), F.asc("class")]
    return top_k(votes, keys, order, topk, "rank").select(
        *keys, "rank", "class", F.bround("votes", 3).alias("votes"),
        F.bround("max_conf", 3).alias("max_conf"), "n_frames",
    )


#: Sightings of an instance up to which it is rolled up in one place.
_WHOLE = 100_000


def _boxes_of_frames(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the mean box of their instance in the frame, and their place there by ``_order``."""
    in_order = Window.partitionBy(*keys, "frame_no").orderBy("_order")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns(
        {f: F.avg(f).over(whole) for f in g.BOX_FIELDS} | {"_nth": F.row_number().over(in_order)})


def _summary() -> list[Column]:
    """Summary, medians and box extents of an instance's rows from ``_boxes_of_frames``."""
    first = F.col("_nth") == 1  # a frame counts once
    half = {"cx": "x", "cy": "y", "cz": "z", "median_conf": "conf"}
    return [
        F.count(F.when(first, F.col("frame_no"))).alias("n_observations"),
        F.min("frame_no").alias("first_no"),
        F.max("frame_no").alias("last_no"),
        F.max_by(F.struct("frame_no", "class", "conf"), F.struct("conf", "_order")).alias("evidence"),
        *[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(name) for name, c in half.items()],
        *[F.percentile(F.when(first, F.col(f)).cast("double"), F.lit(0.25)).alias(f) for f in g.BOX_FIELDS],
    ]


def _rolled_at_once(observations: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Summary, medians and box extents of each instance from one exchange of its sightings."""
    moved = observations.select(
        *keys, "frame_no", "class", "conf", "x", "y", "z",
        *[F.col(f"box.{f}").alias(f) for f in g.BOX_FIELDS], order.alias("_order"),
    ).repartition(*keys)
    return _boxes_of_frames(moved, keys).groupBy(*keys).agg(*_summary())


def _rolled_spread(observations: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``_rolled_at_once`` of instances that may hold most of the rows."""
    middle = exact_quantiles(
        observations, keys,
        {"cx": ("x", 0.5), "cy": ("y", 0.5), "cz": ("z", 0.5), "median_conf": ("conf", 0.5)},
    )
    frames = observations.groupBy(*keys, "frame_no").agg(
        *[F.avg(f"box.{f}").alias(f) for f in g.BOX_FIELDS]
    )
    boxes = exact_quantiles(frames, keys, {f: (f, 0.25) for f in g.BOX_FIELDS})
    summary = observations.groupBy(*keys).agg(
        F.countDistinct("frame_no").alias("n_observations"),
        F.min("frame_no").alias("first_no"),
        F.max("frame_no").alias("last_no"),
        F.max_by(F.struct("frame_no", "class", "conf"), F.struct("conf", order)).alias("evidence"),
    )
    return summary.join(middle, keys).join(boxes, keys)


def roll_up(
    observations: DataFrame, keys: list[str], order: Column, min_frames: int = 2
) -> DataFrame:
    """One row per instance seen in at least ``min_frames`` frames.

    ``observations`` carry frame_no, class, conf, x, y, z and a ``box``; ``order`` breaks
    ties between equally confident evidence. Rows without one of the keys are left out. Sightings are
    moved once, save those of instances with more than ``_WHOLE`` of them.
    """
    small, large = by_size(observations.dropna(subset=keys), keys, _WHOLE)
    rolled = _rolled_at_once(small, keys, order)
    if large is not None:
        rolled = rolled.unionByName(_rolled_spread(large, keys, order))
    return _rolled_shape(rolled, min_frames)


def _rolled_shape(rolled: DataFrame, min_frames: int) -> DataFrame:
    """Instances of enough frames, their medians folded into a point and a box."""
    return (
        rolled.filter(F.col("n_observations") >= min_frames)
        .withColumn("center", g.make_point(F.col("cx"), F.col("cy"), F.col("cz")))
        .withColumn("box", g.make_box(*[F.col(f) for f in g.BOX_FIELDS]))
        .drop("cx", "cy", "cz", *g.BOX_FIELDS)
    )


def _summed_up(associated: DataFrame, keys: list[str], order: Column, min_frames: int, topk: int) -> DataFrame:
    """``roll_up``, ``class_votes`` and family of each instance by windows over rows that lie together."""
    of_class = Window.partitionBy(*keys, "class")
    in_frame = Window.partitionBy(*keys, "class", "frame_no").orderBy(F.desc("conf"))
    best = F.when(F.col("_nth_in_frame") == 1, F.col("conf"))
    marked = (
        _boxes_of_frames(associated.withColumn("_nth_in_frame", F.row_number().over(in_frame)).withColumns({
            "_votes": F.sum(best).over(of_class),
            "_max_conf": F.max("conf").over(of_class),
            "_frames": F.count(F.when(F.col("_nth_in_frame") == 1, 1)).over(of_class),
            "_seen": F.min("frame_no").over(of_class),
            "_nth_of_class": F.row_number().over(of_class.orderBy("frame_no", F.desc("conf"))),
        }).withColumns({f: F.col(f"box.{f}") for f in g.BOX_FIELDS} | {"_order": order}), keys)
    )

    def falling(value: Column) -> list[Column]:  # NaN first, null last, as in a descending order
        return [value.isNull(), ~F.isnan(value), -value]

    vote = F.struct(
        *[c.alias(f"o{i}") for i, c in enumerate([*falling(F.round("_votes", 6)), *falling(F.col("_max_conf"))])],
        "_seen", "class", F.bround("_votes", 3).alias("votes"), F.bround("_max_conf", 3).alias("max_conf"),
        F.col("_frames").alias("n_frames"),
    )
    ranked = F.slice(F.sort_array(F.collect_list(F.when(F.col("_nth_of_class") == 1, vote))), 1, topk)
    entry = lambda v, i: F.struct(
        (i + 1).cast("int").alias("rank"), v["class"].alias("class"), v.votes.alias("votes"),
        v.max_conf.alias("max_conf"), v.n_frames.alias("n_frames"))
    # most instances may be seen too seldom: they needn't be summed up
    seen = F.count(F.when(F.col("_nth") == 1, F.col("frame_no"))).over(Window.partitionBy(*keys))
    summed = marked.withColumn("_n_frames", seen).filter(F.col("_n_frames") >= min_frames).groupBy(*keys).agg(
        *_summary(), ranked.alias("class_candidates"), F.min_by("family", "_order").alias("family"))
    return _rolled_shape(summed, min_frames).withColumn("class_candidates", F.transform("class_candidates", entry))


def instances(associated: DataFrame, order: Column, min_frames: int = 2, topk: int = 3) -> DataFrame:
    """Labelled instances of associated sightings, named ``<label>_<instance_no>``.

    Sightings that ``associate`` has left together are summed up where they lie.
    """
    keys = ["scene_id", "instance_no"]
    together, spread = None, associated
    if "_part" in associated.columns:
        here = ["_place", "_part"]  # the first of them tells rows apart soonest when they are sorted
        together = _summed_up(
            associated.filter("_part IS NOT NULL"), [*here, *keys], order, min_frames, topk).drop(*here)
        spread = associated.filter("_part IS NULL").drop(*here) if associated.schema["_part"].nullable else None
    if spread is not None:
        spread = _instances_spread(spread, keys, order, min_frames, topk)
    both = [d for d in (together, spread) if d is not None]
    out = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    label = F.col("class_candidates")[0]["class"]
    return out.withColumn("class", label).withColumn(
        "instance_id", F.concat(label, F.lit("_"), F.col("instance_no").cast("string")))


def _instances_spread(associated: DataFrame, keys: list[str], order: Column, min_frames: int, topk: int) -> DataFrame:
    """``_summed_up`` of instances that may hold most of the rows."""
    # several roll-ups read the walked rows: store them instead of walking again
    associated = cut_lineage(associated)
    ranked = class_votes(associated, keys, topk)
    entry = F.struct("rank", "class", "votes", "max_conf", "n_frames")
    votes = ranked.groupBy(*keys).agg(
        F.sort_array(F.collect_list(entry)).alias("class_candidates")
    )
    family = associated.groupBy(*keys).agg(F.min_by("family", order).alias("family"))
    return roll_up(associated, keys, order, min_frames).join(votes, keys).join(family, keys)
