"""Building blocks that keep any single key from landing whole in one task.

Every window here runs over ``(key, bucket)``, where the bucket bounds the rows, and over
small per-bucket summaries. A key that holds a third of the table is therefore spread over
its buckets. All of them return exactly what the plain window over the key would.
"""

from __future__ import annotations

import gc
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from roomgraph.session import cut_lineage

BUCKET = "_bucket"
CONTEXT = "_context"


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: dict[str, str],
    width: float,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add ``payload[c]`` = column ``c`` of the preceding row of the key.

    ``width`` is the bucket size in units of ``order``. The first row of a bucket takes the
    last row of the nearest earlier non-empty bucket.
    """
    keys, sort = list(keys), [order, *ties]
    held = F.struct(*payload)
    bucketed = df.withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)))
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*sort)
    edges = (
        bucketed.groupBy(*keys, BUCKET)
        .agg(F.max_by(held, F.struct(*sort)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(BUCKET)))
        .select(*keys, BUCKET, "_carry")
    )
    joined = bucketed.withColumn("_prev", F.lag(held).over(inner)).join(edges, [*keys, BUCKET])
    prev = F.coalesce("_prev", "_carry")
    return joined.withColumns({name: prev[c] for c, name in payload.items()}).drop(
        BUCKET, "_prev", "_carry"
    )


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: dict[str, str],
    width: float,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add ``payload[c]`` = latest non-null ``c`` among the earlier rows of the key."""
    keys, sort = list(keys), [order, *ties]
    bucketed = df.withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)))
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*sort).rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*sort)
    carried = (
        bucketed.groupBy(*keys, BUCKET)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_c_{c}") for c in payload])
        .select(
            *keys, BUCKET,
            *[F.last(f"_c_{c}", ignorenulls=True).over(earlier).alias(f"_k_{c}") for c in payload],
        )
    )
    return (
        bucketed.withColumns(
            {f"_l_{c}": F.last(c, ignorenulls=True).over(inner) for c in payload}
        )
        .join(carried, [*keys, BUCKET])
        .withColumns({name: F.coalesce(f"_l_{c}", f"_k_{c}") for c, name in payload.items()})
        .drop(BUCKET, *[f"_l_{c}" for c in payload], *[f"_k_{c}" for c in payload])
    )


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    gap: float,
    width: float,
    ties: Sequence[str] = (),
    name: str = "session",
) -> DataFrame:
    """Number the stretches of a key that are separated by at least ``gap`` (from 1)."""
    before = "_before"
    marked = with_previous(df, keys, order, {order: before}, width, ties)
    starts = (F.col(before).isNull() | (F.col(order) - F.col(before) >= F.lit(gap))).cast("long")
    return running_total(
        marked.withColumn("_starts", starts), keys, order, "_starts", width, name, ties
    ).drop(before, "_starts")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    width: float,
    name: str,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running sum of ``value`` in the key, the row itself included."""
    keys = list(keys)
    marked = df.withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)))
    running = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        marked.groupBy(*keys, BUCKET)
        .agg(F.sum(value).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .select(*keys, BUCKET, "_base")
    )
    inner = Window.partitionBy(*keys, BUCKET).orderBy(order, *ties).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        marked.withColumn("_local", F.sum(value).over(inner))
        .join(base, [*keys, BUCKET])
        .withColumn(name, F.col("_base") + F.col("_local"))
        .drop(BUCKET, "_local", "_base")
    )


def with_halo(df: DataFrame, order: str, width: float, halo: float) -> DataFrame:
    """Copy the last ``halo`` of each bucket into the next one as context rows.

    A window that looks back at most ``halo`` (at most ``width``) may then run over
    ``(key, bucket)``; drop rows where the context flag is set afterwards.
    """
    if halo > width:
        raise ValueError("halo must not exceed the bucket width")
    own = F.floor(F.col(order) / F.lit(width))
    places = F.array(F.struct(own.alias("b"), F.lit(False).alias("c")))
    late = F.col(order) >= (own + 1) * F.lit(width) - F.lit(halo)
    both = F.concat(places, F.array(F.struct((own + 1).alias("b"), F.lit(True).alias("c"))))
    return (
        df.withColumn("_place", F.explode(F.when(late, both).otherwise(places)))
        .withColumn(BUCKET, F.col("_place.b"))
        .withColumn(CONTEXT, F.col("_place.c"))
        .drop("_place")
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    width: int = 1_000_000,
    name: str = "pos",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Place (from 1) of each row in the key by ``order``, a whole number, then ``ties``.

    With a unique ``order`` a bucket of ``width`` numbers holds at most ``width`` rows,
    whatever the key.
    """
    keys = list(keys)
    bucketed = df.withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)))
    running = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        bucketed.groupBy(*keys, BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .select(*keys, BUCKET, "_base")
    )
    inner = Window.partitionBy(*keys, BUCKET).orderBy(order, *ties)
    return (
        bucketed.withColumn("_local", F.row_number().over(inner))
        .join(base, [*keys, BUCKET])
        .withColumn(name, F.col("_base") + F.col("_local"))
        .drop(BUCKET, "_local", "_base")
    )


def every_step(df: DataFrame, keys: Sequence[str], order: str, step: int, width: int = 1_000_000
               ) -> DataFrame:
    """The first row of each key by ``order`` and every ``step``-th after it."""
    return positions(df, keys, order, width, "_pos").filter(
        (F.col("_pos") - 1) % step == 0).drop("_pos")


def prefix_best(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    width: float,
    name: str,
) -> DataFrame:
    """Smallest ``value`` at or below each distinct ``order`` of the key, one row per step.

    Only the steps where a new minimum appears are kept, so the result is a short
    staircase instead of one row per input row.
    """
    keys = list(keys)
    distinct = (
        df.groupBy(*keys, order)
        .agg(F.min(value).alias("_v"))
        .withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)))
    )
    running = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    floor_of_bucket = (
        distinct.groupBy(*keys, BUCKET)
        .agg(F.min("_v").alias("_m"))
        .withColumn("_carry", F.min("_m").over(running))
        .select(*keys, BUCKET, "_carry")
    )
    inner = Window.partitionBy(*keys, BUCKET).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        distinct.withColumn("_seen", F.min("_v").over(inner))
        .join(floor_of_bucket, [*keys, BUCKET])
        .filter(F.coalesce(F.col("_v") < F.least("_seen", "_carry"), F.lit(True)))
        .select(*keys, order, F.col("_v").alias(name))
    )


def _tops(df: DataFrame, keys: list[str], value: Column, label: Column, k: int, name: str) -> DataFrame:
    """The ``k`` labels of a key with the smallest values, as an array of (v, l), smallest first."""
    once = df.groupBy(*keys, label.alias("_l")).agg(F.min(value).alias("_v"))
    return top_k(once, keys, [F.asc("_v"), F.asc("_l")], k, "_rn").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_l").alias("l")))).alias(name))


def _tops_below(df: DataFrame, keys: list[str], order: str, k: int, reach: float, name: str) -> DataFrame:
    """For each row that is no context row, the merged ``tops`` of its key's rows that lie more than
    ``reach`` below it in ``order``. Rows pass once, in order; what waits is what lies within reach."""
    columns = [*keys, order, "tops", CONTEXT]
    schema = StructType([df.schema[c] for c in (*keys, order)]).add(name, df.schema["tops"].dataType)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best, waiting = None, {}, deque()
        for batch in batches:
            out = []
            for *here, at, tops, context in zip(*[batch[c].tolist() for c in columns]):
                if here != key:
                    key, best, waiting = here, {}, deque()
                while waiting and at - waiting[0][0] > reach:
                    for top in waiting.popleft()[1]:
                        if top["l"] not in best or top["v"] < best[top["l"]]:
                            best[top["l"]] = top["v"]
                    if len(best) > k:
                        best = dict(sorted(best.items(), key=lambda e: (e[1], e[0] or ""))[:k])
                waiting.append((at, tops))
                if not context:
                    first = sorted(best.items(), key=lambda e: (e[1], e[0] or ""))
                    out.append((*here, at, [{"v": v, "l": label} for label, v in first]))
            yield pd.DataFrame(out, columns=schema.names)

    moved = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, order)
    return moved.mapInPandas(sweep, schema)


def prefix_top(
    df: DataFrame, keys: Sequence[str], order: str, value: str, label: str, k: int, reach: float,
    width: float, name: str,
) -> DataFrame:
    """For each distinct ``order`` of a key, of the rows more than ``reach`` below it the ``k`` labels with
    the smallest ``value``: an array ``name`` of (v, l), smallest first.

    Equal places are merged first. Each bucket of ``width`` is swept by itself, behind the last ``reach``
    of the bucket before and what the buckets below that hold, which a sweep over buckets of ``k`` labels
    tells. Rows without a place are left out; values must be there and differ between labels.
    """
    keys = list(keys)
    placed = df.filter(F.col(order).isNotNull() & ~F.isnan(order))
    levels = _tops(placed, [*keys, order], F.col(value), F.col(label), k, "tops")
    near = with_halo(levels, order, width, width)  # the whole bucket before
    bucketed = levels.withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)).cast("double"))
    totals = _tops(bucketed.withColumn("_t", F.explode("tops")), [*keys, BUCKET], F.col("_t.v"), F.col("_t.l"), k, "tops")
    lower = _tops_below(totals.withColumn(CONTEXT, F.lit(False)), keys, BUCKET, k, 1.0, "tops")
    carried = lower.filter(F.size("tops") > 0).select(
        *keys, F.lit(float("-inf")).alias(order), "tops", F.col(BUCKET).cast("long").alias(BUCKET),
        F.lit(True).alias(CONTEXT))
    return _tops_below(near.unionByName(carried), [*keys, BUCKET], order, k, reach, name).drop(BUCKET)


def islands(
    df: DataFrame, keys: Sequence[str], low: Column, high: Column, cell: float, name: str
) -> DataFrame:
    """Label rows by stretches of touching occupied cells along one axis.

    Rows of different islands lie more than one empty cell apart, so nothing that reaches
    at most ``cell`` can tie them together. Work is done on distinct occupied cells, whose
    number depends on the extent of the room and not on the row count.
    """
    keys = list(keys)
    first, last = F.floor(low / F.lit(cell)), F.floor(high / F.lit(cell))
    occupied = (
        df.select(*keys, F.explode(F.sequence(first, last)).alias("_cell")).distinct()
    )
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    labelled = occupied.withColumn(
        name,
        F.sum((F.col("_cell") - F.lag("_cell", 1).over(by_cell) > 1).cast("int")).over(by_cell),
    ).withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return df.withColumn("_cell", first).join(labelled, [*keys, "_cell"]).drop("_cell")


def stretches(
    df: DataFrame, keys: Sequence[str], low: str, high: str, width: float, name: str
) -> DataFrame:
    """Label rows by the stretch of overlapping intervals they belong to: the stretch's smallest ``low``.

    Intervals that only touch are apart; each must have ``low`` < ``high``. Work is done on the
    longest interval for each distinct ``low``, in buckets of ``width`` with what the earlier
    buckets reach.
    """
    keys = list(keys)
    longest = df.groupBy(*keys, low).agg(F.max(high).alias("_h")).withColumn(
        BUCKET, F.floor(F.col(low) / F.lit(width)))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*keys, BUCKET).orderBy(low)
    reach = longest.groupBy(*keys, BUCKET).agg(F.max("_h").alias("_m")).withColumn(
        "_carry", F.max("_m").over(before)).select(*keys, BUCKET, "_carry")
    reached = F.greatest(F.max("_h").over(inner.rowsBetween(Window.unboundedPreceding, -1)), "_carry")
    opened = longest.join(reach, [*keys, BUCKET]).withColumn(
        "_o", F.when(F.coalesce(F.col(low) >= reached, F.lit(True)), F.col(low)))
    last_open = opened.groupBy(*keys, BUCKET).agg(F.max("_o").alias("_m")).withColumn(
        "_from", F.max("_m").over(before)).select(*keys, BUCKET, "_from")
    labelled = opened.join(last_open, [*keys, BUCKET]).select(
        *keys, low, F.coalesce(F.max("_o").over(inner), "_from").alias(name))
    return df.join(labelled, [*keys, low])


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that goes by shuffles, whatever Spark guesses of its size.

    The guess is that of the files: packed columns, and rows that an ``explode`` adds, make it many
    times too small, and the side would pass whole through the driver.
    """
    return df.hint("merge")


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn"
) -> DataFrame:
    """First ``k`` rows of each key. Spark prunes to k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


#: Hash buckets in which rows are counted before the keys of full buckets are.
_KEY_BUCKETS = 65_536


def rows_and_fullest(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Number of rows, and of those in the fullest hash bucket of the keys: no key has more."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_KEY_BUCKETS)).alias("_kb")
    counted = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).head()
    # what was moved only to be counted can go now, not at the end of the job
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return counted[0] or 0, counted[1] or 0


def large_keys(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """The keys with more than ``most`` rows, null keys too, or None without any.

    Rows are counted by hash buckets, so nearly nothing is moved, and by keys only in buckets that
    hold more than ``most``. There is at most one such key for ``most`` rows: few enough to broadcast.
    """
    marked = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(_KEY_BUCKETS)).alias("_kb"))

    def over(marked: DataFrame, by: list[str]) -> DataFrame:
        counted = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        return counted.filter(F.col("_n") > most).select(*by)

    full = cut_lineage(over(marked, ["_kb"]))
    if full.isEmpty():
        return None
    large = cut_lineage(over(marked.join(F.broadcast(full), "_kb", "left_semi"), list(keys)))
    return None if large.isEmpty() else large


def by_size(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys of up to ``most`` rows, and those of larger ones (None without any)."""
    large = large_keys(df, keys, most)
    if large is None:
        return df, None
    large = F.broadcast(large.toDF(*[f"_large_{k}" for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys]
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    bins: int = 256,
    most: int = 100_000,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: ``wanted[name] = (column, p)``.

    Keys of up to ``most`` rows are one aggregation, whose state is a key's values. Larger ones are
    spread: see ``ranked_quantiles``. Both interpolate as Spark's percentile does and give the same
    bits. Nulls don't count; a key without a value has null.
    """
    keys = list(keys)
    df = df.select(*keys, *dict.fromkeys(c for c, _ in wanted.values()))
    small, large = by_size(df, keys, most)
    out = small.groupBy(*keys).agg(
        *[F.percentile(F.col(c).cast("double"), F.lit(float(p))).alias(name) for name, (c, p) in wanted.items()])
    return out if large is None else out.unionByName(ranked_quantiles(large, keys, wanted, bins))


def ranked_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], bins: int = 256
) -> DataFrame:
    """``exact_quantiles`` of keys that may hold most of the rows.

    Equal values of a key and column are merged with their counts, values go into ``bins`` bins
    between splitters drawn from a mergeable sketch of the values, so that a bin holds about the same
    number of them however they are spread; cumulative counts of the bins tell which ones hold the
    wanted ranks, and only those are ordered.
    """
    named, keys = list(keys), ["_key"]  # a struct, so that null keys join as well
    df = df.withColumn("_key", F.struct(*named))
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    place = {c: i for i, c in enumerate(columns)}
    per = [*keys, "_col"]
    merged = (
        df.select(*keys, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns]))
                  .alias("_col", "_v"))
        .groupBy(*per, "_v").agg(F.count("_v").alias("_c"))
    )
    valid = merged.filter(F.col("_v").isNotNull())
    sizes = valid.groupBy(*per).agg(F.sum("_c").alias("_n"), F.percentile_approx(
        "_v", [i / bins for i in range(1, bins)] or [0.5], 20 * bins).alias("_splits"))
    spot = F.size(F.filter("_splits", lambda x: x < F.col("_v")))
    valid = valid.join(sizes, per).withColumn("_bin", spot).drop("_splits")
    before = Window.partitionBy(*per).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        valid.groupBy(*per, "_bin").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
    )
    asked = F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(place[c]).alias("col"), F.lit(float(p)).alias("p"))
        for name, (c, p) in wanted.items()
    ])
    at = (F.col("_n") - 1) * F.col("_w.p")
    ends = F.array(F.struct(F.floor(at).alias("r"), F.lit(True).alias("low")),
                   F.struct(F.ceil(at).alias("r"), F.lit(False).alias("low")))
    spots = (
        counts.withColumn("_w", F.explode(F.filter(asked, lambda x: x.col == F.col("_col"))))
        .withColumn("_end", F.explode(ends))
        .filter((F.col("_end.r") >= F.col("_base"))
                & (F.col("_end.r") < F.col("_base") + F.col("_bc")))
        .select(*per, "_bin", "_base", F.col("_w.q").alias("_q"), at.alias("_at"),
                F.col("_end.r").alias("_rank"), F.col("_end.low").alias("_low"))
    )
    inside = Window.partitionBy(*per, "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ordered = valid.join(spots.select(*per, "_bin").distinct(), [*per, "_bin"], "left_semi"
                         ).withColumn("_upto", F.sum("_c").over(inside))
    picked = (
        ordered.join(spots, [*per, "_bin"])
        .filter((F.col("_rank") < F.col("_base") + F.col("_upto"))
                & (F.col("_rank") >= F.col("_base") + F.col("_upto") - F.col("_c")))
        .groupBy(*keys, "_q", "_at")
        .agg(F.max(F.when(F.col("_low"), F.col("_v"))).alias("_a"),
             F.max(F.when(~F.col("_low"), F.col("_v"))).alias("_b"))
    )
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        (F.ceil("_at") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.floor("_at")) * F.col("_b"))
    rows = picked.select(*keys, "_q", value.alias("_value")).unionByName(
        merged.select(*keys, F.lit(None).cast("string").alias("_q"),
                      F.lit(None).cast("double").alias("_value")).distinct())
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == name, F.col("_value"))).alias(name) for name in wanted]
    ).select(*[F.col(f"_key.{k}").alias(k) for k in named], *wanted)
