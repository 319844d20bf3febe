"""Counts, latency summaries, cost projection and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.fixed_values import CUP_WORDS, E2E_BUCKETS, LAPTOP_WORDS, NAMING_EN, POT_WORDS
from roomgraph.functions.words import clean, lookup


def shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key combination and their share of all rows."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def reason_counts(frames: DataFrame) -> DataFrame:
    """How often each reason occurs in the ``reasons`` lists."""
    return frames.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def latency_summary(rows: DataFrame, keys: list[str], column: str = "latency_ms") -> DataFrame:
    """Count, mean, median (interpolated), nearest-rank p95 and p99, and maximum.

    Equal whole-millisecond values are merged before anything is ordered, so a key costs as
    many rows as it has distinct latencies, whatever its traffic.
    """
    merged = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = merged.withColumns({"_hi": F.sum("c").over(upto), "_n": F.sum("c").over(whole)})

    def at(rank: Column) -> Column:
        inside = (rank < F.col("_hi")) & (rank >= F.col("_hi") - F.col("c"))
        return F.max(F.when(inside, F.col(column)))

    def nearest(q: float) -> Column:
        return at(F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q))))

    half = (F.col("_n") - 1) / 2
    return ranked.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        (F.sum(F.col(column) * F.col("c")) / F.sum("c")).alias("mean_ms"),
        ((at(F.floor(half)) + at(F.ceil(half))) / 2.0).alias("p50_ms"),
        nearest(0.95).alias("p95_ms"),
        nearest(0.99).alias("p99_ms"),
        F.max(column).alias("max_ms"),
    )


def run_report(calls: DataFrame, keys: list[str]) -> DataFrame:
    """One line per run: calls, pass rate, latency summary with its minimum, token totals.

    ``calls`` carry ``passed``, latency_ms, prompt_tokens and completion_tokens.
    """
    totals = calls.groupBy(*keys).agg(
        F.avg(F.coalesce("passed", F.lit(False)).cast("double")).alias("pass_rate"),
        F.min("latency_ms").alias("min_ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )
    return totals.join(latency_summary(calls, keys), keys)


def histogram_percentile(histogram: DataFrame, keys: list[str], p: float) -> DataFrame:
    """Per key the smallest bound that at least the share ``p`` of its cumulative counts lies under."""
    cells = F.collect_list(F.struct("le", "n"))  # as many as there are bounds
    reached = F.filter("_cells", lambda c: c["n"] >= F.col("_all") * p)
    return histogram.groupBy(*keys).agg(cells.alias("_cells"), F.max("n").alias("_all")).select(
        *keys, F.array_min(F.transform(reached, lambda c: c["le"])).alias("le"), F.col("_all").alias("n"))


def latency_histogram(
    rows: DataFrame, keys: list[str], seconds: Column, bounds: tuple[float, ...] = E2E_BUCKETS
) -> DataFrame:
    """Cumulative counts per upper bound, the open bound last (``le`` = infinity)."""
    sums = rows.withColumn("_s", seconds).groupBy(*keys).agg(
        *[F.count_if(F.col("_s") <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("_s").alias("_all"),
        F.sum("_s").alias("_sum"),
    )
    cells = [
        F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)
    ] + [F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n"))]
    return sums.select(
        *keys, F.inline(F.array(*cells)), (F.col("_sum") / F.col("_all")).alias("mean_s")
    )


def token_usage(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def cost_projection(
    rows: DataFrame, scenarios: DataFrame, price_in: float, price_out: float,
    hours: float = 4.0, calls_per_hour: float = 360.0,
) -> DataFrame:
    """Monthly calls and cost per model and fleet size, with and without the gate.

    The price of a call is its mean token use at prices per thousand; without a gate a
    device sends two frames a second.
    """
    unit = (
        F.avg("prompt_tokens") / 1000 * price_in + F.avg("completion_tokens") / 1000 * price_out
    )
    prices = rows.groupBy("model").agg(unit.alias("unit_cost"))
    gated = F.col("devices") * F.lit(hours) * F.lit(calls_per_hour) * 30
    ungated = F.col("devices") * F.lit(hours) * 3600 * 2 * 30
    return prices.join(F.broadcast(scenarios)).select(
        "model", "devices", "unit_cost", gated.alias("calls"),
        (gated * F.col("unit_cost")).alias("cost"),
        (ungated * F.col("unit_cost")).alias("ungated_cost"),
        F.lit(3600 * 2 / calls_per_hour).alias("ratio"),
    )


def rates(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Share of rows with each flag, per key."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.coalesce(f, F.lit(False)).cast("double")).alias(name) for name, f in flags.items()],
    )


# ---- evaluation ----------------------------------------------------------------------------------


def judge_located(truth: DataFrame, top1: DataFrame) -> DataFrame:
    """Pass where the first hit is expected, or where nothing is expected and nothing is found.

    ``truth`` carries query_id and ``expect`` (list of ids), ``top1`` query_id and node_id.
    """
    got = truth.join(top1.select("query_id", F.col("node_id").alias("top1")), "query_id", "left")
    none = F.size("expect") == 0
    return got.withColumn(
        "pass",
        F.when(none, F.col("top1").isNull()).otherwise(
            F.coalesce(F.array_contains("expect", F.col("top1")), F.lit(False))
        ),
    )


def found_rate(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Truth rows with whether a found row with the same key exists."""
    return truth.join(
        found.select(*key, F.lit(True).alias("_f")).distinct(), key, "left"
    ).withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def spurious(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct rows found that are not in the truth."""
    return found.distinct().subtract(truth.distinct())


def naming_pass(said: Column, agreed: Column, expect: Column) -> Column:
    """Does the agreed name meet the expectation (a thing, or explicitly not one)?"""
    english = F.coalesce(lookup(NAMING_EN, clean(said)), F.lower(F.coalesce(said, F.lit(""))))
    return (
        F.when(expect.isin("laptop", "cup", "mouse", "bed", "chair", "fan"), agreed & (english == expect))
        .when(expect == "not_cup", ~agreed | (english != "cup"))
        .when(expect == "no_mouse", ~agreed | (english != "mouse"))
        .otherwise(False)
    )


def mentions(names: Column, words: tuple[str, ...]) -> Column:
    """Any name that has any of the words inside."""
    return F.exists(names, lambda n: F.coalesce(
        F.lower(n).rlike("|".join(words)), F.lit(False)))


def answer_checks(desk: Column, ground: Column, has_mouse: Column) -> dict[str, Column]:
    return {
        "laptop": mentions(desk, LAPTOP_WORDS),
        "cup": mentions(desk, CUP_WORDS),
        "pot": mentions(ground, POT_WORDS),
        "mouse_imagined": F.coalesce(has_mouse, F.lit(False)),
    }


def majority(votes: DataFrame, keys: list[str], flags: list[str], need: int = 2) -> DataFrame:
    """A flag holds for a group when at least ``need`` of its frames agree."""
    return votes.groupBy(*keys).agg(
        *[(F.count_if(F.col(f)) >= need).alias(f) for f in flags]
    )
