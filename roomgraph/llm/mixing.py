"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations.

The leaves of the tree are the (domain, language, source) groups. A total of tokens is handed down
level by level: siblings share their parent's budget by weight, a node never gets more than its
leaves hold in ``most_epochs`` passes, and what it can't take goes to its siblings by their
weights. As a parent never gets more than its children can hold together, a shortage is made up
among siblings first and reaches the ancestors' siblings only when a whole subtree is exhausted.
Budgets are whole tokens; below one token a node is lost in rounding down.

A leaf's stream is its documents in a seeded order, then in another, and so on, one order an
epoch; the leaf gives the prefix of that stream which its budget buys. Whole epochs are repeated
rows; of the last epoch the running sum of tokens decides, which is taken in buckets of the seeded
hash, so a leaf with a third of all rows is spread over all of them.

Defined cases: null domains, languages and sources are the group ``''``; a null text has no tokens;
documents without tokens are taken with the token at which they stand, and not at all from a leaf
without any token; equal hashes (repeated ids) are ordered by tokens and text; nodes without a
positive weight get nothing; an empty table gives no rows. Columns of the input are kept, its
``_mix`` names excepted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.llm.common import few_files, stored, text_of

#: Up to so many leaves their budgets are sent to every task; more are joined by a shuffle.
SMALL_TREE = 20_000
LEVELS = ("_mix_domain", "_mix_lang", "_mix_source")


def words_in(text: str) -> Column:
    """Tokens as the mixture counts them: runs without white space."""
    return F.regexp_count(text_of(text), F.lit(r"[^ \t-\r]+")).cast("long")


def weight_of(name: Column, weights: dict[str, int], default: int) -> Column:
    return reduce(lambda rest, kv: F.when(name == kv[0], F.lit(kv[1])).otherwise(rest),
                  weights.items(), F.lit(default)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's ``_mix_budget`` among its children by ``_mix_weight`` up to ``_mix_cap``.

    Children are looked at from the smallest capacity per weight on. A child is full if its share
    of what its predecessors leave exceeds its capacity; the first that isn't sets the level of all
    that follow.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("_mix_cap") / F.col("_mix_weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_mix_budget") - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0))
    nodes = nodes.filter("_mix_weight > 0").withColumn(
        "_mix_level", left / F.sum("_mix_weight").over(onward))
    full = F.col("_mix_cap") <= F.col("_mix_weight") * F.col("_mix_level")
    level = F.max(F.when(~full, F.col("_mix_level"))).over(Window.partitionBy(*parent))
    return nodes.withColumn("_mix_share", F.when(full, F.col("_mix_cap")).otherwise(
        F.floor(F.col("_mix_weight") * level).cast("long"))).drop("_mix_level")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]],
            most_epochs: int, default: int = 1) -> DataFrame:
    """Leaves (three level columns, ``_mix_tokens``) with ``_mix_budget`` in tokens.

    ``total`` is an expression over ``_mix_tokens`` of the whole table. A level's ``weights`` are
    whole numbers by name; names that it lacks weigh ``default``.
    """
    leaves = leaves.withColumn("_mix_cap", F.col("_mix_tokens") * most_epochs)
    budget = leaves.agg(total.cast("long").alias("_mix_budget"), F.sum("_mix_cap").alias("_c")
                        ).select(F.least("_mix_budget", "_c").alias("_mix_budget"))
    above, given = [], budget
    for name, level in zip(LEVELS, ("domain", "lang", "source"), strict=True):
        nodes = leaves.groupBy(*above, name).agg(F.sum("_mix_cap").alias("_mix_cap"))
        nodes = nodes.join(given, above) if above else nodes.crossJoin(F.broadcast(given))
        nodes = nodes.withColumn("_mix_weight", weight_of(F.col(name), weights.get(level, {}), default))
        above = [*above, name]
        given = share_out(nodes, above[:-1], name).select(
            *above, F.col("_mix_share").alias("_mix_budget"))
    return leaves.join(given, list(LEVELS), "left").withColumn(
        "_mix_budget", F.coalesce("_mix_budget", F.lit(0))).drop("_mix_cap")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], total: Column,
        seed: int = 0, most_epochs: int = 4, tokens: Column | None = None,
        bucket_rows: int = 1000) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang, source) once per epoch that takes them, with the
    columns ``domain``, ``epoch``, ``n_tokens`` and ``take_tokens`` (less in the last one)."""
    def named(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    rows = docs.withColumns({
        "_mix_domain": named(domain), "_mix_lang": named(F.col("lang")),
        "_mix_source": named(F.col("source")),
        "_mix_n": words_in("text") if tokens is None else tokens})
    leaves = stored(rows.groupBy(*LEVELS).agg(
        F.sum("_mix_n").alias("_mix_tokens"), F.count(F.lit(1)).alias("_mix_docs")))
    plan = stored(few_files(budgets(leaves, total, weights, most_epochs), leaves.count(), 50_000))
    sizes = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("_mix_docs"), F.lit(0))).head()
    plan = plan.filter((F.col("_mix_budget") > 0)).select(
        *LEVELS, F.floor(F.col("_mix_budget") / F.col("_mix_tokens")).cast("long").alias("_mix_whole"),
        (F.col("_mix_budget") % F.col("_mix_tokens")).alias("_mix_rest"))
    rows = rows.join(F.broadcast(plan) if sizes[0] <= SMALL_TREE else plan, list(LEVELS))

    whole = rows.filter("_mix_whole > 0").withColumn(
        "_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_whole") - 1))
    ).withColumn("_mix_take", F.col("_mix_n"))

    digits = 0
    while bucket_rows * 16**digits < sizes[1]:
        digits += 1
    seeded = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("_mix_whole").cast("string"),
                               F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    part = rows.filter("_mix_rest > 0").withColumn("_mix_order", seeded).withColumn(
        "_mix_bucket", F.substring("_mix_order", 1, digits))
    within = [*LEVELS, "_mix_bucket"]
    base = part.groupBy(*within).agg(F.sum("_mix_n").alias("_mix_sum"))
    running = Window.partitionBy(*LEVELS).orderBy("_mix_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    base = base.select(*within, F.coalesce(F.sum("_mix_sum").over(running), F.lit(0)).alias("_mix_base"))
    inner = Window.partitionBy(*within).orderBy("_mix_order", "_mix_n", F.xxhash64("text")
                                                ).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_mix_base") + F.coalesce(F.col("_mix_local"), F.lit(0))
    part = (
        part.withColumn("_mix_local", F.sum("_mix_n").over(inner)).join(base, within)
        .withColumn("_mix_start", start).filter("_mix_start < _mix_rest")
        .withColumn("_mix_epoch", F.col("_mix_whole"))
        .withColumn("_mix_take", F.least("_mix_n", F.col("_mix_rest") - F.col("_mix_start")))
    )
    kept = [c for c in docs.columns if c not in ("domain", "epoch", "n_tokens", "take_tokens")
            and not c.startswith("_mix")]
    both = [x.select(*kept, F.col("_mix_domain").alias("domain"),
                     F.col("_mix_epoch").cast("long").alias("epoch"),
                     F.col("_mix_n").alias("n_tokens"), F.col("_mix_take").alias("take_tokens"))
            for x in (whole, part)]
    return both[0].unionByName(both[1])
