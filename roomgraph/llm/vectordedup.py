"""Near-duplicate vectors within a label: NN-descent, with saturated lists enlarged and recall audited.

Equal vectors of a label are one node with a count. Every node keeps its ``degree`` best neighbours so
far; they begin with the best in random-hyperplane buckets and random blocks of its label, and get
better in rounds in which neighbours of neighbours meet (a Spark join a round), until few of them are
new. Edges at or above the threshold stay, each decided in double precision where the compact codes of
the descent leave it open.

A list whose worst neighbour still reaches the threshold is saturated: it may be too short. It is then
enlarged to all saturated nodes of its component, held as runs and not entry by entry: these nodes are
sorted by their angle to a pivot, the densest of them, and cut into blocks. Two nodes whose angles to the
pivot add up to no more than the threshold's are linked for sure and only counted, block by block; two
whose angles differ by more are not; the members of what lies between are compared, block against block.
So a tight group costs one sort however large, and no pair of it is ever written down; a wide group of
linked, saturated nodes still costs the comparison of its blocks. A link of which one end is not
saturated stands in that end's list.

At the end, the links of a bounded sample of nodes are counted against all rows of their label. If too
few of them were found, further buckets start another descent from the lists so far.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components link with nothing, as do rows without label; rows that repeat an id are one vector
(the first usable one by label and content); rows without id link with nothing, each is returned, and
kept; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.llm.common import batch_rows, drop_stored, few_files, sound_vector, stored, usual_length
from roomgraph.llm.neardup import components
from roomgraph.llm.neighbours import (
    PROPOSED, _matrix, _Proposals, _runs, _vectors, merged, neighbours_of_neighbours,
)

#: Vectors of a bucket that are compared with each other, and saturated nodes of one block.
LEAF, RUN = 128, 1024
#: Float rounding of compact scores, and of angles.
ROUNDED, ANGLE = 1e-5, 1e-7
UNITS = "node long, unit array<double>, code binary, slack double"
BLOCKS = "component long, low double, high double, n long, nodes array<long>, counts array<long>, units binary"
LOG = logging.getLogger(__name__)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, v: n + v)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors, their signed bytes with a scale, and how far these are off at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1))
        x = x / np.abs(x).max(1)[:, None]
        x = x / np.sqrt((x * x).sum(1))[:, None]
        scale = (np.abs(x).max(1) / 127).astype("<f4")
        code = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
        off = np.sqrt(((x - code * scale[:, None].astype(float)) ** 2).sum(1)) + 1e-6
        made = np.concatenate([scale.view(np.int8).reshape(-1, 4), code], 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(
                pa.list_(pa.float64())), pa.array([r.tobytes() for r in made], pa.binary()), pa.array(off)],
            names=["node", "unit", "code", "slack"])


def starts(nodes: DataFrame, degree: int, tables: int, most: int, seed: int) -> DataFrame:
    """First proposals within each label of ``nodes`` (node, kind, of_kind, code): the best in blocks of
    vectors on the same side of random hyperplanes, and in random blocks. ``most``: the largest label."""
    bits = max(1, int(np.ceil(np.log2(max(2, most / LEAF)))))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(3))
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
            mine = np.ceil(np.log2(np.maximum(2, batch.column(2).to_numpy() / LEAF)))
            used = np.arange(bits)[None, :] < mine[:, None]
            up = (x @ planes > 0).reshape(len(x), tables, bits) & used[:, None, :]
            name = up @ (1 << np.arange(bits))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(x), t, np.int64)),
                     pa.array(name[:, t].astype(np.int64)), batch.column(3)],
                    names=["node", "kind", "t", "side", "code"])

    drawn = F.pmod(F.xxhash64("node", F.lit(seed)), F.greatest(F.lit(1), F.floor(F.col("of_kind") / LEAF)))
    placed = nodes.mapInArrow(sides, "node long, kind long, t long, side long, code binary").unionByName(
        nodes.select("node", "kind", F.lit(-1).cast("long").alias("t"), drawn.alias("side"), "code")
    ).select(F.xxhash64("kind", "t", "side").alias("bucket"), "kind", "node", "code")
    size = stored(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(f"size > {2 * LEAF}"))
    split = F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.coalesce("size", F.lit(1)) / (2 * LEAF)))
    blocks = placed.join(size, "bucket", "left").select(
        F.xxhash64("bucket", split).alias("block"), "kind", "node", "code")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Proposals(degree)
        for part in _runs(batches):
            block, kind, node = (part.column(i).to_numpy() for i in range(3))
            x = _vectors(part.column(3).combine_chunks())
            cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                s = x[a:b] @ x[a:b].T
                s[kind[a:b, None] != kind[None, a:b]] = -np.inf
                np.fill_diagonal(s, -np.inf)
                k = min(degree, b - a - 1)
                if k > 0:
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    score = np.take_along_axis(s, top, 1).ravel()
                    fits = np.isfinite(score)
                    found.add(np.repeat(node[a:b], k)[fits], node[a:b][top].ravel()[fits], score[fits])
        yield from found.batches()

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(compare, PROPOSED)


def descend(graph: DataFrame, proposals: DataFrame, n: int, degree: int, sample: int, settled: float,
            turns: Iterator[int]) -> DataFrame:
    """``graph`` with ``proposals``, bettered in rounds until less than ``settled`` of it is fresh."""
    nodes = stored(few_files(merged(graph, proposals, degree, sample, next(turns)), n, 1000))
    while True:
        fresh, every = nodes.agg(
            F.sum(F.size(F.filter("marks", lambda m: m > 0))), F.sum(F.size("marks"))).head()
        if not every or fresh / every < settled:
            return nodes
        turn = next(turns)
        told = neighbours_of_neighbours(nodes, degree, turn)
        after = stored(few_files(merged(nodes, told, degree, sample, turn), n, 1000))
        drop_stored(nodes)
        nodes = after


def links(graph: DataFrame, nodes: DataFrame, least: float, degree: int) -> tuple[DataFrame, DataFrame]:
    """The graph's edges (a, b) at ``least`` or above with counts and saturation of both ends, and
    (node, saturated, worst) of every node."""
    off = nodes.agg(F.max("slack")).head()[0] or 0.0
    near = graph.join(nodes.select("node", "slack"), "node").withColumn(
        "reach", least - ROUNDED - off - F.col("slack") * (1 + off))
    state = stored(near.select("node", "worst", (
        (F.size("others") >= degree) & (F.col("worst") >= F.col("reach"))).alias("saturated")))
    pairs = near.select("node", "reach", F.explode(F.arrays_zip("others", "scores")).alias("e")).filter(
        "e.scores >= reach").groupBy(
        F.least("node", "e.others").alias("a"), F.greatest("node", "e.others").alias("b")).agg(
        F.max("e.scores").alias("score"))
    ends = stored(nodes.join(state, "node").select("node", "kind", "n", "slack", "saturated"))

    def end(side: str) -> DataFrame:
        return ends.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in ends.columns])

    pairs = pairs.join(end("a"), "a").join(end("b"), "b").filter("kind_a = kind_b").withColumn(
        "slack", F.col("slack_a") + F.col("slack_b") * (1 + F.col("slack_a")) + ROUNDED)
    pairs = stored(pairs.filter(F.col("score") + F.col("slack") >= least))
    exact = pairs.filter(F.col("score") - F.col("slack") < least).join(
        nodes.select(F.col("node").alias("a"), F.col("unit").alias("unit_a")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("unit").alias("unit_b")), "b").filter(
        _dot("unit_a", "unit_b") >= least)
    shape = ["a", "b", "n_a", "n_b", "saturated_a", "saturated_b"]
    sure = pairs.filter(F.col("score") - F.col("slack") >= least)
    return stored(sure.select(*shape).unionByName(exact.select(*shape))), state


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most RUN rows of one component, in the order of their angles."""
    for part in _runs(batches):
        part = part.combine_chunks()
        key = part["component"].to_numpy()
        cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(a, b, RUN):
                rows = part.slice(at, min(RUN, b - at))
                angle, n = rows["angle"].to_numpy(), rows["n"].to_numpy()
                units = np.stack([np.asarray(u) for u in rows["unit"].combine_chunks().to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(key[a])]), pa.array([angle.min()]), pa.array([angle.max()]), pa.array([int(n.sum())]),
                     pa.array([rows["node"].to_numpy()], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())),
                     pa.array([units.astype("<f8").tobytes()], pa.binary())],
                    names=["component", "low", "high", "n", "nodes", "counts", "units"])


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, nodes_x, counts_x, units_x, nodes_y, counts_y, units_y = (
                    batch.column(c)[i] for c in range(8))
                nodes_x, counts_x, nodes_y, counts_y = (
                    v.values.to_numpy() for v in (nodes_x, counts_x, nodes_y, counts_y))
                a = np.frombuffer(units_x.as_py(), "<f8").reshape(len(nodes_x), -1)
                b = np.frombuffer(units_y.as_py(), "<f8").reshape(len(nodes_y), -1)
                near = a @ b.T >= least
                node, n = nodes_x, near @ counts_y
                if x.as_py() != y.as_py():
                    node, n = np.concatenate([node, nodes_y]), np.concatenate([n, counts_x @ near])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], names=["node", "n"])

    return run


def enlarged(saturated: DataFrame, least: float) -> DataFrame:
    """(node, n): how many vectors of ``saturated`` (node, component, n, worst, unit) each node of it is
    linked with, those equal to it and itself included."""
    spark = saturated.sparkSession
    bound = float(np.arccos(least))
    pivots = stored(saturated.groupBy("component").agg(F.max(F.struct(
        "worst", (-F.col("node")).alias("node"), "unit")).alias("p")).select(
        "component", F.col("p.unit").alias("pivot")))
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _dot("unit", "pivot")))
    turned = saturated.join(pivots, "component").select(
        "component", F.acos(cosine).alias("angle"), "node", "n", "unit")
    with batch_rows(spark, 4 * RUN):
        blocks = stored(turned.repartitionByRange("component", "angle", "node").sortWithinPartitions(
            "component", "angle", "node").mapInArrow(_cut, BLOCKS).withColumn(
            "block", F.monotonically_increasing_id()))
    light = blocks.select("block", "component", "low", "high", "n")
    every = stored(light.groupBy("component").agg(F.collect_list(F.struct("block", "low", "high", "n")).alias("all")))
    met = stored(light.join(every, "component").select(
        "block",
        F.aggregate("all", F.lit(0).cast("long"), lambda n, b: n + F.when(
            F.col("high") + b["high"] <= bound - ANGLE, b["n"]).otherwise(0)).alias("sure"),
        F.transform(F.filter("all", lambda b: (F.col("block") <= b["block"])
                             & (F.col("high") + b["high"] > bound - ANGLE)
                             & (b["low"] - F.col("high") <= bound + ANGLE)
                             & (F.col("low") - b["high"] <= bound + ANGLE)), lambda b: b["block"]).alias("open")))
    sure = blocks.select("block", F.explode("nodes").alias("node")).join(
        met.select("block", "sure"), "block").select("node", F.col("sure").alias("n"))

    def payload(side: str) -> DataFrame:
        return blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in ("block", "nodes", "counts", "units")])

    pairs = met.select(F.col("block").alias("block_x"), F.explode("open").alias("block_y"))
    columns = ["block_x", "block_y", "nodes_x", "counts_x", "units_x", "nodes_y", "counts_y", "units_y"]
    with batch_rows(spark, 16):
        compared = stored(pairs.join(payload("x"), "block_x").join(payload("y"), "block_y").select(
            *columns).mapInArrow(_compare(least), "node long, n long"))
    return sure.unionByName(compared).groupBy("node").agg(F.sum("n").alias("n"))


def _true_counts(asked: list, least: float):
    """Of each asked node (node, kind, unit): the vectors of its label at ``least`` or above."""
    node = np.array([r.node for r in asked], np.int64)
    kind = np.array([r.kind for r in asked], np.int64)
    unit = np.array([r.unit for r in asked], float).reshape(len(asked), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(node), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = (unit @ _matrix(batch.column(2)).T >= least) & (kind[:, None] == batch.column(0).to_numpy()[None, :])
                total += near @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], names=["node", "n_true"])

    return run


def audit(nodes: DataFrame, found: DataFrame, least: float, sample: int) -> tuple[int, int]:
    """(links found, links there are) of ``sample`` nodes drawn by a hash, counted against all rows."""
    asked = nodes.select("node", "kind", "unit").orderBy(F.xxhash64("node", F.lit(7)), "node").limit(sample).collect()
    if not asked:
        return 0, 0
    true = nodes.select("kind", "n", "unit").mapInArrow(
        _true_counts(asked, least), "node long, n_true long").groupBy("node").agg(F.sum("n_true").alias("n_true"))
    held = found.join(F.broadcast(true), "node").agg(  # one row a node of the sample
        F.sum(F.least("n_links", F.col("n_true") - 1)), F.sum(F.col("n_true") - 1)).head()
    return held[0] or 0, held[1] or 0


def near_vectors(rows: DataFrame, least: float = 0.93, degree: int = 24, sample: int = 12, tables: int = 4,
                 settled: float = 0.05, audited: int = 512, recall: float = 0.99, retries: int = 4,
                 vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and ``kept`` (the component's smallest id) of each vector."""
    if not 0.5 <= least <= 1:
        raise ValueError("least is a cosine from 0.5 to 1")
    v = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                    F.col(embedding).cast("array<double>").alias("vector"))
    usable = v.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & sound_vector("vector")).filter(
        F.exists("vector", lambda x: x != 0))
    length = usual_length(usable, "vector")
    members = stored(usable.filter(F.size("vector") == length).groupBy("id").agg(
        F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector"))
    distinct = stored(members.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
    of = stored(members.join(distinct, ["label", "vector"]).select("id", "node"))
    kinds = stored(distinct.groupBy("label").agg(F.count(F.lit(1)).alias("of_kind")).withColumn(
        "kind", F.monotonically_increasing_id()))
    n = distinct.count()
    units = distinct.select("node", "vector").mapInArrow(_units, UNITS)
    nodes = stored(few_files(distinct.join(kinds, "label").select("node", "n", "kind", "of_kind").join(
        units, "node"), n, 2000))
    most = kinds.agg(F.max("of_kind")).head()[0] or 0
    graph = nodes.select("node", "code", *[F.array().cast(t).alias(c) for c, t in (
        ("others", "array<long>"), ("scores", "array<float>"), ("marks", "array<int>"))])
    turns = count()
    for again in range(retries + 1):
        begun = starts(nodes.select("node", "kind", "of_kind", "code"), degree, tables, most, seed=11 + again)
        graph = descend(graph, begun, n, degree, sample, settled, turns)
        edges, state = links(graph, nodes, least, degree)
        reached = components(edges.select("a", "b"))
        listed = edges.filter("not (saturated_a and saturated_b)")
        listed = listed.select(F.col("a").alias("node"), F.col("n_b").alias("n")).unionByName(
            listed.select(F.col("b").alias("node"), F.col("n_a").alias("n")))
        full = state.filter("saturated").select("node", "worst").join(nodes.select("node", "n", "unit"), "node").join(
            reached.select(F.col("doc").alias("node"), "component"), "node", "left").withColumn(
            "component", F.coalesce("component", "node"))
        own = state.filter("not saturated").select("node").join(nodes.select("node", "n"), "node")
        counts = listed.unionByName(own).unionByName(enlarged(stored(full), least)).groupBy("node").agg(
            (F.sum("n") - 1).alias("n_links"))
        found = stored(few_files(nodes.select("node").join(counts, "node", "left").join(
            reached.select(F.col("doc").alias("node"), "component"), "node", "left").select(
            "node", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("component")), n, 10_000))
        caught, there = audit(nodes, found, least, audited)
        if caught >= recall * there:
            break
        LOG.warning("audit %d: %d of %d links found", again, caught, there)
    linked = of.join(found, "node").select("id", "n_links", "component")
    ids = v.filter("id is not null").select("id").distinct().join(linked, "id", "left").unionByName(
        v.filter("id is null").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "id")
    return ids.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
