"""Approximate nearest neighbours: a graph by NN-descent in Spark joins, and greedy search on it.

Every vector keeps its ``degree`` best neighbours so far. They begin with what random hyperplane
buckets give and with random ones, the best in a block drawn by a seeded hash, so that a vector
alone on its side of the hyperplanes has neighbours as well. In each round a vector's neighbours,
and a bounded random share of those that have it as a neighbour, meet in one list; pairs in a list
of which one is new are compared, and each of the two keeps what beats its worst neighbour. Rounds
end when few neighbours change.

A query, a row of the table itself, then walks the graph greedily: the best nodes found and not yet
opened are replaced by their neighbours, as far as these are new to the query, and the best of all
are kept, until all kept ones are opened. The best in the end are scored on the original vectors. A query that reaches fewer
candidates than asked for, though there are more, is held against all vectors, block by block.

Vectors travel as signed bytes with a scale; only the final scores decide the result. Equal vectors
are one node, whose smallest ids stand for it, so a very frequent vector is one node as well. Hub
nodes: lists take a bounded share of the nodes that point at a hub, and proposals are cut to the
best ``degree`` of a node where they are made, before they are shuffled.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; ties go to the smaller id; rows that repeat an id count once (its first by
content); with fewer candidates than asked for all are returned; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.llm.common import drop_stored, few_files, stored

#: Pairs of a bucket are compared in blocks of about so many vectors.
LEAF = 128
#: Vectors and queries of one block in the search over all vectors.
SCAN = 1024
PROPOSED = "node long, other long, score float"
#: A node with its neighbours, best first. Marks: 0 tried before, 1 fresh, 2 to be tried now.
NODES = ("node long, code binary, worst float, others array<long>, scores array<float>, "
         "marks array<int>")
BEAM = "query long, node long, score float, seen boolean, opens boolean"


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(node, ids, vector): distinct vectors that take part, with the smallest ids of each."""
    v = rows.select(F.col(vec_id).cast("long").alias("id"),
                    F.col(embedding).cast("array<double>").alias("vector"))
    sound = (F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
             & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("vector", lambda x: x != 0))
    v = v.filter(F.coalesce(sound, F.lit(False))).groupBy("id").agg(F.min("vector").alias("vector"))
    size = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head()
    v = v.filter(F.size("vector") == (size.n if size else 0))
    ranked = Window.partitionBy("vector").orderBy("id")
    return (v.withColumn("rank", F.row_number().over(ranked)).filter("rank <= 21")
            .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select(F.col("ids")[0].alias("node"), "ids", "vector"))


def packed(nodes: DataFrame) -> DataFrame:
    """(node, code): vectors as a scale (float32) and signed bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            scale = (np.abs(x).max(1) / 127).astype("<f4")
            scale = np.where((scale > 0) & np.isfinite(scale), scale, np.float32(1e-30))
            code = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
            made = np.concatenate([scale.astype("<f4").view(np.int8).reshape(-1, 4), code], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in made], pa.binary())],
                names=["node", "code"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, code binary")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _vectors(codes: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)
    return raw[:, 4:].astype(np.float32) * raw[:, :4].copy().view("<f4")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of the first column, which is sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _best(node: np.ndarray, other: np.ndarray, score: np.ndarray, degree: int) -> np.ndarray:
    """Places of each node's ``degree`` best distinct others."""
    order = np.lexsort((other, node))
    node, other = node[order], other[order]
    one = np.concatenate([[True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])])
    order = order[one[:len(order)]]
    node, score = node[one[:len(node)]], score[order]
    ranked = np.lexsort((-score, node))
    node, order = node[ranked], order[ranked]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])[:len(node)])
    place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    return order[place < degree]


class _Proposals:
    """Proposals of one task; when many are held, only each node's best are kept."""

    def __init__(self, degree: int):
        self.degree, self.parts, self.n, self.limit = degree, [], 0, 1_000_000

    def add(self, node, other, score) -> None:
        self.parts.append((node, other, score.astype(np.float32)))
        self.n += len(node)
        if self.n > self.limit:
            self._cut()
            self.limit = max(1_000_000, 2 * self.n)

    def _cut(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        keep = _best(*columns, self.degree)
        self.parts, self.n = [tuple(c[keep] for c in columns)], len(keep)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._cut()
            for at in range(0, self.n, 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at:at + 50_000]) for c in self.parts[0]],
                    names=["node", "other", "score"])


def from_buckets(codes: DataFrame, degree: int, tables: int, seed: int = 3) -> DataFrame:
    """First proposals: the best in blocks of vectors on the same side of random hyperplanes, and
    in random blocks over all vectors."""
    n = codes.count()
    bits = max(1, int(np.ceil(np.log2(max(2, n / LEAF)))))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
            up = (x @ planes > 0).reshape(len(x), tables, bits)
            name = up @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[:, t].astype(np.int64)), batch.column(0), batch.column(1)],
                    names=["bucket", "node", "code"])

    # at least LEAF vectors a block on average: none is ever left alone but by a table of one
    drawn = F.lit(tables << bits) + F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, n // LEAF)))
    placed = codes.mapInArrow(sides, "bucket long, node long, code binary").unionByName(
        codes.select(drawn.cast("long").alias("bucket"), "node", "code"))
    size = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    blocks = placed.join(size, "bucket").withColumn(
        "block", F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / (2 * LEAF)))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Proposals(degree)
        for part in _runs(batches):
            block, node = part.column(0).to_numpy(), part.column(1).to_numpy()
            x = _vectors(part.column(2).combine_chunks())
            cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                s = x[a:b] @ x[a:b].T
                np.fill_diagonal(s, -np.inf)
                k = min(degree, b - a - 1)
                if k > 0:
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    found.add(np.repeat(node[a:b], k), node[a:b][top].ravel(),
                              np.take_along_axis(s, top, 1).ravel())
        yield from found.batches()

    return blocks.select("block", "node", "code").repartition("block").sortWithinPartitions(
        "block").mapInArrow(compare, PROPOSED)


def merged(nodes: DataFrame, proposals: DataFrame, degree: int, sample: int, turn: int) -> DataFrame:
    """``nodes`` with each one's best distinct others of those it has and those proposed."""
    random = np.random.default_rng(turn).integers(1, 1 << 62, dtype=np.int64) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            mine = part.filter(pa.compute.is_valid(part["code"])).combine_chunks()
            told = part.filter(pa.compute.is_null(part["code"]))
            ids = mine["node"].to_numpy()
            counts = np.diff(_offsets(mine["others"]))
            node = np.concatenate([np.repeat(ids, counts), told["node"].to_numpy()])
            other = np.concatenate([_flat(mine["others"]), told["other"].to_numpy()]).astype(np.int64)
            score = np.concatenate([_flat(mine["scores"]), told["score"].to_numpy()]).astype(np.float32)
            fresh = np.concatenate([_flat(mine["marks"]) == 1, np.ones(len(told), bool)])
            order = np.argsort(fresh, kind="stable")  # of two equal edges the tried one stays
            keep = order[_best(node[order], other[order], score[order], degree)]
            node, other, score, fresh = node[keep], other[keep], score[keep], fresh[keep]
            # a random few of the fresh edges of each node are tried next
            mixed = (other ^ node * random) * random
            lot = np.lexsort((mixed, ~fresh, node))
            first = np.searchsorted(node, ids)
            size = np.searchsorted(node, ids, "right") - first
            place = np.empty(len(node), np.int64)
            place[lot] = np.arange(len(node)) - np.repeat(first, size)
            mark = np.where(fresh, np.where(place < sample, 2, 1), 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            last = first + size - 1
            worst = np.where(size >= degree, score[np.maximum(last, 0)] if len(score) else -np.inf, -np.inf)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in
                     (other, score, mark.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), mine["code"].combine_chunks() if isinstance(mine["code"], pa.ChunkedArray)
                 else mine["code"], pa.array(worst.astype(np.float32)), *lists],
                names=["node", "code", "worst", "others", "scores", "marks"])

    none = {c: F.lit(None).cast(t) for c, t in (
        ("code", "binary"), ("others", "array<long>"), ("scores", "array<float>"), ("marks", "array<int>"),
        ("other", "long"), ("score", "float"))}
    shape = ["node", "code", "others", "scores", "marks", "other", "score"]
    both = nodes.withColumns({c: none[c] for c in ("other", "score")}).select(*shape).unionByName(
        proposals.withColumns({c: none[c] for c in ("code", "others", "scores", "marks")}).select(*shape))
    return both.repartition("node").sortWithinPartitions("node").mapInArrow(run, NODES)


def _offsets(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.offsets.to_numpy()


def _flat(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False)


def neighbours_of_neighbours(nodes: DataFrame, degree: int, turn: int) -> DataFrame:
    """One round's proposals: in every node's list of neighbours, forward and a bounded random
    share backward, the pairs with a member that is tried now."""
    edges = nodes.select("node", F.explode(F.arrays_zip("others", "marks")).alias("e")).select(
        "node", F.col("e.others").alias("other"), F.col("e.marks").alias("mark")).filter("mark <> 1")
    drawn = Window.partitionBy("other", "mark").orderBy(F.xxhash64("node", "other", F.lit(turn)))
    back = edges.withColumn("_r", F.row_number().over(drawn)).filter(F.col("_r") <= degree)
    lists = edges.select(F.col("node").alias("at"), F.col("other").alias("node"), "mark").unionByName(
        back.select(F.col("other").alias("at"), "node", "mark"))
    lists = lists.join(nodes.select("node", "worst", "code"), "node").select(
        "at", "node", "mark", "worst", "code")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Proposals(degree)
        for part in _runs(batches):
            at, node, mark, worst = (part.column(i).to_numpy() for i in range(4))
            order = np.lexsort((-mark, node, at))
            one = order[np.concatenate([[True], (np.diff(at[order]) != 0) | (np.diff(node[order]) != 0)])]
            at, node, new, worst = at[one], node[one], mark[one] == 2, worst[one]
            x = _vectors(part.column(4).combine_chunks().take(pa.array(one)))
            cuts = np.flatnonzero(np.diff(at, prepend=at[0] - 1, append=at[-1] + 1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                w = new[a:b]
                if not w.any() or b - a < 2:
                    continue
                ids, v = node[a:b], x[a:b]
                s = v[w] @ v.T
                s[np.arange(len(s)), np.flatnonzero(w)] = -np.inf
                i, j = np.nonzero(s > worst[a:b][w][:, None])
                found.add(ids[w][i], ids[j], s[i, j])
                i, j = np.nonzero((s > worst[a:b][None, :]) & ~w[None, :])
                found.add(ids[j], ids[w][i], s[i, j])
        yield from found.batches()

    return lists.repartition("at").sortWithinPartitions("at").mapInArrow(compare, PROPOSED)


def build_graph(codes: DataFrame, degree: int = 50, sample: int = 20, tables: int = 2,
                settled: float = 0.1) -> DataFrame:
    """The neighbour graph of ``codes`` (node, code), as rows of ``NODES``.

    Rounds go on until less than ``settled`` of the edges are fresh. Lists only ever get better and
    a tried edge is not tried again, so this ends.
    """
    bare = codes.select("node", "code", *[F.array().cast(t).alias(c) for c, t in (
        ("others", "array<long>"), ("scores", "array<float>"), ("marks", "array<int>"))])
    n = codes.count()
    nodes = stored(few_files(
        merged(bare, from_buckets(codes, degree, tables), degree, sample, 0), n, 1000))
    for turn in count(1):
        told = neighbours_of_neighbours(nodes, degree, turn)
        after = stored(few_files(merged(nodes, told, degree, sample, turn), n, 1000))
        drop_stored(nodes)
        nodes = after
        fresh, every = nodes.agg(
            F.sum(F.size(F.filter("marks", lambda m: m > 0))), F.sum(F.size("marks"))).head()
        if not every or fresh / every < settled:
            break
    return nodes


def _exact(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, v: n + v)


def greedy_search(nodes: DataFrame, queries: DataFrame, width: int = 100, opened: int = 25
                  ) -> DataFrame:
    """(query, node, score, ...) of the best nodes that each of ``queries`` (node) reaches.

    ``opened`` nodes of a query are opened at a time, until its ``width`` best are all opened.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            query, node, kind, score, seen, opens = (
                part.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            codes = part.column(6).combine_chunks()
            cuts = np.flatnonzero(np.diff(query, prepend=query[0] - 1, append=query[-1] + 1))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                # kinds: 0 the query's own vector, 1 its beam, 2 reached nodes
                k = a + np.searchsorted(kind[a:b], [1, 2])
                mine, asking = slice(k[0], k[1]), _vectors(codes.slice(a, 1))[0]
                ids, at = np.unique(node[k[1]:b], return_index=True)
                at = at[~np.isin(ids, node[mine])] + k[1]
                # row by row, so that a node scores the same each time and a dropped one stays out
                s = (_vectors(codes.take(pa.array(at))) * asking).sum(1) if len(at) else np.zeros(0, np.float32)
                ids = np.concatenate([node[mine], node[at]]).astype(np.int64)
                s = np.concatenate([score[mine].astype(np.float32), s])
                was = np.concatenate([(seen[mine] | opens[mine]).astype(bool), np.zeros(len(at), bool)])
                best = np.lexsort((ids, -s))[:width]
                ids, s, was = ids[best], s[best], was[best]
                out.append((np.full(len(ids), query[a]), ids, s, was, ~was & (np.cumsum(~was) <= opened)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["query", "node", "score", "seen", "opens"])

    n = queries.count()
    own = few_files(queries.join(nodes.select("node", "code", "others", "scores"), "node"), n, 200)
    asked = own.select(F.col("node").alias("query"), "node", F.lit(0).alias("kind"), "code")
    beam = stored(own.select(F.col("node").alias("query"), F.posexplode(F.arrays_zip("others", "scores"))
                             .alias("place", "e")).select(
        "query", F.col("e.others").alias("node"), F.col("e.scores").alias("score"),
        F.lit(False).alias("seen"), (F.col("place") < opened).alias("opens")))
    columns = ["query", "node", "kind", "score", "seen", "opens", "code"]
    while not beam.filter("opens").isEmpty():
        reached = beam.filter("opens").select("query", "node").join(
            nodes.select("node", "others"), "node").select("query", F.explode("others").alias("node")
                                                          ).filter("query <> node")
        reached = reached.join(nodes.select("node", "code"), "node").withColumns({
            "kind": F.lit(2), "score": F.lit(0.0).cast("float"), "seen": F.lit(False), "opens": F.lit(False)})
        held = beam.withColumns({"kind": F.lit(1), "code": F.lit(None).cast("binary")})
        head = asked.withColumns({"score": F.lit(0.0).cast("float"), "seen": F.lit(False), "opens": F.lit(False)})
        rows = head.select(*columns).unionByName(held.select(*columns)).unionByName(reached.select(*columns))
        after = stored(few_files(rows.repartition("query").sortWithinPartitions("query", "kind")
                                 .mapInArrow(walk, BEAM), n, 200))
        drop_stored(beam)
        beam = after
    return beam


def search_all(nodes: DataFrame, queries: DataFrame, k: int, n: int, n_queries: int) -> DataFrame:
    """(query, node): the ``k`` best of all ``nodes`` (node, vector) for each of ``queries`` (node)."""
    def blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
        place = F.pmod(F.xxhash64("node"), F.lit(max(1, count // SCAN)))
        return rows.groupBy(place.alias("block")).agg(
            F.collect_list("node").alias(f"{name}_node"),
            F.flatten(F.collect_list("vector")).alias(f"{name}_vector")).drop("block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                query, asking, node, vector = (
                    batch.column(i)[at].values.to_numpy(zero_copy_only=False) for i in range(4))
                s = asking.reshape(len(query), -1) @ vector.reshape(len(node), -1).T
                top = np.lexsort((np.broadcast_to(node, s.shape), -s), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query, top.shape[1])), pa.array(node[top].ravel()),
                     pa.array(np.take_along_axis(s, top, 1).ravel())], names=["query", "node", "score"])

    asked = blocks(queries.join(nodes.select("node", "vector"), "node"), n_queries, "q")
    pairs = asked.crossJoin(blocks(nodes.select("node", "vector"), n, "n"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return pairs.mapInArrow(compare, "query long, node long, score double").withColumn(
        "_r", F.row_number().over(best)).filter(F.col("_r") <= k).select("query", "node")


def nearest(rows: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id",
            embedding: str = "embedding", degree: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` (up to 20) nearest found of the rows for which
    ``queries`` holds (over ``id``)."""
    nodes = stored(few_files(usable(rows, vec_id, embedding), rows.count(), 1000))
    codes = stored(packed(nodes))
    graph = build_graph(codes, degree)
    taking = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(
        "array<double>").alias("vector")).filter(queries).join(
        nodes.select("node", "vector"), "vector").groupBy("id").agg(F.min("node").alias("node"))
    taking = stored(few_files(taking, nodes.count(), 10_000))
    found = greedy_search(graph, taking.select("node").distinct())
    own = taking.select(F.col("node").alias("query"), "node").distinct()
    close = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = found.withColumn("_r", F.row_number().over(close)).filter(
        F.col("_r") <= 2 * k).select("query", "node").unionByName(own).distinct()
    n, ids = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).head()
    found = stored(few_files(found, taking.count(), 500))
    short = found.join(nodes.select("node", F.size("ids").alias("_n")), "node").groupBy("query").agg(
        F.sum("_n").alias("_n")).filter(F.col("_n") <= min(k, ids - 1)).select(F.col("query").alias("node"))
    short = stored(few_files(short, n, 10_000))
    n_short = short.count()
    if n_short:
        found = found.join(short.withColumnRenamed("node", "query"), "query", "left_anti").unionByName(
            search_all(nodes, short, k + 1, n, n_short))
    asked = nodes.select(F.col("node").alias("query"), F.col("vector").alias("asking"))
    exact = found.join(asked, "query").join(nodes, "node").select(
        "query", "ids", _exact(F.col("asking"), F.col("vector")).alias("score"))
    each = taking.join(exact.withColumnRenamed("query", "node"), "node").select(
        F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score"
    ).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
