"""Compressing vectors to codes: product quantization by Lloyd rounds over two trees.

Vectors become integers and are cut into parts; every part position has a codebook of a few entries.
The integer vectors are stored once in blocks. Each block carries, for each part position, a tree over
its parts (median splits of the widest side) whose nodes know their box, their number of parts and the
sum of these. A round builds such a tree over the entries of each codebook as well and walks both
together: pairs of a node of parts and a node of entries whose least distance is above the largest
distance of another pair go, an entry that is nowhere in a box nearer than another goes, and a node of
parts that is left with one entry is counted as a whole by its cached sum. Only leaves that stay
uncertain are looked at part by part. All of this is in integers, so the outcome is that of the plain
loop, ties included.

Between rounds only sums and counts of the entries are gathered, as many numbers as the codebooks have
(``entries`` times the vector length); blocks never move. A lost executor's tasks reread their blocks.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped, as
are vectors of another length than most; rows that repeat an id or a vector count each; rows without id
take part, last in order of ids; a length that ``parts`` doesn't divide gives the first parts one
component more; with fewer rows than ``entries`` the codebooks are shorter; an empty table gives no rows.
Components whose integer does not fit in 31 bits, or whose squared distances would not fit in 63, raise
an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.llm.common import batch_rows, floored, sound_vector, stored, usual_length

#: Components in one block, and parts in a leaf of a tree.
BLOCK, LEAF = 1 << 18, 16
BLOCKS = "ids array<long>, labels array<string>, points binary, trees binary"
GAINED = "part int, entry int, place int, total long, n long"
CODED = "vec_id long, label string, code string, error long"


def cuts_of(length: int, parts: int) -> np.ndarray:
    """Where the parts of a vector begin and end."""
    sizes = np.full(parts, length // parts)
    sizes[: length % parts] += 1
    return np.concatenate([[0], np.cumsum(sizes)])


def grow(points: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """A tree over the rows of ``points``: ``order`` lists them so that each node has a run of it."""
    order = np.arange(len(points))
    start, stop, child = [0], [len(points)], []
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        run = order[a:b]
        if b - a <= leaf:
            child.append(-1)
        else:
            box, half = points[run], (b - a) // 2
            if box.shape[1]:  # a part can be empty
                widest = int(np.argmax(box.max(0) - box.min(0)))
                order[a:b] = run[np.argpartition(box[:, widest], half)]
            child.append(len(start))
            start += [a, a + half]
            stop += [a + half, b]
        at += 1
    start, stop = np.array(start), np.array(stop)
    held = points[order]
    boxes = [(held[a:b].min(0), held[a:b].max(0), held[a:b].sum(0)) for a, b in zip(start, stop, strict=True)]
    low, high, total = (np.array(x, dtype=np.int64) for x in zip(*boxes, strict=True))
    return {"order": order.astype(np.int32), "start": start, "stop": stop, "child": np.array(child),
            "low": low, "high": high, "total": total}


def _least(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    best = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(best, owner, value)
    return best


def settle(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray
           ) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Nearest entry of all parts, ties to the lower index: (nodes, entries) that are settled as
    wholes, and (rows in the tree's order, entries) of those settled one by one."""
    over = grow(book, 1)
    size = over["stop"] - over["start"]
    single = np.where(size == 1, over["order"][over["start"]], -1).astype(np.int64)
    squares = (book * book).sum(1)
    whole, apart = [], []
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(node):
        low, high = tree["low"][node], tree["high"][node]
        e_low, e_high = over["low"][entry], over["high"][entry]
        gap = np.maximum(np.maximum(e_low - high, low - e_high), 0)
        reach = np.maximum(np.abs(e_high - low), np.abs(high - e_low))
        nearest = (gap * gap).sum(1)
        bound = _least(node, (reach * reach).sum(1), len(tree["start"]))
        keep = nearest <= bound[node]
        node, entry = node[keep], entry[keep]
        inner = single[entry] < 0
        if inner.any():  # open the nodes of entries first
            left = over["child"][entry[inner]]
            node = np.concatenate([node[~inner], node[inner], node[inner]])
            entry = np.concatenate([entry[~inner], left, left + 1])
            continue
        # an entry against the one nearest to the middle of the box, at the corner best for it
        low, high, index = tree["low"][node], tree["high"][node], single[entry]
        middle = 2 * book[index] - low - high
        central = (middle * middle).sum(1)
        by = np.lexsort((index, central, node))
        first = by[np.concatenate([[True], node[by][1:] != node[by][:-1]])]
        rival = np.zeros(len(tree["start"]), np.int64)
        rival[node[first]] = index[first]
        rival = rival[node]
        side = book[index] - book[rival]
        most = squares[rival] - squares[index] + 2 * (np.where(side > 0, high, low) * side).sum(1)
        keep = (index == rival) | (most > 0) | ((most == 0) & (index < rival))
        node, entry, index = node[keep], entry[keep], index[keep]
        left_over = np.bincount(node, minlength=len(tree["start"]))[node]
        done = left_over == 1
        whole.append((node[done], index[done]))
        node, entry, index = node[~done], entry[~done], index[~done]
        leaf = tree["child"][node] < 0
        if leaf.any():
            apart.append(_one_by_one(tree, points, book, node[leaf], index[leaf]))
        left, entry = tree["child"][node[~leaf]], entry[~leaf]
        node, entry = np.concatenate([left, left + 1]), np.concatenate([entry, entry])
    return whole, apart


def _one_by_one(tree, points, book, node, index) -> tuple[np.ndarray, np.ndarray]:
    """Rows of leaves, each against the entries that its leaf is left with."""
    size = (tree["stop"] - tree["start"])[node]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(tree["start"][node], size) + within
    which = np.repeat(index, size)
    far = points[row] - book[which]
    far = (far * far).sum(1)
    by = np.lexsort((which, far, row))
    first = by[np.concatenate([[True], row[by][1:] != row[by][:-1]])]
    return row[first], which[first]


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _blocks(cuts: np.ndarray):
    rows_each = max(64, BLOCK // max(1, int(cuts[-1])))

    def block(rows: pa.Table) -> pa.RecordBatch:
        flat = rows["ints"].combine_chunks()
        points = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        arrays = {f"{p}_{k}": v for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                  for k, v in grow(points[:, a:b], LEAF).items()}
        return pa.RecordBatch.from_arrays([
            pa.array([rows["vec_id"].to_pylist()], pa.list_(pa.int64())),
            pa.array([rows["label"].to_pylist()], pa.list_(pa.string())),
            pa.array([points.astype("<i4").tobytes()], pa.binary()),
            pa.array([_packed(arrays)], pa.binary())], names=["ids", "labels", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, rows_each - n)
                held.append(take)
                n += take.num_rows
                batch = batch.slice(take.num_rows)
                if n == rows_each:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _opened(batches: Iterator[pa.RecordBatch], cuts: np.ndarray):
    """(ids, labels, points, trees) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, points, trees = (batch.column(c)[i] for c in range(4))
            points = np.frombuffer(points.as_py(), "<i4").reshape(-1, int(cuts[-1])).astype(np.int64)
            arrays = np.load(io.BytesIO(trees.as_py()))
            yield ids, labels, points, [
                {k: arrays[f"{p}_{k}"] for k in ("order", "start", "stop", "child", "low", "high", "total")}
                for p in range(len(cuts) - 1)]


def _gains(cuts: np.ndarray, books: list[np.ndarray]):
    """What each entry gets: sum and number of its parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros_like(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        for _, _, points, trees in _opened(batches, cuts):
            for p, (tree, book) in enumerate(zip(trees, books, strict=True)):
                held = points[tree["order"], cuts[p]:cuts[p + 1]]
                whole, apart = settle(tree, held, book)
                for node, index in whole:
                    np.add.at(total[p], index, tree["total"][node])
                    np.add.at(n[p], index, (tree["stop"] - tree["start"])[node])
                for row, index in apart:
                    np.add.at(total[p], index, held[row])
                    np.add.at(n[p], index, 1)
        for p, book in enumerate(books):
            entry, place = (x.ravel() for x in np.indices(book.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(book.size, p, np.int32)), pa.array(entry.astype(np.int32)),
                 pa.array(place.astype(np.int32)), pa.array(total[p].ravel()),
                 pa.array(np.repeat(n[p], book.shape[1]))],
                names=["part", "entry", "place", "total", "n"])

    return run


def _codes(cuts: np.ndarray, books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, points, trees in _opened(batches, cuts):
            code = np.zeros((len(points), len(books)), np.uint8)
            error = np.zeros(len(points), np.int64)
            for p, (tree, book) in enumerate(zip(trees, books, strict=True)):
                part = points[:, cuts[p]:cuts[p + 1]]
                whole, apart = settle(tree, part[tree["order"]], book)
                told = np.zeros(len(points), np.int64)
                for node, index in whole:
                    for k, e in zip(node, index, strict=True):
                        told[tree["start"][k]:tree["stop"][k]] = e
                for row, index in apart:
                    told[row] = index
                mine = np.empty(len(points), np.int64)
                mine[tree["order"]] = told
                code[:, p] = mine
                far = part - book[mine]
                error += (far * far).sum(1)
            yield pa.RecordBatch.from_arrays(
                [ids.values, labels.values, pa.array([c.tobytes().hex() for c in code], pa.string()),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def encode(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
           vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each row that takes part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    spark = rows.sparkSession
    sound = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.col(embedding).cast("array<double>").alias("vector")).filter(sound_vector("vector"))
    length = usual_length(sound, "vector")
    sound = sound.filter(F.size("vector") == length).select(
        "vec_id", "label", floored("vector", scale).alias("ints"))
    cuts = cuts_of(length, parts)
    with batch_rows(spark, BLOCK // max(1, length)):
        blocks = stored(sound.mapInArrow(_blocks(cuts), BLOCKS))
    first = sound.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()
    start = np.array([r.ints for r in first], np.int64).reshape(len(first), length)
    books = [start[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    extent = F.max(F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints"))))
    if length * (2 * (sound.agg(extent).head()[0] or 0)) ** 2 >= 2 ** 62:
        raise ValueError("squared distances of these components do not fit in 63 bits")
    with batch_rows(spark, 8):
        for _ in range(rounds if first else 0):
            gained = blocks.mapInArrow(_gains(cuts, books), GAINED).groupBy("part", "entry", "place").agg(
                F.sum("total").alias("total"), F.sum("n").alias("n"))
            for r in gained.filter("n > 0").collect():  # as many rows as the codebooks have numbers
                books[r.part][r.entry, r.place] = r.total // r.n
        coded = stored(blocks.mapInArrow(_codes(cuts, books), CODED))
    named = ",".join(str(x) for book in books for x in book.ravel().tolist())
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    return coded.join(sums, coded["label"].eqNullSafe(sums["label"])).select(
        "vec_id", coded["label"], "code", "error", "label_error",
        F.lit(hashlib.sha256(named.encode()).hexdigest()).alias("codebooks_sha256"))
