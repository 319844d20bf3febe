"""Hard negatives: for each anchor and positive, the best other-label rows within a band of scores.

Vectors become integers; a score is an integer inner product. Every vector is turned by one seeded
rotation and keeps one bit a component, its length and the alignment of its direction with the code
vector (the unit vector of these signs). For an anchor, the inner product with a code vector comes
from popcounts over the bit planes of the turned anchor; what the code vector misses of a row is
orthogonal to it, so by Cauchy-Schwarz the score lies in an interval that is sure, not likely. Rows
whose interval can't reach what is asked for go; only the others are scored in integers.

Anchors, a stated share of the rows, meet all rows block against block: blocks are dealt by a hash of
the id, so no label or group of copies makes one large, and from each meeting only the best few of an
anchor go on. First the positives (the best rows of the anchor's label), then, with these known, the
rows of other labels between ``low`` percent and 100 percent of each positive's score. With one sign
a component, the interval is wide: it drops rows that are far from an anchor with near positives, and
few for an anchor without.

Defined cases: rows without id or label, or whose vector is null, empty, of another length than most
or holds null or non-finite components take no part; a zero vector scores 0; rows that repeat an id
count once (the first by label and content); equal scores go to the smaller id; where there are fewer
rows than asked for, all are returned; an anchor without positives gives no rows; an empty table gives
none. Components whose integer does not fit in 31 bits, or whose scores would not fit in 63, raise an
error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.llm.common import floored, sound_vector, stored, usual_length

#: Rows and anchors of one block; rows whose intervals are made at once; bits of a turned anchor.
ROWS, ANCHORS, PLANES = 65_536, 16_384, 8
CODES = "id long, label string, code binary, size double, align double, ints binary"
FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


def rotation(length: int, seed: int) -> np.ndarray:
    """A seeded orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(length, length)))
    return q * np.sign(np.diag(r))


def _bits(up: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-up.shape[1] // 64)
    wide = np.zeros((len(up), words * 64), bool)
    wide[:, : up.shape[1]] = up
    return np.packbits(wide, axis=1).view("<u8")


def _coded(length: int, seed: int):
    turn = rotation(length, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            size = np.sqrt((ints.astype(float) ** 2).sum(1))
            turned = (ints @ turn.T) / np.where(size > 0, size, 1)[:, None]
            align = np.where(size > 0, np.abs(turned).sum(1) / np.sqrt(length), 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in _bits(turned > 0)], pa.binary()),
                 pa.array(size), pa.array(align), pa.array([v.tobytes() for v in ints.astype("<i4")], pa.binary())],
                names=["id", "label", "code", "size", "align", "ints"])

    return run


class _Block:
    """Rows of one block, by label."""

    def __init__(self, rows: pa.Table, length: int):
        rows = rows.sort_by([("label", "ascending"), ("id", "ascending")]).combine_chunks()
        self.id = rows["id"].to_numpy()
        self.label = rows["label"].to_numpy()
        n = len(self.id)
        self.code = np.frombuffer(b"".join(rows["code"].to_pylist()), "<u8").reshape(n, -1)
        self.size, self.align = rows["size"].to_numpy(), rows["align"].to_numpy()
        self.ints = np.frombuffer(b"".join(rows["ints"].to_pylist()), "<i4").reshape(n, length)
        names, first = np.unique(self.label, return_index=True)
        self.runs = dict(zip(names, zip(first, np.append(first[1:], n), strict=True), strict=True))

    def of(self, label: str) -> slice:
        return slice(*self.runs.get(label, (0, 0)))

    def interval(self, at: slice | np.ndarray, anchor: np.ndarray, turn: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that the rows ``at`` can have with ``anchor``."""
        asked = turn @ anchor.astype(float)
        length, square = len(asked), float((asked * asked).sum())
        low, step = asked.min(), (asked.max() - asked.min()) / (2 ** PLANES - 1)
        level = np.rint((asked - low) / step).astype(np.int64) if step > 0 else np.zeros(length, np.int64)
        planes = _bits(((level[None, :] >> np.arange(PLANES)[:, None]) & 1).astype(bool))
        code = self.code[at]
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        raised = np.zeros(len(code))
        for k, plane in enumerate(planes):
            raised += float(1 << k) * np.bitwise_count(code & plane).sum(1, dtype=np.int64)
        along = (2 * (low * ones + step * raised) - asked.sum()) / np.sqrt(length)
        off = 2 * np.abs(asked - low - step * level).sum() / np.sqrt(length)
        align, size = self.align[at], self.size[at]
        rest = np.sqrt(np.maximum(square - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        width = align * off + np.sqrt(np.maximum(1 - align * align, 0)) * rest
        slack = 1e-7 * size * np.sqrt(square) + 1e-6
        return size * (align * along - width) - slack, size * (align * along + width) + slack

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.ints[at].astype(np.int64) @ anchor.astype(np.int64)

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.id[at], -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _anchors(rows: pa.Table, length: int) -> Iterator[tuple[int, str, np.ndarray, dict]]:
    for r in rows.to_pylist():
        yield r["anchor_id"], r["anchor_label"], np.frombuffer(r["anchor_ints"], "<i4").reshape(length), r


def _emitted(parts: list[tuple]) -> pa.Table:
    names = ["anchor_id", "positive_id", "positive_score", "other_id", "score"]
    columns = [np.concatenate([np.broadcast_to(p[i], len(p[3])) for p in parts]) if parts
               else np.zeros(0, np.int64) for i in range(5)]
    return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def _positives(length: int, seed: int, k: int):
    turn = rotation(length, seed)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _emitted([])
        block, out = _Block(right, length), []
        for anchor, label, ints, _ in _anchors(left, length):
            same = block.of(label)
            at = np.arange(same.start, same.stop)
            at = at[block.id[at] != anchor]
            least, most = block.interval(at, ints, turn)
            at = at[most >= _kth(least, k)]
            score = block.scores(at, ints)
            top = block.best(at, score, k)
            out.append((anchor, 0, 0, block.id[at][top], score[top]))
        return _emitted(out)

    return run


def _negatives(length: int, seed: int, k: int, low: int):
    turn = rotation(length, seed)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _emitted([])
        block, out = _Block(right, length), []
        every = np.arange(len(block.id))
        for anchor, label, ints, row in _anchors(left, length):
            same = block.of(label)
            at = np.concatenate([every[: same.start], every[same.stop:]])
            least, most = block.interval(at, ints, turn)
            # low * positive <= 100 * score <= 100 * positive
            bands = [(p["other_id"], p["score"]) for p in row["positives"] if low * p["score"] <= 100 * p["score"]]
            wanted = np.zeros(len(at), bool)
            for _, p in bands:
                inside = (100 * least >= low * p) & (most <= p)
                wanted |= (100 * most >= low * p) & (least <= p) & (most >= _kth(least[inside], k))
            kept = at[wanted]
            score = block.scores(kept, ints)
            for positive, p in bands:
                fits = (low * p <= 100 * score) & (score <= p)
                top = block.best(kept[fits], score[fits], k)
                out.append((anchor, positive, p, block.id[kept[fits]][top], score[fits][top]))
        return _emitted(out)

    return run


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80,
         scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
         seed: int = 17) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that
    ``anchors`` (over ``id``) holds for."""
    if not 0 <= low <= 100:
        raise ValueError("low is a percentage")
    spark = rows.sparkSession
    sound = rows.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(embedding).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & sound_vector("vector"))
    length = usual_length(sound, "vector")
    sound = sound.filter(F.size("vector") == length).groupBy("id").agg(
        F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", floored("r.vector", scale).alias("ints"))
    codes = stored(sound.mapInArrow(_coded(length, seed), CODES))
    n, far = codes.agg(F.count(F.lit(1)), F.max("size")).head()
    if far is not None and far * far >= 2 ** 56:
        raise ValueError("scores of these components do not fit in 63 bits")
    asked = codes.filter(anchors).select(*[F.col(c).alias(f"anchor_{c}") for c in ("id", "label", "ints")])
    n_asked = asked.count()
    # blocks of both sides have a size that doesn't go with the table's; each row block meets each
    # anchor block once, in a task of its own
    n_rows = max(2 * spark.sparkContext.defaultParallelism, n // ROWS + 1)
    n_anchors = n_asked // ANCHORS + 1
    placed = codes.select("*", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_rows)).alias("rows"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("anchors"))

    def met(asking: DataFrame, judge) -> DataFrame:
        asking = asking.select(
            "*", F.pmod(F.xxhash64("anchor_id", F.lit(2)), F.lit(n_anchors)).cast("int").alias("anchors"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("rows"))
        return asking.groupBy("rows", "anchors").cogroup(placed.groupBy("rows", "anchors")).applyInArrow(
            judge, FOUND)

    close = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    near = met(asked, _positives(length, seed, positives)).withColumn(
        "_r", F.row_number().over(close)).filter(F.col("_r") <= positives)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "score")).alias("positives"))
    asking = stored(asked.join(near, "anchor_id"))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    return met(asking, _negatives(length, seed, negatives, low)).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
