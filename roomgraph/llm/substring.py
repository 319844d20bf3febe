"""Repeated spans of words: compacted de Bruijn paths over word k-mers, checked by coordinates.

A window of ``window`` consecutive words is an edge of the de Bruijn graph of the corpus. Each
window is named by its anchor, the ``k``-word run in it whose hash is smallest; equal windows have
equal anchors. The consecutive windows of a document that share an anchor form a path, which can't
branch but at its ends.

1. Anchors are counted over the corpus. Windows on an anchor that occurs once are unique; of the
   rest only the paths are taken on, each with a hash of its windows.
2. Equal paths compact to one through an aggregation and a join: all but the first occurrence, by
   source coordinates, repeat every window of it.
3. Where an anchor has several distinct paths the graph branches. Only there, and only the first
   occurrence of each distinct path, are the windows compared one by one, again by coordinates.

What steps 2 and 3 name is the exact set of windows that also start earlier; a document's words
under such windows are removed. Anchors, paths and windows that are very frequent meet only in
aggregations with partial sums and in joins that Spark splits.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; rows
without id come before all others; rows that repeat an id are ordered by a hash of their texts, and
fully equal rows are one document, kept alike. Other columns are ignored by the operator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.llm.common import drop_stored, few_files, small_batches, stored, text_of
from roomgraph.llm.shingles import _power, hashed_words, mixed

ANCHORS = "anchor long, key long"
PATHS = "anchor long, path long, doc long, version long, lo int, n int"
EDGES = "anchor long, edge long, doc long, version long, lo int"
CLEAN = "n_words long, n_removed long, text string, kept_sha256 string"


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words of an array, by differences of one running sum."""
    m = max(0, len(words) - length + 1)
    up, down = _power(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:len(words)], out=total[1:])
    return mixed((total[length:] - total[:m]) * down[:m] + np.uint64(length))


def paths_of(words: np.ndarray, starts: np.ndarray, window: int, k: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of a group of texts: first window, number of windows, anchor hash and text."""
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    short = _runs(words, k)
    n = len(words) - window + 1
    view = np.lib.stride_tricks.sliding_window_view(short, window - k + 1)
    anchor = view[:n].argmin(1) + np.arange(n)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = owner[:n] == owner[window - 1:window - 1 + n]
    new = whole & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1]
                                  | (owner[1:n] != owner[:n - 1])])
    first = np.flatnonzero(new)
    number = np.add.reduceat(whole, first).astype(np.int64) if len(first) else first
    return first, number, short[anchor[first]], owner[first]


def _keyed(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    low = F.lit(-(1 << 63))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), low).alias("doc"),
        F.xxhash64(text_of(text)).alias("version"), text_of(text).alias("text"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"),
    ).withColumn("key", F.xxhash64("doc", "version"))


def anchors(rows: DataFrame, window: int, k: int) -> DataFrame:
    """The anchors of every text, with a hash of the document's id and version.

    Two documents that share that hash would only be looked at for each other's anchors too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for at, _, words, starts in hashed_words(texts, lower=False):
                _, _, anchor, owner = paths_of(words, starts, window, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(key[at + owner])],
                    names=["anchor", "key"])

    return rows.select("key", "text").mapInArrow(run, ANCHORS)


def _chosen(batches: Iterator[pa.RecordBatch], window: int, k: int, by_anchor: bool):
    """Of batches (doc, version, text, wanted) the paths whose anchor, or whose first window, is
    among the row's ``wanted``: first window, number, anchor, row, that row's start, and the hashes
    of all windows."""
    for batch in batches:
        doc, version = (batch.column(i).to_numpy() for i in (0, 1))
        texts = [t.encode() for t in batch.column(2).to_pylist()]
        wanted = batch.column(3).to_pylist()
        for at, end, words, starts in hashed_words(texts, lower=False):
            first, number, anchor, owner = paths_of(words, starts, window, k)
            mine = [np.asarray(w, np.int64) + (0 if by_anchor else starts[i])
                    for i, w in enumerate(wanted[at:end])]
            keep = np.isin(anchor.view(np.int64) if by_anchor else first,
                           np.concatenate([np.zeros(0, np.int64), *mine]))
            row = at + owner[keep]
            yield (first[keep], number[keep], anchor[keep], doc[row], version[row],
                   starts[owner[keep]], _runs(words, window))


def _spread(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the paths, and where each path's begin among them."""
    offsets = np.cumsum(number) - number
    return np.repeat(first - offsets, number) + np.arange(number.sum()), offsets


def named_paths(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Paths of ``rows`` (doc, version, text, often) on one of the row's ``often`` anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, number, anchor, doc, version, start, edges in _chosen(batches, window, k, True):
            place, offsets = _spread(first, number)
            name = np.zeros(len(first), np.uint64)
            if len(first):
                # a path's content: its windows in order, and how many
                turn = (place - np.repeat(first, number)).astype(np.uint64)
                spun = mixed(edges[place] + turn * np.uint64(0x9E3779B97F4A7C15))
                name = mixed(np.add.reduceat(spun, offsets) + number.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), pa.array(doc),
                pa.array(version), pa.array((first - start).astype(np.int32)),
                pa.array(number.astype(np.int32))],
                names=["anchor", "path", "doc", "version", "lo", "n"])

    return rows.select("doc", "version", "text", "often").mapInArrow(run, PATHS)


def opened_paths(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Every window of the paths of ``rows`` (doc, version, text, los) that begin at ``los``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, number, anchor, doc, version, start, edges in _chosen(batches, window, k, False):
            place, _ = _spread(first, number)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(anchor, number).view(np.int64)),
                pa.array(edges[place].view(np.int64)), pa.array(np.repeat(doc, number)),
                pa.array(np.repeat(version, number)),
                pa.array((place - np.repeat(start, number)).astype(np.int32))],
                names=["anchor", "edge", "doc", "version", "lo"])

    return rows.select("doc", "version", "text", "los").mapInArrow(run, EDGES)


def repeats(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Spans of windows that also start earlier: doc, version, first window, number of windows."""
    n = rows.count()

    def kept(df: DataFrame) -> DataFrame:
        return stored(few_files(df, n, 1000))

    found = anchors(rows, window, k)
    # counted sides are stored, so that both sides of a join come from exchanges of its own: only then
    # does Spark split an anchor that very many documents share
    often = kept(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor"))
    marked = kept(found.join(often, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("often")))
    drop_stored(often)
    paths = kept(named_paths(rows.join(marked, "key"), window, k))
    drop_stored(marked)

    place = F.struct("doc", "version", "lo")
    firsts = kept(paths.groupBy("anchor", "path").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("times")))
    again = firsts.filter("times > 1").select("anchor", "path", "first")
    whole = kept(paths.join(again, ["anchor", "path"]).filter(F.col("first") != place).select(
        "doc", "version", "lo", "n"))
    drop_stored(paths)

    forks = kept(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor"))
    leaders = kept(firsts.join(forks, "anchor", "left_semi").groupBy(
        F.col("first.doc").alias("doc"), F.col("first.version").alias("version")).agg(
        F.collect_set("first.lo").alias("los")))
    drop_stored(forks)
    drop_stored(firsts)
    edges = kept(opened_paths(rows.join(leaders, ["doc", "version"]), window, k))
    drop_stored(leaders)
    shared = kept(edges.groupBy("anchor", "edge").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor", "edge", "first"))
    single = kept(edges.join(shared, ["anchor", "edge"]).filter(
        F.col("first") != place).select("doc", "version", "lo", F.lit(1).alias("n")))
    drop_stored(shared)
    drop_stored(edges)
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, window: int = 20, k: int = 6, doc_id: str = "doc_id",
                   text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id alone by default), n_words, n_removed, the text that is left
    and the digest of its words.

    A text that loses nothing is returned as it was; of others the kept words are joined by one
    space.
    """
    small_batches(docs.sparkSession)
    keep = [doc_id] if keep is None else keep
    rows = _keyed(docs, doc_id, text, keep)
    spans = stored(few_files(repeats(rows, window, k).groupBy("doc", "version").agg(
        F.collect_list("lo").alias("los"), F.collect_list("n").alias("ns")), docs.count(), 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, los, ns = (c.to_pylist() for c in batch.columns[:3])
            out = []
            for said, at, number in zip(texts, los, ns, strict=True):
                words = said.encode().split()
                kept = words
                if at:
                    lo = np.array(at)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + np.array(number) + window - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), joined.decode() if at else said,
                            hashlib.sha256(joined).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                batch.columns[3:] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=[f"c{i}" for i in range(len(keep))]
                + ["n_words", "n_removed", "text", "kept_sha256"])

    held = rows.join(spans, ["doc", "version"], "left").select("text", "los", "ns", "row.*")
    schema = ", ".join([f"c{i} {kind}" for i, (_, kind) in enumerate(docs.select(*keep).dtypes)] + [CLEAN])
    out = held.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)],
                      "n_words", "n_removed", "text", "kept_sha256")
