"""Near-duplicate documents: one-permutation hashing, banded buckets and star-shaped candidates.

1. A document's set of five-word shingles is hashed once; its hashes fall into bins, empty bins
   take the hash of another bin by optimal densification, and bands of bins name buckets.
2. Documents with equal sets form one class; only its smallest id goes on.
3. Candidates are a star in each bucket: every member against the bucket's hub, the member with
   the smallest share of shingles that no other candidate has. Candidates are confirmed on the
   full sets, confirmed links joined to components.
4. A star alone may miss links between two of its rays. A shingle that only one candidate has
   can't be shared, which bounds every similarity from above; of two documents that the bound
   lets be linked one has few such shingles. So only these are held against the members of other
   components in their buckets, and only pairs within the bound are made whose one-bit MinHash
   signatures come near the threshold. In one component all is known already.

A link at the threshold is missed if no band of the two agrees, or if their ``BITS`` independent
signature bits agree five standard deviations too rarely; with ``rows`` and ``bands`` as in the
query either happens with a probability below 1e-6.

Defined cases: a document without words has an empty set, is linked with nothing and is its own
component. Rows without id take no part and have no component; they are kept. Where an id
repeats with several texts, each text is linked by itself, and its rows have the component of that
text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomgraph.llm.common import drop_stored, few_files, small_batches, stored, text_of
from roomgraph.llm.shingles import mixed, shingle_sets

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
#: Bits of the signature that pairs are held against before they are made.
BITS = 1024
#: Rounds of a labelling; it ends far earlier, as labels jump along each other.
MOST_ROUNDS = 100


def _donors(bins: int) -> np.ndarray:
    """For every bin the other bins in a random order of its own."""
    return np.argsort(np.random.default_rng(20).random((bins, bins)), axis=1)


def band_hashes(hashes: np.ndarray, bands: int, rows: int, donors: np.ndarray) -> np.ndarray:
    """Bucket names of a set of sorted distinct 64-bit hashes."""
    bins = bands * rows
    # the upper half of a hash says the bin, so sorted hashes come by bin and the first is least
    place = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    least = np.zeros(bins, np.uint64)
    held = np.zeros(bins, bool)
    least[place[first]], held[place[first]] = hashes[first], True
    if not held.all():
        order = donors[~held]
        least[~held] = least[order[np.arange(len(order)), held[order].argmax(1)]]
    name = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + column)
    return name.view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int, with_text: bool = False) -> DataFrame:
    """doc_id, size and digests of the shingle set, the names of its buckets, and if asked the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        donors = _donors(bands * rows)
        for batch in batches:
            sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()])
            a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            names = []
            for k, s in enumerate(sets):
                a[k] = mixed(s).sum()
                b[k] = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
                names.append(band_hashes(s, bands, rows, donors) if len(s) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                pa.array(names, pa.list_(pa.int64())), *batch.columns[1:1 + with_text]],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "text"][:5 + with_text])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       text_of("text").alias("text")).mapInArrow(
        run, SKETCH + ", text string" if with_text else SKETCH)


def lonely_shingles(texts: DataFrame) -> DataFrame:
    """(doc, n_lone): shingles that none of the other ``texts`` (doc, text) has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()])
            owner = np.repeat(ids, [len(s) for s in sets])
            every = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(every), pa.array(owner.astype(np.int64))], names=["shingle", "doc"])

    return (
        texts.mapInArrow(run, "shingle long, doc long").groupBy("shingle")
        .agg(F.min("doc").alias("doc"), F.max("doc").alias("other")).filter("doc = other")
        .groupBy("doc").agg(F.count(F.lit(1)).alias("n_lone"))
    )


def one_bit_signatures(texts: DataFrame) -> DataFrame:
    """(doc, bits): the lowest bit of ``BITS`` independent MinHash values, in longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.default_rng(21).integers(1, 1 << 63, (2, BITS), dtype=np.uint64)
        factor, shift = seeds[0] | np.uint64(1), seeds[1]
        for batch in batches:
            out = []
            for s in shingle_sets([t.encode() for t in batch.column(1).to_pylist()]):
                low = np.zeros(BITS, np.uint8)
                step = max(1, (1 << 18) // max(1, len(s)))
                for at in range(0, BITS if len(s) else 0, step):
                    part = slice(at, at + step)
                    # the products' upper halves are well mixed; their least one says the bit
                    least = ((s[None, :] ^ shift[part, None]) * factor[part, None]).min(1)
                    low[part] = mixed(least) & np.uint64(1)
                out.append(np.packbits(low).view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc", "bits"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, bits array<long>")


def _near_bits(percent: int) -> int:
    """So many bits agree at least, but for chance, at a similarity of ``percent``."""
    share = (1 + percent / 100) / 2
    return int(BITS * share - 5 * (BITS * share * (1 - share)) ** 0.5)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets reach ``percent``; ``texts`` has (doc, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            texts_now = dict(zip(a + b, text_a + text_b, strict=True))
            fresh = [k for k in texts_now if k not in known]
            known = {k: known[k] for k in texts_now if k in known}
            known.update(zip(fresh, shingle_sets([texts_now[k].encode() for k in fresh]),
                             strict=True))
            keep = []
            for x, y in zip(a, b, strict=True):
                s, t = known[x], known[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)],
                                             names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b"
                                                         ).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc, component): the smallest id reachable over ``links`` (a, b), for ids that have one.

    Every round takes the smallest label among the neighbours, then the label of one's label.
    """
    n = links.count()
    edges = stored(few_files(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select("b", "a")).filter("u <> v").distinct(), n, 50_000))
    labels = stored(few_files(
        edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), n, 50_000))
    for _ in range(MOST_ROUNDS):
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(
            F.min("label").alias("near"))
        better = labels.join(near, "u").select("u", F.least("label", "near").alias("next"),
                                               F.col("label").alias("was"))
        jump = better.select(F.col("u").alias("next"), F.col("next").alias("far"))
        after = stored(few_files(better.join(jump, "next", "left").select(
            "u", F.least("next", F.coalesce("far", "next")).alias("label"), "was"), n, 50_000))
        moved = after.filter("label <> was").limit(1).count()
        drop_stored(labels)
        labels = after
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {MOST_ROUNDS} rounds")
    return labels.select(F.col("u").alias("doc"), F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = 40, rows: int = 5
                    ) -> DataFrame:
    """doc_id, n_shingles, component_id and ``kept`` (the component's smallest id) of each row."""
    sketch = stored(sketches(docs, bands, rows))
    usable = sketch.filter("doc_id is not null and n_shingles > 0")
    # a class has a number of its own, as one id can stand for several
    classes = stored(few_files(usable.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), sketch.count(), 20_000
    ).withColumn("doc", F.monotonically_increasing_id()))
    members = classes.select("doc", F.posexplode("bands").alias("band", "bucket"))
    busy = members.groupBy("band", "bucket").agg(
        F.min("doc").alias("_lo"), F.max("doc").alias("_hi")).filter("_lo <> _hi").select("band", "bucket")
    ids = members.join(busy, ["band", "bucket"]).select("doc").distinct()
    named = classes.join(ids, "doc").select("doc", "doc_id", "set_a", "set_b")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        named.select("doc_id").distinct(), "doc_id")
    texts = sketches(texts, bands, rows, with_text=True).join(
        named, ["doc_id", "set_a", "set_b"]).groupBy("doc").agg(
        F.min("text").alias("text"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    texts = stored(few_files(texts, sketch.count(), 5000))
    members = texts.select("doc", "n", F.posexplode("bands").alias("band", "bucket")).join(
        busy, ["band", "bucket"])
    texts = texts.select("doc", "text")
    n = texts.count()
    lone = lonely_shingles(texts)
    mine = members.groupBy("doc").agg(
        F.max("n").alias("n"), F.collect_set(F.struct("band", "bucket")).alias("names"))
    mine = stored(few_files(mine.join(lone, "doc", "left").select(
        "doc", "n", (F.col("n") - F.coalesce("n_lone", F.lit(0))).alias("shared"), "names"), n, 2000))

    # 100 i >= p (n1 + n2 - i), and i is at most what either shares with anything
    def possible(x: str, y: str) -> Column:
        return ((100 + percent) * F.least(f"{x}.shared", f"{y}.shared")
                >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n")))

    rays = mine.select("doc", "n", "shared", F.explode("names").alias("at")).select(
        "doc", "n", "shared", "at.band", "at.bucket")
    hubs = rays.groupBy("band", "bucket").agg(
        F.min(F.struct((1 - F.col("shared") / F.col("n")).alias("lone"), "doc", "n", "shared"))
        .alias("hub")).select("band", "bucket", "hub.doc", "hub.n", "hub.shared")
    star = rays.alias("x").join(hubs.alias("y"), ["band", "bucket"]).filter(
        (F.col("x.doc") != F.col("y.doc")) & possible("x", "y")
    ).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
    links = stored(few_files(confirmed(star, texts, percent), n, 2000))
    first = components(links)

    # what the stars leave open: documents with few lone shingles against other components
    placed = stored(few_files(mine.join(first, "doc", "left").withColumn(
        "component", F.coalesce("component", "doc")), n, 2000))
    at_bucket = [F.col("at.band").alias("band"), F.col("at.bucket").alias("bucket")]
    mixed_up = placed.select("component", F.explode("names").alias("at")).select(
        "component", *at_bucket).groupBy("band", "bucket").agg(
        F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter(
        "_lo <> _hi").select("band", "bucket")
    spread = placed.select("doc", F.explode("names").alias("at")).select("doc", *at_bucket).join(
        mixed_up, ["band", "bucket"]).groupBy("doc").agg(
        F.collect_set(F.struct("band", "bucket")).alias("open"))
    bits = one_bit_signatures(texts.join(spread.select("doc"), "doc"))
    spread = stored(few_files(placed.join(spread, "doc").join(bits, "doc").select(
        "doc", "n", "shared", "component", "open", "bits"), n, 2000))
    spread = spread.select("*", F.explode("open").alias("at")).select(
        "doc", "n", "shared", "component", "open", "bits", *at_bucket)
    few = spread.filter((100 + percent) * F.col("shared") >= 2 * percent * F.col("n"))
    is_few = (100 + percent) * F.col("y.shared") >= 2 * percent * F.col("y.n")
    agree = sum((F.bit_count(F.bitwise_not(F.get("x.bits", F.lit(i)).bitwiseXOR(
        F.get("y.bits", F.lit(i))))) for i in range(BITS // 64)), F.lit(0))
    once = F.array_min(F.array_intersect("x.open", "y.open"))
    rest = few.alias("x").join(spread.alias("y"), (
        (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.doc") < F.col("y.doc")) | ~is_few) & possible("x", "y")
        & (agree >= _near_bits(percent))
        & (once == F.struct(F.col("x.band").alias("band"), F.col("x.bucket").alias("bucket"))))
    ).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
    more = stored(few_files(confirmed(rest, texts, percent), n, 2000))

    found = components(links.unionByName(more))
    named = classes.select("doc", "doc_id", "set_a", "set_b").join(found, "doc", "left").withColumn(
        "component", F.coalesce("component", "doc"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("_component"))
    named = named.join(least, "component").select("set_a", "set_b", "_component")
    out = sketch.join(named, ["set_a", "set_b"], "left")
    of_class = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component"))
    component = F.coalesce(of_class, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
