"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL functions.

A text's five-word shingles (lower-cased words between white space; a shorter text is one shingle)
are hashed once. The top bits of a hash name one of ``BINS`` bins, and a bin keeps its smallest
hash. A bin without a hash takes that of a donor: the non-empty bin whose hash together with the
bin's number is smallest, so that every empty bin draws its donor independently and uniformly, and
equal sets draw alike. Of each bin's hash the low byte is stored; ``likeness`` corrects the share
of equal bytes for those that agree by chance.

Only DataFrame expressions are used. Null texts are empty; a text without words has the empty
fingerprint, whose likeness is 1 to itself and 0 to any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.llm.common import text_of

BINS = 128
_BIN_BITS = 7
_SHIFT = 64 - _BIN_BITS
_LOW = (1 << _SHIFT) - 1
#: Chance that two stored bytes agree though the hashes don't.
CHANCE = 1 / 256
SHINGLE = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")


def shingle_hashes(words: str) -> Column:
    """Hash of every shingle of the array column ``words`` (a column's name, read many times)."""
    size = F.size(words)
    many = F.transform(
        F.sequence(F.lit(0), size - SHINGLE),
        lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE)]))
    return (F.when(size == 0, F.array().cast("array<bigint>"))
            .when(size < SHINGLE, F.array(F.xxhash64(F.concat_ws(" ", words))))
            .otherwise(many))


def with_sketch(df: DataFrame, words: str, name: str) -> DataFrame:
    """Add ``name``: the low bytes of the bins, an empty array for a text without words.

    Each step is a column of its own, as the next one reads it at many places.
    """
    s, m, e = f"_{name}_sorted", f"_{name}_least", f"_{name}_empty"

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, _SHIFT)

    df = df.withColumn(s, F.sort_array(shingle_hashes(words)))
    df = df.withColumn(m, F.filter(
        s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col(s), i - 1)))))
    every = F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1))
    df = df.withColumn(e, F.array_except(every, F.transform(m, lambda h: bin_of(h).cast("int"))))

    def donor(b: Column) -> Column:
        draw = F.array_min(F.transform(m, lambda h, i: F.xxhash64(b, bin_of(h)).bitwiseAND(
            F.lit(~0xFF)).bitwiseOR(i.cast("bigint"))))
        return F.get(F.col(m), draw.bitwiseAND(F.lit(0xFF)).cast("int"))

    filled = F.sort_array(F.concat(m, F.transform(
        e, lambda b: F.shiftleft(b.cast("bigint"), _SHIFT).bitwiseOR(
            donor(b).bitwiseAND(F.lit(_LOW))))))
    low = F.transform(filled, lambda h: h.bitwiseAND(F.lit(0xFF)).cast("int"))
    return df.withColumn(name, F.when(F.size(m) == 0, F.array().cast("array<int>")).otherwise(low)
                         ).drop(s, m, e)


def packed(sketch: Column) -> Column:
    """The stored fingerprint: two hexadecimal digits a bin."""
    return F.array_join(F.transform(sketch, lambda v: F.lpad(F.hex(v), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0),
                       lambda n, v: n + F.coalesce(v, F.lit(0)))
    share = (same / F.lit(BINS) - F.lit(CHANCE)) / F.lit(1 - CHANCE)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "sketch") -> DataFrame:
    """``docs`` with the column ``name`` (bytes of the bins) of each whole text."""
    return with_sketch(docs.withColumn("_words", words_of(text_of(text))), "_words", name
                       ).drop("_words")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie at or below ``key``, by halving."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(held, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def against_next(docs: DataFrame, bucket_rows: int = 2000, most_buckets: int = 20_000
                 ) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of their edited texts, and likenesses.

    The next document is that with the next smaller doc_id (after the last one the first); rows
    with one doc_id are ordered by their text, rows without come last. The edited text is the
    first half of a text with as many leading code points of the next one (or all) behind it.

    Documents are dealt into buckets of neighbouring ids, whose bounds are percentiles of all ids
    and at most ``most_buckets``; each bucket also gets a copy of the next one's first document.
    So no order over the whole table is needed, and the text is shuffled once.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")
    ).withColumn("_key", F.coalesce("doc_id", F.lit(low)))
    n = rows.count()
    buckets = max(1, min(most_buckets, n // bucket_rows))
    cuts = [k / buckets for k in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("_key", cuts, 10 * buckets)).head()[0] if cuts else []
    rows = rows.withColumn("_bucket", _place(F.col("_key"), sorted(set(bounds or []))))
    firsts = sorted(((r[0], r[1]) for r in
                     rows.groupBy("_bucket").agg(F.max("_key")).collect()), reverse=True)
    follows = [(firsts[(k + 1) % len(firsts)][1], b) for k, (b, _) in enumerate(firsts)]
    edges = spark.createDataFrame(follows, "_key long, _also int")
    rows = rows.join(F.broadcast(edges), "_key", "left").withColumn("_at", F.explode(F.when(
        F.col("_also").isNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("c")))
    ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("c")),
                        F.struct(F.col("_also").alias("b"), F.lit(True).alias("c"))))))
    rows = rows.select("doc_id", "_key", "text", F.col("_at.b").alias("_bucket"),
                       F.col("_at.c").alias("_copy"), F.sha2("text", 256).alias("_tie"),
                       F.length("text").alias("n_chars"))
    order = Window.partitionBy("_bucket").orderBy("_copy", F.desc("_key"), "_tie")
    rows = rows.withColumn("_next", F.lead("text").over(order))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("_edited", F.when(~F.col("_copy"), F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - half),
        F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))))
    rows = rows.select(
        "doc_id", "_key", "_bucket", "_copy", "_tie", F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"), words_of(F.col("text")).alias("_words"),
        words_of(F.coalesce("_edited", F.lit(""))).alias("_edited_words"))
    rows = with_sketch(with_sketch(rows, "_words", "_own").drop("_words"), "_edited_words", "_cut"
                       ).drop("_edited_words")
    rows = rows.withColumn("_next_own", F.lead("_own").over(order)).filter(~F.col("_copy"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("_own")).alias("fingerprint"),
        packed(F.col("_cut")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_cut")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next_own")).alias("near_next"))
