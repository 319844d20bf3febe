"""A corpus pipeline: language, near-duplicates, repeated spans, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgraph.llm import langid, mixing, neardup, packing, substring
from roomgraph.llm.common import stored, table
from roomgraph.llm.queries import MIX_DOMAIN, MIX_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: How far the share of the found language has to be from chance (1 / languages) towards certainty.
LEAST_LEAD = 0.25
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages. Texts that are null, empty or without letters go, and
    those whose largest share of positions is nearer to chance than ``LEAST_LEAD`` says, such as random
    letters; an unlearnt language that the network takes for a learnt one stays. Repeated rows, and rows without id,
    language or source, are judged by their text like any other; with nothing learnt, all go."""
    model = langid.train(docs.filter(~langid.held_out()))
    chance = 1 / max(1, len(model.langs))
    told = langid.predict(docs, model, COLUMNS)
    return told.filter((F.col("lang_pred") != "und") & (
        F.col("score") >= chance + LEAST_LEAD * (1 - chance))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more: that with the smallest id. Rows that
    share an id, or have none, are documents of their own, which come after all others in that order, so
    of repeated rows one stays. Texts that are null or without words are in no group and stay."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    several = stored(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and doc_id is not null"
                                               ).select("doc_id", F.lit(True).alias("_several")))
    last = ids.agg(F.max("doc_id")).head()[0] or 0
    own = F.col("doc_id").isNotNull() & F.col("_several").isNull()
    # docs is a stored table: its rows get the same numbers each time it is read
    numbered = docs.select(*COLUMNS).withColumn("_place", F.monotonically_increasing_id()).join(
        several, "doc_id", "left").withColumn("_doc", F.when(own, F.col("doc_id").cast("long")).otherwise(
            F.lit(max(0, last) + 1) + F.col("_place"))).select("_doc", *COLUMNS)
    told = neardup.near_duplicates(numbered.select(F.col("_doc").alias("doc_id"), "text"), 80, bands=40, rows=5)
    gone = told.filter("not kept").select(F.col("doc_id").alias("_doc"))
    return numbered.join(gone, "_doc", "left_anti").select(*COLUMNS)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that also start earlier in the corpus, ``n_chars``
    with them. A text that loses nothing, null ones included, stays as it is; one that loses all its
    words is empty; rows without id come last, repeated rows by their text."""
    cut = substring.remove_repeats(docs, 20, keep=["doc_id", "lang", "source", "n_chars"])
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                          .otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by the weights; scarce leaves repeat up to three times. The document
    at which a leaf's budget ends is cut to its first tokens, joined by one space. Documents without
    tokens, null texts included, go with the token they stand at; null sources and languages are a group
    each; rows that are equal in all columns count each."""
    total = F.sum("_mix_tokens")
    taken = mixing.mix(docs.select(*COLUMNS), F.expr(MIX_DOMAIN), MIX_WEIGHTS, total, seed=5, most_epochs=3)
    cut = F.col("take_tokens") < F.col("n_tokens")
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0)), F.lit(1), F.col("take_tokens").cast("int"))
    return taken.withColumn("text", F.when(cut, F.array_join(words, " ")).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens. Null texts are empty, each row is a
    document whatever its id, and an empty table gives no pieces."""
    return packing.pack_documents(docs, TOKENIZER, 4096, 2).drop("ids")


STAGES = [
    ("language_id", language), ("near_dedup", near_duplicates), ("substring_dedup", repeated_spans),
    ("mixing", mixture), ("packing", packed),
]

#: A trained network and a public tokenizer decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
