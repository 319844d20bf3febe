"""The queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgraph.llm import (
    chat, fingerprint, langid, mixing, neardup, negatives, neighbours, packing, substring, tokencount,
    vectorcodes, vectordedup, warc,
)
from roomgraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


PLANTED_TURN = r"\### Assistant: </turn> ok"


@query("op9_chat_formatting", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED_TURN}'
  UNION ALL SELECT -7, 1, 'assistant', '{PLANTED_TURN}'),
e AS (
  SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 END
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 AS n,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS was
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and((was, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND last(role ORDER BY turn NULLS FIRST, role, text) <> 'system' AS valid
FROM e GROUP BY conv_id
""")
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(
        [(-7, 0, "user", PLANTED_TURN), (-7, 1, "assistant", PLANTED_TURN)],
        "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chat(turns.unionByName(planted))).drop("error")


@query("op10_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to
FROM d
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, 4096, 2).drop("ids")


#: Sources by domain and weights of the mixture that op1 makes.
MIX_DOMAIN = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'web' WHEN source IN ('src8', 'src9', 'src10', 'src11', 'src12', 'src13') THEN 'books' ELSE 'news' END"
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "news": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}
MIX_SHARE, MIX_SEED, MIX_EPOCHS = 0.6, 11, 4


@query("op1_mixing", f"""
WITH d AS (
  SELECT doc_id, {MIX_DOMAIN} AS domain, coalesce(lang, '') AS l, coalesce(source, '') AS s, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
leaf AS (SELECT domain, l, s, CAST(sum(n) AS BIGINT) AS avail, CAST(sum(n) AS BIGINT) * {MIX_EPOCHS} AS cap FROM d GROUP BY ALL),
b0 AS (SELECT CAST(floor(least(floor(sum(avail) * CAST({MIX_SHARE} AS DOUBLE)), sum(cap))) AS BIGINT) AS b FROM leaf),
n1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'news' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY 1),
l1 AS (SELECT *, CAST(b - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM n1, b0),
b1 AS (SELECT domain, CASE WHEN cap <= w * lev THEN cap ELSE CAST(floor(w * max(CASE WHEN cap > w * lev THEN lev END) OVER ()) AS BIGINT) END AS b FROM l1),
n2 AS (SELECT domain, l, CAST(sum(cap) AS BIGINT) AS cap, CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY 1, 2),
l2 AS (SELECT *, CAST(b - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY CAST(cap AS DOUBLE) / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (PARTITION BY domain ORDER BY CAST(cap AS DOUBLE) / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM n2 JOIN b1 USING (domain)),
b2 AS (SELECT domain, l, CASE WHEN cap <= w * lev THEN cap ELSE CAST(floor(w * max(CASE WHEN cap > w * lev THEN lev END) OVER (PARTITION BY domain)) AS BIGINT) END AS b FROM l2),
l3 AS (SELECT domain, l, s, avail, cap, CAST(b - coalesce(sum(cap) OVER (PARTITION BY domain, l ORDER BY CAST(cap AS DOUBLE), s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(count(*) OVER (PARTITION BY domain, l ORDER BY CAST(cap AS DOUBLE), s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM leaf JOIN b2 USING (domain, l)),
b3 AS (SELECT domain, l, s, avail, CASE WHEN cap <= lev THEN cap ELSE CAST(floor(max(CASE WHEN cap > lev THEN lev END) OVER (PARTITION BY domain, l)) AS BIGINT) END AS b FROM l3),
t AS (SELECT d.*, b // avail AS whole, b % avail AS rest FROM d JOIN b3 USING (domain, l, s) WHERE b > 0),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, l, s ORDER BY md5('{MIX_SEED}/' || whole || '/' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)
SELECT doc_id, lang, source, domain, CAST(e AS BIGINT) AS epoch, CAST(n AS BIGINT) AS n_tokens, CAST(n AS BIGINT) AS take_tokens FROM t, range(0, whole) AS r(e)
UNION ALL SELECT doc_id, lang, source, domain, whole, n, CAST(least(n, rest - start) AS BIGINT) FROM p WHERE start < rest
""")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    total = F.floor(F.sum("_mix_tokens") * F.lit(MIX_SHARE))
    return mixing.mix(docs, F.expr(MIX_DOMAIN), MIX_WEIGHTS, total, MIX_SEED, MIX_EPOCHS).drop("text")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter("not held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_next(table(spark, sf_dir, "documents"))


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 85, bands=25, rows=5)


@query("op8_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
named AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS s FROM win),
again AS (SELECT doc_id, i FROM named QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM again),
each_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
left_over AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM each_word e ANTI JOIN gone g USING (doc_id, j) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over o ON w.doc_id = o.doc_id
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), 20).drop("text")


@query("op7_neighbours")
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def _sound(column: str = "embedding") -> str:
    return f"{column} IS NOT NULL AND len({column}) > 0 AND len(list_filter({column}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_near_vectors", f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND {_sound()} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.a, r.c FROM reach r JOIN l ON l.b = r.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT a AS vec_id, min(c) AS component_id FROM reach GROUP BY 1) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id)
""")
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def _lloyd(rounds: int) -> str:
    """The plain rounds: assign every part, then move every entry."""
    far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, p.part, min(CAST({far} AS BIGINT) * 256 + c.entry) AS best FROM p JOIN c{i} c ON p.part = c.part GROUP BY r, p.part)""")
        if i < rounds:
            steps.append(f"""
g{i} AS (SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM (
  SELECT a.part, a.best % 256 AS entry, unnest(p.x) AS x, unnest(range(len(p.x))) AS place FROM a{i} a JOIN p ON a.r = p.r AND a.part = p.part) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY place) AS x FROM (SELECT part, entry, place, CAST(s AS BIGINT) AS s, n FROM g{i}) GROUP BY ALL) m
  ON c.part = m.part AND c.entry = m.entry)""")
    return ",".join(steps)


@query("op12_vector_codes", f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_sound()}),
p AS MATERIALIZED (SELECT r, vec_id, j AS part, v[j * len(v) // 8 + 1:(j + 1) * len(v) // 8] AS x FROM k, range(8) AS q(j)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16),{_lloyd(6)},
done AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c6) AS codebooks_sha256
FROM k JOIN done USING (r)
""")
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf_dir, "embeddings"), 8, 16, 6, 4096).drop("label")


@query("op13_hard_negatives", f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND {_sound()}),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = table(spark, sf_dir, "embeddings").withColumn("label", F.expr(
        "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return negatives.mine(moved, F.col("id") % 100 == 0, 5, 5, 80, 256)
