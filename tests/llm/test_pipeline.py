import random
import string

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from roomgraph.llm.common import stored
from tests.llm.test_neardup import brute as groups
from tests.llm.test_substring import brute as spans

SF = "/root/testdata/sf0.001"
NUMBERS = [4, 3, 8, 1, 5]


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in cp.STAGES:
        steps.append(stored(stage(spark, steps[-1], SF)))
    for step in steps[:-1]:
        assert step.columns == cp.COLUMNS
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:4]]
    # language: what stays is unchanged, what goes has no sure language
    assert all(rows[0][k] == r for k, r in rows[1].items()) and len(rows[1]) > 0.9 * len(rows[0])
    # near-duplicates: exactly the smallest id of each group
    found = groups([(k, r.text) for k, r in rows[1].items()], 80)
    assert set(rows[2]) == {k for k, (_, c) in found.items() if k == c}
    # spans: the counts of the brute-force version
    cut = spans([(k, r.text) for k, r in rows[2].items()], 20)
    for k, r in rows[3].items():
        assert len(r.text.encode().split()) == cut[k][0] - cut[k][1]
        assert r.n_chars == (len(r.text) if cut[k][1] else rows[2][k].n_chars)
    # mixture: nothing new, nothing above three times, and at most one text of a leaf is cut to its
    # first words
    mixed = steps[4].collect()
    cut_rows = [r for r in mixed if rows[3][r.doc_id] != r]
    for r in cut_rows:
        was = rows[3][r.doc_id]
        words = r.text.split(" ")
        assert was.text.encode().split()[:len(words)] == [w.encode() for w in words] and r.n_chars == len(r.text)
    assert 0 < len(cut_rows) == len({(r.lang, r.source) for r in cut_rows})
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    # packing: every token of every row once
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    pieces = steps[5].collect()
    assert sum(p.length for p in pieces) == tokens and max(p.sequence_tokens for p in pieces) <= 4096


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def told(spark, stage, rows):
    docs = stored(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(map(tuple, dict(cp.STAGES)[stage](spark, docs, SF).collect()), key=str)


def test_language_rejects_noise_and_keeps_clean_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS).collect()
    rng = random.Random(3)
    noise = [(10**6 + i, " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(200)),
              None, "src1", 1) for i in range(10)]
    odd = [(10**7 + 1, None, "en", "src1", 0), (10**7 + 2, "", "en", "src1", 0), (10**7 + 3, "123 456 !!", "en", "src1", 0)]
    again = [tuple(docs[0]), (None, docs[1].text, None, None, None)]
    kept = told(spark, "language_id", [*map(tuple, docs), *noise, *odd, *again])
    assert not [r for r in kept if r[0] is not None and r[0] >= 10**6]
    assert kept.count(tuple(docs[0])) == 2 and again[1] in kept
    assert len(kept) >= 0.99 * len(docs)


def test_near_duplicates_keep_one_of_each_group_with_and_without_ids(spark):
    a, b, c = ("the cat sat on the mat and the dog ran off", "a quite different text about ships and the wide sea",
               "one more text that nobody else has ever written")
    rows = [(7, a, "en", "s", 1), (5, a, "en", "s", 1), (None, a, None, None, None), (None, b, None, None, None), (None, b, None, None, None),
            (3, c, "en", "s", 1), (3, c, "en", "s", 1), (4, None, "en", "s", 0), (4, None, "en", "s", 0), (None, "", None, None, None), (9, " ", "en", "s", 1)]
    assert told(spark, "near_dedup", rows) == sorted(
        [rows[1], rows[3], rows[5], *rows[7:]], key=str)
    # two texts under one id, of which one has a copy with an id of its own
    rows = [(3, a, "en", "s", 1), (3, b, "en", "s", 1), (8, b, "en", "s", 1)]
    assert told(spark, "near_dedup", rows) == sorted([rows[0], rows[2]], key=str)
    assert told(spark, "near_dedup", []) == []


def test_mixture_cuts_where_the_budget_ends(spark):
    rows = [(i, f" w{i}\tx  y z{i} ", "en", s, 9) for s, n in (("src1", 41), ("src9", 30), ("src20", 30)) for i in range(n)]
    got = told(spark, "mixing", rows)
    cut = [r for r in got if not r[1].startswith(" ")]
    tokens = sum(len(r[1].split()) for r in got)
    assert 400 <= tokens <= 404 and len(cut) == 2
    for r in cut:
        assert f"w{r[0]} x y z{r[0]}".startswith(r[1]) and r[4] == len(r[1])


def test_odd_rows_go_through_all_stages(spark):
    long = "the cat " * 50000
    rows = [(1, "the cat sat on the mat and the dog", "en", "src1", 1), (None, "the dog and the cat", None, None, None), (2, None, "en", None, 0),
            (3, "", None, "src2", 0), (1, "the cat sat on the mat and the dog", "en", "src1", 1), (4, long, "en", "src9", 5)]
    docs = stored(spark.createDataFrame(rows, SCHEMA))
    seen = []
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF))
        seen.append(docs.collect())
    assert [r.doc_id for r in sorted(seen[0], key=str)] == [1, 1, 4, None]  # one language learnt
    assert sorted((r.doc_id for r in seen[1]), key=str) == [1, 4, None]
    assert {r.doc_id: len(r.text.split()) for r in seen[2]} == {1: 9, 4: 2, None: 5}
    assert sum(r.length for r in seen[4]) > 0 and {r.doc_id for r in seen[4]} <= {1, 4, None}
    docs = stored(spark.createDataFrame([], SCHEMA))
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 0
