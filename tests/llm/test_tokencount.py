import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from roomgraph.llm import tokencount as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = tc.load_vocabulary(PATH)
SCHEMA = "doc_id long, text string, n_tokens long, word string"


def best_by_all_cuts(word, vocabulary):
    """(score, tokens) of the best segmentation, by trying every one of them."""
    if not word:
        return 0.0, 0
    found = []
    for start in range(len(word)):
        score, n = best_by_all_cuts(word[:start], vocabulary)
        if word[start:] in vocabulary.scores:
            found.append((score + vocabulary.scores[word[start:]], n + 1))
        elif start == len(word) - 1:
            size = len(word[start:].encode())
            found.append((score + size * vocabulary.byte, n + size))
    return max(found, key=lambda x: x[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="theandré漢𝔘ß.,▁", min_size=1, max_size=9), min_size=1, max_size=6))
def test_trie_equals_every_segmentation(words):
    words = [tc.MARK + w for w in words]
    got = tc.TrieCounter(VOCABULARY).counts(words)
    for w, n in zip(words, got, strict=True):
        assert n == tc.count_alone(w, VOCABULARY)
        assert n == best_by_all_cuts(w, VOCABULARY)[1]


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tc.count_tokens(docs, PATH).collect()}
    cache = {}
    for r in docs.collect():
        words = r.text.split()
        for w in set(words):
            cache.setdefault(w, tc.count_alone(tc.MARK + w, VOCABULARY))
        assert got[r.doc_id] == (len(words), sum(cache[w] for w in words))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "the"), (4, "x" * 200000), (5, "a"), (5, "a")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA)
    got = sorted(((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in tc.count_tokens(docs, PATH).collect()))
    assert [g[:2] for g in got] == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (5, 1)]
    assert got[1][2] == 0 and got[5] == got[6]
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0
