import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roomgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length long, offset string"


def test_differencing_is_near_equal_and_whole():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 17, 60):
        sizes = rng.integers(1, 4096, 200)
        window = packing.difference(sizes, k)
        loads = np.bincount(window, sizes, minlength=k)
        assert len(loads) == k and loads.sum() == sizes.sum()
        assert loads.max() - loads.min() <= sizes.max()
    # the textbook case: 8-7 and 6-5 are set apart first, which ends in {8, 6} and {7, 5, 4}
    window = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert [window[0] == w for w in window] == [True, False, True, False, False]


def test_window_count_rises_until_all_fit():
    window = packing.pack_block(np.array([3, 3, 3]), 4)
    assert sorted(window.tolist()) == [0, 1, 2]
    assert packing.pack_block(np.zeros(0, int), 4).tolist() == []


@pytest.mark.parametrize("block", [4, 4096])
def test_pieces_cover_every_id_once(spark, block):
    words = "the hand of Straße l'été don't x's <|endoftext|> 12345 ÀÉ\u0301 \x1c\u00a0\u2003end".split(" ")
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words, int(n))), 1, "x") for i, n in enumerate(rng.integers(0, 300, 60))]
    rows += [(900, "long\n" * 9000, 1, "x"), (901, None, 1, "x"), (None, "a b", 1, "x"), (3, "again", None, None), (3, "again", None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, 512, 2, True, block).collect()
    whole = Tokenizer.from_file(PATH)
    want = sorted(((k if k is not None else -1), tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for k, t, *_ in rows)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
    spans = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == spans.get(r.sequence_id, 0)
        spans[r.sequence_id] = r.offset + r.length
    assert max(spans.values()) <= 512
    assert all(r.sequence_tokens == spans[r.sequence_id] for r in got)
    single = [(k, ids) for k, ids in want if k not in (3,)]
    by = {}
    for r in sorted(got, key=lambda r: r.start):
        if r.doc_id != 3:
            by.setdefault(-1 if r.doc_id is None else r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert sorted((k, tuple(v)) for k, v in by.items()) == single
    assert sum(r.length for r in got if r.doc_id == 3) == sum(len(i) for k, i in want if k == 3)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_padding_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, PATH).select("sequence_id", "sequence_tokens").distinct().collect()
    used = sum(r.sequence_tokens for r in got)
    assert used / (4096 * len(got)) > 0.97
