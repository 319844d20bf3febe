import random

import numpy as np
import pytest

from roomgraph.llm import neardup, shingles

SCHEMA = "doc_id long, text string, n_shingles long, component_id string, band int"


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    sets = [(k, shingle_set(t)) for k, t in rows]
    up = {k: k for k, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (k, s) in enumerate(sets):
        for m, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = sorted((find(k), find(m)))
                up[b] = a
    return {k: (len(s), find(k)) for k, s in sets}


def family(rng, words, ids, size, length, edits):
    base = [rng.choice(words) for _ in range(length)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(length)] = rng.choice(words)
        out.append((next(ids), " ".join(text)))
    return out


@pytest.mark.parametrize(("percent", "bands"), [(85, 25), (80, 40)])
def test_components_equal_brute_force(spark, percent, bands):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    order = list(range(1000))
    rng.shuffle(order)
    ids = iter(order)
    rows = []
    for size, length, edits in ((40, 60, 3), (60, 300, 9), (50, 120, 6), (30, 12, 2), (40, 500, 20), (60, 9, 2), (5, 3, 2), (80, 200, 7)):
        rows += family(rng, words, ids, size, length, edits)
    rows += [(next(ids), "same text Here"), (next(ids), "SAME\ttext\x0bhere "), (next(ids), ""), (next(ids), None), (next(ids), " \n"), (next(ids), "É É É É É é")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = neardup.near_duplicates(docs, percent, bands, 5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (4, "x " * 300000), (5, "x x x x x"), (0, "")]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), 85, 25, 5).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted([
        ("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("None", 2, "None", True), ("None", 0, "None", True),
        ("4", 1, "4", True), ("5", 1, "4", False), ("0", 0, "0", True)])
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_are_hashed_like_words():
    texts = ["a bb  a\tbb", "", " x", "bb", "a" * 3000 + " é", "ABC abc"]
    seen = {}
    for at, end, words, starts in shingles.hashed_words([t.encode() for t in texts] * 400, lower=False):
        for k in range(end - at):
            mine = [w for w in texts[(at + k) % 6].replace("\t", " ").split(" ") if w]
            got = words[starts[k]:starts[k + 1]].tolist()
            assert len(got) == len(mine)
            for w, h in zip(mine, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(np.unique(shingles.runs(np.arange(9).astype(np.uint64), 5))) == 5


def test_signature_bits_estimate_similarity(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts, base = [], [rng.choice(words) for _ in range(400)]
    for edits in (0, 5, 10, 20, 40, 80, 200):
        t = list(base)
        for _ in range(edits):
            t[rng.randrange(400)] = rng.choice(words)
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate([*texts, "one", "one", "two"])), "doc long, text string")
    bits = {r.doc: np.array(r.bits).view(np.uint8) for r in neardup.one_bit_signatures(docs).collect()}
    share = lambda a, b: 1 - np.unpackbits(bits[a] ^ bits[b]).mean()
    for i, t in enumerate(texts):
        a, b = shingle_set(texts[0]), shingle_set(t)
        assert abs(2 * share(0, i) - 1 - len(a & b) / len(a | b)) < 0.1
    assert share(7, 8) == 1 and abs(share(7, 9) - 0.5) < 0.1


def test_each_text_of_a_repeated_id_is_linked(spark):
    one = " ".join(f"a{i}" for i in range(80))
    two = " ".join(f"b{i}" for i in range(80))
    rows = [(5, one), (5, two), (9, two), (12, two + " more"), (3, one + " more"), (7, "other words")]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), 85, 25, 5).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [
        (3, 77, 3), (5, 76, 3), (5, 76, 5), (7, 1, 7), (9, 76, 5), (12, 77, 5)]


def test_unsettled_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        neardup.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
