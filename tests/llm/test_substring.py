import hashlib
import random

import pytest

from roomgraph.llm import substring

SCHEMA = "doc_id long, text string, n_words long, lo int, version long"


def words_of(text):
    return (text or "").encode().split()


def brute(rows, window):
    """rows with distinct ids"""
    seen, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words_of(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i:i + window]), (key, i)) != (key, i):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[key] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 7])
def test_equals_brute_force(spark, window):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "the", "the", "a.", "A."]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 70))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
            if rng.random() < 0.4:
                cut = p.split(" ")
                p = " ".join(cut[rng.randrange(len(cut)):])
            parts.append(p)
        rows.append((3 * i - 40, "\n ".join(parts)))
    rows += [(1000, "x " * 100), (1001, "x " * 30), (1002, None), (1003, ""), (1004, " ".join(f"u{i}" for i in range(window))),
             (1005, "q " + " ".join(f"u{i}" for i in range(window)) + " r"), (None, passages[0]), (1006, "y z " * 60000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, window, 6 if window > 7 else 3).collect()}
    assert got == brute(rows, window)
    assert any(v[1] for v in got.values())


def test_texts_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(5, long + "\n\tend"), (5, long + "\n\tend"), (7, f"a {long} b"), (8, "left  as\tit was")]
    got = substring.remove_repeats(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got) == [
        (5, 0, long + "\n\tend"), (5, 0, long + "\n\tend"), (7, 30, "a b"), (8, 0, "left  as\tit was")]
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
