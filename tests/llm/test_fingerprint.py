import hashlib
import random

from roomgraph.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, n_chars long, _key string, _words string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((key, text, text[:len(text) - half] + after[:half], after))
    return out


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 5, "k", "w") for r in rows], SCHEMA)
    got = fp.against_next(docs, **kw).collect()
    want = expected(rows)
    left = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got)
    assert left == sorted((str(k), len(t), hashlib.sha256(e.encode()).hexdigest()) for k, t, e, _ in want)
    return got, want


def test_edges(spark):
    rows = [(5, "a b c d e f g"), (4, None), (3, ""), (9, "x"), (7, "Été ß 漢字 𝔘 end " * 9000), (2, "a b c d e f g"),
            (2, "other text here"), (2, "other text here"), (None, "no id at all"), (None, None), (-3, "odd")]
    for bucket_rows in (2, 3, 2000):
        got, _ = check(spark, rows, bucket_rows=bucket_rows)
        by = {}
        for r in got:
            by.setdefault((r.n_chars, r.doc_id), r)
        assert by[(13, 5)].fingerprint == by[(13, 2)].fingerprint
        assert by[(0, 3)].fingerprint == "" and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    check(spark, rows[:1])
    assert fp.against_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_are_near_the_sets(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, text = [], [rng.choice(words) for _ in range(300)]
    for i in range(120):
        text = list(text)
        for _ in range(rng.randrange(0, 12)):
            text[rng.randrange(len(text))] = rng.choice(words)
        if i % 20 == 19:
            text = [rng.choice(words) for _ in range(rng.randrange(5, 600))]
        rows.append((i, " ".join(text)))
    got, want = check(spark, rows, bucket_rows=25)
    true = {k: (jaccard(t, e), jaccard(t, n)) for k, t, e, n in want}
    errors = [abs(r.near_edited - true[r.doc_id][0]) for r in got] + [abs(r.near_next - true[r.doc_id][1]) for r in got]
    assert sum(errors) / len(errors) < 0.035 and max(errors) < 0.2
    bias = sum(r.near_next - true[r.doc_id][1] for r in got) / len(got)
    assert abs(bias) < 0.02


def test_short_texts_are_densified_without_bias(spark):
    rows = []
    for i in range(200):  # 8 of 10 words in common at the front: 4 of 8 shingles, 6 in each set
        common = " ".join(f"c{i}_{k}" for k in range(8))
        rows += [(2 * i, f"{common} x{i} y{i}"), (2 * i + 1, f"{common} z{i} u{i}")]
    docs = spark.createDataFrame([(*r, 5, "k", "w") for r in rows], SCHEMA)
    sketches = {r.doc_id: r.s for r in fp.fingerprints(docs, "text", "s").select("doc_id", "s").collect()}
    share = [sum(a == b for a, b in zip(sketches[2 * i], sketches[2 * i + 1], strict=True)) / fp.BINS for i in range(200)]
    mean = sum((s - fp.CHANCE) / (1 - fp.CHANCE) for s in share) / 200
    assert abs(mean - 4 / 8) < 0.04
