import hashlib

from pyspark.sql import functions as F

from roomgraph.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, epoch string, _mix_n int"
WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}, "source": {"s0": 5, "zero": 0}}


def pour(nodes, budget):
    """Whole-token water filling of {name: (capacity, weight)}."""
    nodes = {k: v for k, v in nodes.items() if v[1] > 0}
    given, open_ = {}, dict(nodes)
    while open_:
        level = (budget - sum(given.values())) / sum(w for _, w in open_.values())
        full = {k for k, (c, w) in open_.items() if c <= w * level}
        if not full:
            return given | {k: int(w * level) for k, (_, w) in open_.items()}
        k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
        given[k] = open_.pop(k)[0]
    return given


def test_budgets_and_prefixes(spark):
    rows, i = [], 0
    for dom, lang, src, n in (("a", "en", "s0", 40), ("a", "en", "s1", 3), ("a", "de", "s0", 5), ("b", None, "s2", 30), ("b", "en", "zero", 9), (None, "fr", None, 2)):
        for k in range(n):
            rows.append((i, ("w " * (k % 7)).strip() or None, lang, src, dom, 1))
            i += 1
    rows += [(1, "w w w", "en", "s0", "a", 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, F.col("epoch"), WEIGHTS, F.floor(F.sum("_mix_tokens") * 0.8), seed=3, most_epochs=2, bucket_rows=4).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault((r[4] or "", r[2] or "", r[3] or ""), []).append((r[0], len((r[1] or "").split())))
    cap = {k: 2 * sum(n for _, n in v) for k, v in leaves.items()}
    total = min(int(sum(cap.values()) / 2 * 0.8), sum(cap.values()))
    level = pour({d: (sum(c for k, c in cap.items() if k[0] == d), WEIGHTS["domain"].get(d, 1)) for d in {k[0] for k in cap}}, total)
    want = {}
    for d, b in level.items():
        langs = pour({x: (sum(c for k, c in cap.items() if k[:2] == (d, x)), WEIGHTS["lang"].get(x, 1)) for x in {k[1] for k in cap if k[0] == d}}, b)
        for x, bb in langs.items():
            for s, bbb in pour({k[2]: (c, WEIGHTS["source"].get(k[2], 1)) for k, c in cap.items() if k[:2] == (d, x)}, bb).items():
                want[d, x, s] = bbb
    out = []
    for leaf, budget in want.items():
        if budget:
            have = sum(n for _, n in leaves[leaf])
            for e in range(budget // have):
                out += [(leaf[0], e, k, n, n) for k, n in leaves[leaf]]
            e, rest, at = budget // have, budget % have, 0
            for k, n in sorted(leaves[leaf], key=lambda r: (hashlib.md5(f"3/{e}/{r[0]}".encode()).hexdigest(), r[1])):
                if at < rest:
                    out.append((leaf[0], e, k, n, min(n, rest - at)))
                at += n
    assert sorted((r.domain, r.epoch, r.doc_id, r.n_tokens, r.take_tokens) for r in got) == sorted(out)
    assert mixing.mix(docs.limit(0), F.lit("x"), WEIGHTS, F.sum("_mix_tokens")).count() == 0
