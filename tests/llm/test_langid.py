import numpy as np

from roomgraph.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, held_out boolean, n long"


def small_model(langs=3, hidden=4, seed=0):
    rng = np.random.default_rng(seed)
    p = {"w": rng.normal(0, 0.5, (2 * hidden, langs)), "c": rng.normal(0, 0.5, langs)}
    for side in "fb":
        p["x" + side] = rng.normal(0, 0.5, (256, 3 * hidden))
        p["u" + side] = rng.normal(0, 0.5, (hidden, 2 * hidden))
        p["n" + side] = rng.normal(0, 0.5, (hidden, hidden))
    return p


def test_gradients_equal_differences():
    p = small_model()
    x, sizes, owner = langid.encode(["the", "été", "x", "zwölfter"])
    x, label = x[:, :sizes.max()], np.array([0, 1, 2, 1])
    _, grads = langid.loss_and_gradients(x, sizes, label, p)
    for k, g in grads.items():
        flat = np.argsort(-np.abs(g), axis=None)[:6]
        for i in flat:
            at = np.unravel_index(i, g.shape)
            was, e = p[k][at], 1e-2
            p[k][at] = was + e
            up, _ = langid.loss_and_gradients(x, sizes, label, p)
            p[k][at] = was - e
            down, _ = langid.loss_and_gradients(x, sizes, label, p)
            p[k][at] = was
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3 + 0.03 * abs(g[at]), (k, at)


def test_words_are_labelled_as_one_by_one():
    model = langid.Model(["a", "b", "c"], small_model())
    words = ["the", "y" * 50, "été", "the"]
    got = langid.label_words(words, model)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, langid.label_words([w], model)[0], atol=1e-4)
        assert row[-1] == len(w.encode()) and abs(row[:-1].sum() - row[-1]) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter("not held_out"), docs_per_lang=100, steps=200)
    got = langid.predict(docs, model, ["doc_id", "held_out"]).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "el gato y los perros", "es"), (3, None, "en"), (4, "12 !?", None),
            (None, "los gatos", "es"), (5, "", None), (6, "perros " * 50000, None), (7, "x" * 100000, "en"), (7, "x", "en")]
    docs = spark.createDataFrame([(*r, 1.0, False, 3) for r in rows], SCHEMA)
    model = langid.train(docs, steps=60)
    assert model.langs == ["en", "es"]
    got = langid.predict(docs, model, ["doc_id", "held_out"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[3] == by[4] == by[5] == "und" and by[6] == "es"
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, []).count() == 0
