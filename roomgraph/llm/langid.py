"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word (a run without white space, lower-cased, in pieces of at
most ``SPAN`` bytes) in both directions and labels every byte position with a distribution over
the languages. It is trained in numpy by backpropagation through time on the words of a bounded
sample of labelled documents. A document's probabilities are the mean over all positions of all
its words that hold a letter; equal words are labelled once per task and weighed by their count.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the
language that sorts first; rows without id are predicted too but never learnt from; repeated rows
give repeated results; with no labelled row every text is ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomgraph.llm.common import small_batches, text_of

SPAN = 20
#: Words whose pooled labels a task remembers.
CACHE_WORDS = 200_000
PREDICTED = "lang_pred string, score double, n_positions long"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    params: dict[str, np.ndarray]


def training_words(docs: DataFrame, docs_per_lang: int = 300, words_per_lang: int = 6000
                   ) -> DataFrame:
    """(lang, word, n) of a bounded sample: per language the ``docs_per_lang`` labelled documents
    whose ids hash lowest, and the ``words_per_lang`` most frequent words of their whole texts."""
    picked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # ids are picked without their texts; there are docs_per_lang of them for each language at most
    ids = known.select("lang", "doc_id").withColumn("rn", F.row_number().over(picked)).filter(
        F.col("rn") <= docs_per_lang).select("lang", "doc_id").distinct()
    sample = known.select("lang", "doc_id", F.lower(text_of("text")).alias("text")).join(
        F.broadcast(ids), ["lang", "doc_id"])
    words = (
        sample.select("lang", F.explode(F.split("text", r"[ \t-\r]+")).alias("word"))
        .filter("word rlike '\\\\p{L}'").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("word"), "word")
    return (words.withColumn("rn", F.row_number().over(ranked))
            .filter(F.col("rn") <= words_per_lang).drop("rn"))


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte pieces of words: a padded byte matrix, the pieces' lengths and their words."""
    raw = [w.encode() for w in words]
    pieces = [(b[i:i + SPAN], k) for k, b in enumerate(raw) for i in range(0, len(b), SPAN)]
    sizes = np.array([len(p) for p, _ in pieces], np.int64)
    padded = b"".join(p.ljust(SPAN, b"\0") for p, _ in pieces)
    return (np.frombuffer(padded, np.uint8).reshape(-1, SPAN), sizes,
            np.array([k for _, k in pieces], np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(x: np.ndarray, mask: np.ndarray, p: dict, side: str, keep: list | None) -> np.ndarray:
    """Hidden states (steps, rows, hidden) of one direction; ``keep`` gets what the backward pass
    needs."""
    table, u, un = p["x" + side], p["u" + side], p["n" + side]
    hidden = un.shape[0]
    h = np.zeros((x.shape[0], hidden), np.float32)
    out = np.empty((x.shape[1], x.shape[0], hidden), np.float32)
    for t in range(x.shape[1]):
        g = table[x[:, t]]
        a = _sigmoid(g[:, :2 * hidden] + h @ u)
        z, r = a[:, :hidden], a[:, hidden:]
        n = np.tanh(g[:, 2 * hidden:] + (r * h) @ un)
        m = z * mask[:, t, None]
        if keep is not None:
            keep.append((h, z, r, n, m))
        h = h + m * (n - h)
        out[t] = h
    return out


def _back(x: np.ndarray, mask: np.ndarray, p: dict, side: str, keep: list, grad: np.ndarray,
          into: dict) -> None:
    """Backpropagation through time of one direction: ``grad`` is by hidden state and step."""
    u, un = p["u" + side], p["n" + side]
    hidden = un.shape[0]
    dx, du, dn = (np.zeros_like(p[k + side]) for k in "xun")
    dh = np.zeros_like(keep[0][0])
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, n, m = keep[t]
        dh = dh + grad[t]
        pre_n = dh * m * (1 - n * n)
        d_rh = pre_n @ un.T
        pre_z = dh * (n - h) * mask[:, t, None] * z * (1 - z)
        pre_r = d_rh * h * r * (1 - r)
        gates = np.concatenate([pre_z, pre_r], 1)
        du += h.T @ gates
        dn += (r * h).T @ pre_n
        np.add.at(dx, x[:, t], np.concatenate([gates, pre_n], 1))
        dh = dh * (1 - m) + d_rh * r + gates @ u.T
    into["x" + side], into["u" + side], into["n" + side] = dx, du, dn


def _turned(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences in reverse, and where each of their positions lies in the forward order."""
    at = sizes[:, None] - 1 - np.arange(x.shape[1])[None, :]
    at = np.where(at >= 0, at, np.arange(x.shape[1])[None, :])
    return np.take_along_axis(x, at, 1), at


def _states(x: np.ndarray, sizes: np.ndarray, p: dict, keeps: tuple | None):
    mask = (np.arange(x.shape[1])[None, :] < sizes[:, None]).astype(np.float32)
    turned, at = _turned(x, sizes)
    ahead = _run(x, mask, p, "f", keeps and keeps[0])
    behind = _run(turned, mask, p, "b", keeps and keeps[1])
    behind = np.take_along_axis(behind, at.T[:, :, None], 0)
    return np.concatenate([ahead, behind], 2), mask, turned, at


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def loss_and_gradients(x, sizes, label, p) -> tuple[float, dict]:
    """Mean cross-entropy of all positions, and its gradients."""
    keeps: tuple[list, list] = ([], [])
    s, mask, turned, at = _states(x, sizes, p, keeps)
    q = _softmax(s @ p["w"] + p["c"])
    rows, total = np.arange(len(label)), mask.sum()
    loss = float((-np.log(q[:, rows, label] + 1e-9) * mask.T).sum() / total)
    d = q.copy()
    d[:, rows, label] -= 1
    d *= mask.T[:, :, None] / total
    grads = {"w": np.tensordot(s, d, ((0, 1), (0, 1))), "c": d.sum((0, 1))}
    ds = d @ p["w"].T
    hidden = p["nf"].shape[0]
    # masked positions map to themselves, so the same gather turns the order back
    behind = np.take_along_axis(ds[:, :, hidden:], at.T[:, :, None], 0)
    _back(x, mask, p, "f", keeps[0], ds[:, :, :hidden], grads)
    _back(turned, mask, p, "b", keeps[1], behind, grads)
    return loss, grads


def train(docs: DataFrame, hidden: int = 12, steps: int = 350, batch: int = 384,
          rate: float = 0.02, seed: int = 7, **sample) -> Model:
    """Fit the network to the labelled rows of ``docs`` (doc_id, text, lang)."""
    rows = training_words(docs, **sample).toPandas().sort_values(["lang", "word"])
    langs = sorted(rows["lang"].unique())
    if not langs:
        return Model([], {})
    rng = np.random.default_rng(seed)
    x, sizes, owner = encode(rows["word"].tolist())
    label = np.searchsorted(langs, rows["lang"].to_numpy().astype(str))[owner]
    weight = np.sqrt(rows["n"].to_numpy(float))[owner]
    for k in range(len(langs)):
        weight[label == k] /= weight[label == k].sum()
    weight /= weight.sum()
    p = {"w": rng.normal(0, 0.2, (2 * hidden, len(langs))), "c": np.zeros(len(langs))}
    for side in "fb":
        p["x" + side] = rng.normal(0, 0.3, (256, 3 * hidden))
        p["u" + side] = rng.normal(0, 0.25, (hidden, 2 * hidden))
        p["n" + side] = rng.normal(0, 0.25, (hidden, hidden))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        i = rng.choice(len(label), batch, p=weight)
        longest = int(sizes[i].max())
        _, grads = loss_and_gradients(x[i][:, :longest], sizes[i], label[i], p)
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - pace * (first[k] / (1 - 0.9**step))
                    / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(list(map(str, langs)), p)


def label_words(words: list[str], model: Model) -> np.ndarray:
    """Per word the sum over its positions of the languages' probabilities, and the positions."""
    x, sizes, owner = encode(words)
    out = np.zeros((len(words), len(model.langs) + 1), np.float32)
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), 2048):
        i = order[at:at + 2048]
        longest = int(sizes[i].max())
        s, mask, _, _ = _states(x[i][:, :longest], sizes[i], model.params, None)
        q = _softmax(s @ model.params["w"] + model.params["c"]) * mask.T[:, :, None]
        np.add.at(out, owner[i], np.concatenate([q.sum(0), mask.sum(1)[:, None]], 1))
    return out


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and n_positions of every whole text of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(text_of("text").alias("text"),
                       *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    schema = ", ".join([f"c{i} {kind}" for i, (_, kind) in enumerate(docs.select(*keep).dtypes)] + [PREDICTED])
    n_langs = len(model.langs)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        known = np.zeros((0, n_langs + 1), np.float32)
        for batch in batches:
            split = [t.lower().split() for t in batch.column(0).to_pylist()]
            counts = np.array([len(w) for w in split])
            codes, words = pd.factorize(np.array([w for ws in split for w in ws] or [""], object))
            fresh = [w for w in words if w not in places]
            if len(places) + len(fresh) > CACHE_WORDS:
                places, known, fresh = {}, known[:0], list(words)
            if fresh:
                spoken = [w for w in fresh if any(map(str.isalpha, w))]
                more = np.zeros((len(fresh), n_langs + 1), np.float32)
                if n_langs and spoken:
                    more[[k for k, w in enumerate(fresh) if any(map(str.isalpha, w))]] = \
                        label_words(spoken, model)
                places.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                known = np.concatenate([known, more])
            mine = known[np.fromiter((places[w] for w in words), np.int64, len(words))]
            pooled = np.zeros((len(split), n_langs + 1))
            owner = np.repeat(np.arange(len(split)), counts)
            for k in range(n_langs + 1):
                pooled[:, k] = np.bincount(owner, mine[codes[:len(owner)], k], len(split))
            share = pooled[:, :n_langs] / np.maximum(pooled[:, n_langs:], 1)
            said = pooled[:, n_langs] > 0
            best = share.argmax(1) if n_langs else np.zeros(len(split), int)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[1:],
                pa.array([model.langs[b] if s else "und" for b, s in zip(best, said, strict=True)],
                         pa.string()),
                pa.array(np.where(said, share.max(1, initial=0), 0.0).clip(0, 1)),
                pa.array(pooled[:, n_langs].astype(np.int64))],
                names=[f"c{i}" for i in range(len(keep))] + ["lang_pred", "score", "n_positions"])

    return rows.mapInArrow(label, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "n_positions")


def held_out() -> Column:
    """Documents kept out of the training sample: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
