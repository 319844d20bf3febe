"""Token counts under a unigram segmentation, computed on a trie of distinct pre-tokens.

A pre-token is a run without white space behind a word mark. The segmentation of a pre-token is
the sequence of vocabulary pieces with the highest sum of log-probabilities; characters that no
piece covers fall back to one token a byte. The distinct pre-tokens of a batch are inserted in a
trie; a node's forward score (best segmentation of its prefix) is computed once for all words that
share the prefix, from the scores of its ancestors, a level of the trie at a time. The token count
of the best path is kept at terminal nodes and weighed by how often the word occurs.

The vocabulary file gives pieces in the order in which they were made, the most frequent first;
their probabilities are taken from Zipf's law over that order. Equal scores go to the longer last
piece.

Defined cases: null and empty texts have no tokens; a very long pre-token is scored by the same
recurrence along the word alone; repeated rows give repeated results; null ids are kept; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.llm.common import small_batches, text_of

MARK = "▁"
#: Words above this length are walked alone; their prefixes are hardly shared.
TRIE_LENGTH = 64
#: Words whose counts a task remembers.
CACHE_WORDS = 400_000
COUNTED = "doc_id long, n_pretokens long, n_tokens long"


@dataclass(frozen=True)
class Vocabulary:
    """Log-probability by piece; ``byte`` is that of one fallback byte."""

    scores: dict[str, float]
    byte: float

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.scores), default=1)


def load_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    mass = math.log(sum(1 / r for r in range(1, n + 1)))
    scores = {
        model.id_to_piece(i): -math.log(i + 1) - mass
        for i in range(n)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }
    return Vocabulary(scores, -math.log(n) - mass)


def count_alone(word: str, vocabulary: Vocabulary) -> int:
    """Tokens of one pre-token (with its mark) by the forward recurrence."""
    best, count, longest = [0.0], [0], vocabulary.longest
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        score, n = best[end - 1] + size * vocabulary.byte, count[end - 1] + size
        top = -math.inf
        for start in range(max(0, end - longest), end):
            piece = vocabulary.scores.get(word[start:end])
            if piece is not None and best[start] + piece > top:
                top, taken = best[start] + piece, count[start] + 1
        if top >= score:
            score, n = top, taken
        best.append(score)
        count.append(n)
    return count[-1]


class TrieCounter:
    """Counts for many words at once, sharing the forward scores of common prefixes."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[str]] = {}
        for piece in vocabulary.scores:
            lengths.setdefault(len(piece), []).append(piece)
        for m, pieces in lengths.items():
            codes = np.array([list(map(ord, p)) for p in pieces], np.uint64)
            h = np.zeros(len(pieces), np.uint64)
            for column in codes.T:
                h = h * self.BASE + column + np.uint64(1)
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces share a hash")
            scores = np.array([vocabulary.scores[p] for p in pieces])
            self.by_length[m] = h[order], scores[order]
        longest = max(self.by_length, default=1)
        self.power = np.array([pow(int(self.BASE), m, 1 << 64) for m in range(longest + 1)], np.uint64)

    def counts(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(sizes > TRIE_LENGTH):
            out[i] = count_alone(words[i], self.vocabulary)
        mine = np.flatnonzero((sizes <= TRIE_LENGTH) & (sizes > 0))
        if not len(mine):
            return out
        joined = "".join(words[i] for i in mine)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = sizes[mine]
        starts = np.cumsum(sizes) - sizes
        # one entry a level: of its nodes the parent, prefix hash, forward score and token count
        parents, hashes = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        at = np.zeros(len(mine), np.int64)
        alive = np.arange(len(mine))
        for level in range(1, int(sizes.max()) + 1):
            alive = alive[sizes[alive] >= level]
            key = (at[alive] << 21) | codes[starts[alive] + level - 1]
            nodes, place = np.unique(key, return_inverse=True)
            at[alive] = place
            parent, code = nodes >> 21, nodes & ((1 << 21) - 1)
            h = hashes[-1][parent] * self.BASE + code.astype(np.uint64) + np.uint64(1)
            size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            fallback = best[-1][parent] + size * self.vocabulary.byte
            fallback_n = count[-1][parent] + size
            top, top_n = np.full(len(nodes), -np.inf), np.zeros(len(nodes), np.int64)
            parents.append(parent)
            ancestor = parent
            reach = min(level, len(self.power) - 1)
            lines = []
            for m in range(1, reach + 1):
                lines.append(ancestor)
                if m < level:
                    ancestor = parents[level - m][ancestor]
            for m in range(reach, 0, -1):
                if m not in self.by_length:
                    continue
                held, scores = self.by_length[m]
                up, above = lines[m - 1], level - m
                wanted = h - hashes[above][up] * self.power[m]
                spot = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                hit = np.flatnonzero(held[spot] == wanted)
                value = best[above][up[hit]] + scores[spot[hit]]
                better = value > top[hit]
                hit, value = hit[better], value[better]
                top[hit], top_n[hit] = value, count[above][up[hit]] + 1
            known = top >= fallback
            hashes.append(h)
            best.append(np.where(known, top, fallback))
            count.append(np.where(known, top_n, fallback_n))
            ended = alive[sizes[alive] == level]
            out[mine[ended]] = count[level][at[ended]]
        return out


def count_tokens(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every whole text; no shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = TrieCounter(load_vocabulary(vocabulary_path)), {}
        for batch in batches:
            split = [t.split() for t in batch.column(1).to_pylist()]
            sizes = np.array([len(w) for w in split], np.int64)
            codes, words = pd.factorize(np.array([w for ws in split for w in ws] or [""], object))
            fresh = [w for w in words if w not in known]
            if len(known) + len(fresh) > CACHE_WORDS:
                known, fresh = {}, list(words)
            known.update(zip(fresh, trie.counts([MARK + w for w in fresh]).tolist(), strict=True))
            each = np.fromiter((known[w] for w in words), np.int64, len(words))
            owner = np.repeat(np.arange(len(split)), sizes)
            total = np.bincount(owner, each[codes[:len(owner)]], len(split)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(total)],
                names=["doc_id", "n_pretokens", "n_tokens"])

    return rows.mapInArrow(run, COUNTED)
