"""Words and shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed together until they have so many bytes; a longer one is hashed alone.
GROUP_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n + 1, 2 * GROUP_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space."""
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hashed_words(texts: list[bytes], lower: bool
                 ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of consecutive texts: first and last index, the words' hashes in order, and where
    each text's words begin (one more entry for the end)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_BYTES):
            size += len(texts[end]) + 1
            end += 1
        raw = np.frombuffer(b"\n".join(texts[at:end]), np.uint8)
        first, last = word_spans(raw)
        if lower:
            raw = _LOWER[raw]
        up, down = _power(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=total[1:])
        words = mixed((total[last] - total[first]) * down[first]
                      + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
        yield at, end, words, np.concatenate([[0], np.searchsorted(first, ends)])
        at = end


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words that lies within ``words``."""
    if len(words) < length:
        return words[:0]
    out = np.full(len(words) - length + 1, length, np.uint64)
    for k in range(length):
        out = mixed(out * _BASE + words[k:len(words) - length + 1 + k])
    return out


def shingle_sets(texts: list[bytes], length: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, lower-cased; a shorter text is one shingle."""
    out = []
    for at, end, words, starts in hashed_words(texts, lower=True):
        every = runs(words, length)
        for k in range(end - at):
            a, b = starts[k], starts[k + 1]
            if b - a >= length:
                out.append(np.unique(every[a:b - length + 1]))
            else:
                out.append(runs(words[a:b], b - a) if b > a else words[:0])
    return out
