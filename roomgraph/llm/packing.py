"""Packing documents into windows of a fixed capacity by multiway differencing.

Documents are tokenised where they are read. A document longer than a window is cut into full
windows and a rest; only the rests are packed. They are read from a stored table in blocks of
``block`` rests, and each block is split into near-equal windows by Karmarkar-Karp multiway
differencing: the two partial partitions with the largest imbalance are merged, heaviest windows
against lightest, until one is left. The number of windows starts at the least possible and rises
while a window exceeds the capacity.

Defined cases: a null or empty text has only its end id; a long text yields as many pieces as it
needs; every input row is packed, so a repeated row is packed again under the same id (a null id
too); equal lengths are told apart by their place in the block; an empty table gives no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgraph.llm.common import small_batches, stored, text_of

#: Words whose ids a worker remembers, from task to task; once full, further words are encoded anew.
CACHE_WORDS = 400_000
_KNOWN: dict[str, "_Words"] = {}

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "whole boolean, ids binary")
PLACED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long, ids binary")


class _Words(dict):
    """Ids (little-endian unsigned 32-bit) of words, found when first asked for.

    Only for a tokenizer that drops white space and lower-cases before it looks for merges, and
    whose pre-tokens are runs of letters, single digits and runs of other signs: a word of letters
    then goes to the merges as it is, byte by byte, and a comma or stop behind it stands alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = "".join(map(chr, range(0x80, 0x100)))
        # how the merges write a byte that isn't ASCII
        self.signs = {
            ord(c): letters.pre_tokenize_str(bytes([0xC2 + (ord(c) >= 0xC0), 0x80 + ord(c) % 64]
                                                   ).decode())[0][0][1] for c in latin[:64]}
        leads = {b: letters.pre_tokenize_str(chr((b - 0xC0) * 64 if b < 0xE0 else
                 max(0x800, (b - 0xE0) << 12) if b < 0xF0 else max(0x10000, (b - 0xF0) << 18))
                 )[0][0][0] for b in range(0xC2, 0xF5)}
        self.signs |= leads

    def __missing__(self, word: str) -> bytes:
        lower, end = word.lower(), b""
        if word[-1] in ".," and len(word) > 1 and lower[:-1].isalpha():
            lower, end = lower[:-1], self[word[-1]]
        if lower.isalpha() and (lower.isascii() or is_normalized("NFC", word)
                                and "\u03a3" not in word):
            if not lower.isascii():
                lower = lower.encode().decode("latin-1").translate(self.signs)
            ids = [t.id for t in self.model.tokenize(lower)]
        else:
            ids, end = self.tokenizer.encode(word, add_special_tokens=False).ids, b""
        found = struct.pack(f"<{len(ids)}I", *ids) + end
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to ids: those of their words (between spaces and line ends), one after the other."""
    known = _KNOWN.setdefault(path, None) or _Words(path)
    _KNOWN[path] = known

    def encode(texts: list[str]) -> list[bytes]:
        return [b"".join(map(known.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]

    return encode


def tokenise(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: full windows (``whole``) and a rest below the capacity."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()),
                                strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start: 4 * (start + capacity)]
                    rows.append((key, start, len(part) // 4, zlib.crc32(part), n,
                                 len(part) == 4 * capacity, part if with_ids else None))
            yield _batch(rows, PIECES)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")
                       ).mapInArrow(cut, PIECES)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Split ``sizes`` into ``k`` windows by multiway differencing: each item's window.

    A partial partition holds only its non-empty windows, heaviest first; the rest are empty.
    """
    n = len(sizes)
    parent = np.arange(n)
    parent = np.concatenate([parent, np.zeros(n, np.int64)])  # a window merged of two gets an id
    made = n
    heap = [(-int(s) if k > 1 else 0, i, np.array([s], np.int64), np.array([i]))
            for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    ticket = n
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)
        if over:
            # the lightest of a's last windows take the heaviest of b's, in opposite order
            low_a, low_b = len(a) - over, len(b) - over
            ids = np.arange(made, made + over)
            made += over
            parent[ia[low_a:]] = ids
            parent[ib[low_b:][::-1]] = ids
            loads = np.concatenate([a[:low_a], b[:low_b], a[low_a:] + b[low_b:][::-1]])
            ids = np.concatenate([ia[:low_a], ib[:low_b], ids])
        else:
            loads, ids = np.concatenate([a, b]), np.concatenate([ia, ib])
        order = np.argsort(-loads, kind="stable")
        loads, ids = loads[order], ids[order]
        gap = int(loads[0]) - (int(loads[-1]) if len(loads) == k else 0)
        ticket += 1
        heapq.heappush(heap, (-gap, ticket, loads, ids))
    window = np.full(made, -1)
    if n:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
        parent = parent[:made]
        for i in range(made - 1, -1, -1):  # a merged window's id is above its parts'
            if window[i] < 0:
                window[i] = window[parent[i]]
    return window[:n]


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Near-equal windows of at most ``capacity``; their number rises until all fit."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        window = difference(sizes, k)
        fullest = int(np.bincount(window, sizes).max())
        if fullest <= capacity:
            return window
        k = max(k + 1, math.ceil(k * (1 + (fullest / capacity - 1) / 2)))


def pack(pieces: DataFrame, capacity: int, block: int = 2048) -> DataFrame:
    """Place stored pieces: sequence_id, offset and length of the sequence."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []

        def emit(rows: list[tuple], first: int) -> tuple[list[tuple], int]:
            sizes = np.array([r[2] for r in rows], np.int64)
            window, out = pack_block(sizes, capacity), []
            totals = np.bincount(window, sizes).astype(int) if len(rows) else []
            at = [0] * len(totals)
            for row, w in zip(rows, window.tolist(), strict=True):
                out.append((*row[:5], base + first + w, at[w], int(totals[w]), row[6]))
                at[w] += row[2]
            return out, len(totals)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5]:
                    out.append((*row[:5], base + count, 0, row[2], row[6]))
                    count += 1
                else:
                    waiting.append(row)
                    if len(waiting) == block:
                        placed, used = emit(waiting, count)
                        out += placed
                        count += used
                        waiting = []
            yield _batch(out, PLACED)
        if waiting:
            yield _batch(emit(waiting, count)[0], PLACED)

    return pieces.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2,
                   with_ids: bool = False, block: int = 2048) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text). ``with_ids`` adds each piece's ids as bytes.

    The pieces are stored first: their rows and order in the files are then fixed, so blocks and
    sequence ids come out the same when a task runs again. Few large read partitions keep the
    blocks full; only a partition's last one is smaller.
    """
    pieces = stored(tokenise(docs, tokenizer, capacity, end_id, with_ids))
    return pack(pieces.coalesce(max(1, pieces.count() // (4 * block))), capacity, block)


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields])
