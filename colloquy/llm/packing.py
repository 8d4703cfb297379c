"""Packing: best-fit decreasing into windows, by a segment tree over remaining capacities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .tokens import encoding

WINDOW = 2048
END = 1
#: Tokens that are packed together, in one task's memory, at most (and one document more).
BLOCK_TOKENS = 1 << 22
#: Tokens a window may stay short of its end; those that fall shorter are cut anew.
SLACK = 8
#: White space other than the space and the line feed.
RARE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity: a segment tree of counts, whose leaves are the capacities."""

    def __init__(self, window: int = WINDOW):
        self.size = 1 << window.bit_length()
        self.counts = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self.shift(capacity, 1)

    def shift(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.counts[k] += by
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with the least capacity that is at least `need`; it is taken out."""
        k = need + self.size
        while not self.counts[k]:  # up, until some leaf to the right is open
            while k & 1:
                k >>= 1
            if not k:  # the right edge of the tree
                return None
            k += 1
        while k < self.size:  # down, to the leftmost of those
            k = 2 * k if self.counts[2 * k] else 2 * k + 1
        capacity = k - self.size
        self.shift(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows, each a list of places in lengths: the longest first, each into the tightest open window that holds it."""
    tree, out, free = CapacityTree(window), [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        if found is None:
            out.append([k])
            free.append(window - lengths[k])
            at = len(out) - 1
        else:
            at = found[1]
            out[at].append(k)
            free[at] -= lengths[k]
        if free[at]:
            tree.add(free[at], at)
    return out


def pack_block(docs: list[tuple[int, np.ndarray]], window: int = WINDOW, slack: int = SLACK) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (place of the document, start, length), each full, a few tokens short, or a power of two long.

    Documents longer than a window are cut into full windows and a rest. Rests are packed best-fit decreasing. Windows
    that stay short by more than `slack` are poured into full windows, and what is left at the end is cut at powers of
    two, which need no padding.
    """
    rests = []
    for k, (_, ids) in enumerate(docs):
        full = len(ids) // window * window
        for lo in range(0, full, window):
            yield [(k, lo, window)]
        if full < len(ids):
            rests.append((k, full, len(ids) - full))
    poured = []
    for held in best_fit([r[2] for r in rests], window):
        used = sum(rests[k][2] for k in held)
        if window - used <= slack or not used & (used - 1):
            yield [rests[k] for k in held]
        else:
            poured += [rests[k] for k in held]
    left = sum(p[2] for p in poured)
    sizes = [window] * (left // window) + [1 << b for b in range((left % window).bit_length() - 1, -1, -1) if left % window >> b & 1]
    poured.reverse()
    for size in sizes:
        out = []
        while size:
            k, lo, n = poured.pop()
            if n > size:
                poured.append((k, lo + size, n - size))
                n = size
            out.append((k, lo, n))
            size -= n
        yield out


class Ids:
    """Ids of whole texts, by tiktoken from the same vocabulary, which gives the tokenizer's ids in less time.

    Where white space never stands beside white space, the pattern's look-ahead for such runs can't matter, and a
    pattern without it splits alike and faster. The tokenizer itself encodes texts that may hold a special token.
    """

    def __init__(self, path: str, ranks: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.full, self.plain = encoding(ranks), encoding(ranks, public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", ""))

    def of(self, text: str) -> np.ndarray:
        if "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif "  " in text or "\n\n" in text or "\n " in text or " \n" in text or RARE.search(text):
            ids = self.full.encode_ordinary(text)
        else:
            ids = self.plain.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most `window` tokens.

    Each task packs its own rows, in blocks of BLOCK_TOKENS, so nothing is shuffled and the padding of a block's last
    window is all that the division costs. A null or empty text is the end token alone. Rows with equal or null doc_id
    are packed each on its own; an empty table gives no pieces; other columns don't matter. Sequence ids are unique: the
    task's partition in the upper bits, a counter in the lower 36.
    """
    path, same = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number, block, size = Ids(path, same), TaskContext.get().partitionId() << 36, [], 0

        def out() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for sequence in pack_block(block, window):
                at = 0
                for k, lo, n in sequence:
                    doc, whole = block[k]
                    rows.append((doc, lo, n, zlib.crc32(whole[lo : lo + n].tobytes()), len(whole), number, at))
                    at += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                whole = np.append(ids.of(text or ""), np.uint32(end)).astype("<u4")
                block.append((doc, whole))
                size += len(whole)
                if size >= BLOCK_TOKENS:
                    yield out()
                    block, size = [], 0
        if block:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
