"""Texts as the distinct words of blocks: rows that Spark shuffles by word, sorts and brings back by block.

A block holds the documents that a task reads one after another. The first shuffle brings the blocks' distinct words
together, so that each word of the corpus is looked at once; the second, on the block, brings back what was found, and
the documents are put together again by the places of their tokens. A block's own row, with its documents and those
places, comes along. A word costs its share of a row per block it occurs in, not per occurrence, so no word is hot, and
nothing that a row holds grows with the corpus.

word_rows has a row per word, for joins; chunk_rows has the words of a block that share a hash in one row, which takes
less than half the room in a shuffle.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import runs

#: Characters of a block about, and of one whose words are rows; what a document counts for beside its own characters.
BLOCK_CHARS, ROW_CHARS, EACH_DOC = 32 << 20, 12 << 20, 64
#: Tokens of a document that are held as objects at a time, and words of a batch.
TOKENS, WORDS = 1 << 18, 20_000
#: Bits of `at` that say the place.
PLACE = 28
#: No UTF-8 text has this byte.
BETWEEN = b"\xff"
#: Hashes of words for each partition of a shuffle.
PARTS = 4
COUNTED = "at long, word binary, known long"
CHUNK = "part int, block long, places binary, data binary"


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def small(x: np.ndarray) -> bytes:
    """Numbers from 0 in sevens of bits, low ones first, a high bit saying that more follow; then compressed."""
    x = x.astype(np.uint32)
    size = np.ones(len(x), dtype=np.int64)
    for k in (7, 14, 21, 28):
        size += x >> np.uint32(k) > 0
    part = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = np.repeat(x, size) >> (7 * part).astype(np.uint32) & np.uint32(127)
    out[part + 1 < np.repeat(size, size)] |= np.uint32(128)
    return squeezed(out.astype(np.uint8).tobytes())


def large(data: bytes) -> np.ndarray:
    """The numbers that small wrote."""
    raw = np.frombuffer(unsqueezed(data), dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    x = np.zeros(len(ends), dtype=np.int64)
    for k in range(5):
        more = starts + k <= ends
        x[more] |= (raw[starts[more] + k] & 127).astype(np.int64) << (7 * k)
    return x


def packed(places: np.ndarray, once: int) -> bytes:
    """Tokens' places. Those from `once` on belong to words of a single use, in order: they are written as 0, others as place + 1."""
    return small(np.where(places >= once, 0, places + 1))


def unpacked(data: bytes, once: int) -> np.ndarray:
    x = large(data)
    new = x == 0
    x -= 1
    x[new] = once + np.arange(int(new.sum()))
    return x


class Block:
    """The documents that a task reads one after another, their tokens as numbers of distinct words."""

    def __init__(self):
        self.words: dict[bytes, int] = defaultdict(count().__next__)
        self.docs: list[tuple] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc, text: str, tokens: Iterator[bytes]) -> None:
        n = 0
        while some := list(islice(tokens, TOKENS)):
            self.found.append(np.fromiter(map(self.words.__getitem__, some), dtype=np.int32, count=len(some)))
            n += len(some)
        self.docs.append((doc, n))
        self.size += len(text) + EACH_DOC

    def finished(self) -> tuple[list[bytes], np.ndarray, np.ndarray, bytes]:
        """(words by place, their numbers, tokens as numbers, the block's own data)."""
        every = np.concatenate(self.found) if self.found else np.zeros(0, dtype=np.int32)
        n = len(self.words)
        often = np.bincount(every, minlength=n)
        order = np.argsort(-often, kind="stable")  # frequent words get low places, which pack well
        once = int((often > 1).sum())
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        ids, sizes = zip(*self.docs)
        words = list(self.words)
        return [words[k] for k in order.tolist()], order, every, pickle.dumps((ids, sizes, once, packed(rank[every], once)))


def in_task_blocks(docs: DataFrame, tokens, rows: Callable[[int, Block], Iterator[pa.RecordBatch]], schema: str, chars: int) -> DataFrame:
    """What rows(number, block) gives for each block of about `chars` characters of docs (doc_id, text). tokens(): made once a task, gives a text's words as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, block = tokens(), TaskContext.get().partitionId() << 12, Block()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block.add(doc, text or "", iter(split(text or "")))
                if block.size >= chars:
                    yield from rows(number, block)
                    number, block = number + 1, Block()
        if block.docs:
            yield from rows(number, block)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def word_rows(docs: DataFrame, tokens: Callable[[], Callable[[str], Iterator[bytes]]], counted: Callable[[list], np.ndarray]) -> DataFrame:
    """(at, word, known): a row per block and distinct word, `at` being the block and the word's place from 1, and the block's own row, at place 0.

    counted: which doc_ids' words count; `known` is how often a word occurs in those documents of the block.
    """

    def rows(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        words, order, every, own = block.finished()
        ids, sizes = zip(*block.docs)
        known = np.bincount(every[np.repeat(counted(list(ids)), sizes)], minlength=len(words))[order]
        batch = lambda lo, words, known: pa.RecordBatch.from_pydict({"at": pa.array(np.arange(lo, lo + len(words)) + (number << PLACE), pa.int64()), "word": pa.array(words, pa.binary()), "known": pa.array(known, pa.int64())})
        yield batch(0, [own], [0])
        for lo in range(0, len(words), WORDS):
            yield batch(lo + 1, words[lo : lo + WORDS], known[lo : lo + WORDS])

    return in_task_blocks(docs, tokens, rows, COUNTED, ROW_CHARS)


def is_block() -> Column:
    """Whether a row of word_rows is a block's own and its `word` the block's documents and places."""
    return F.col("at").bitwiseAND(F.lit((1 << PLACE) - 1)) == 0


def chunk_rows(docs: DataFrame, tokens: Callable[[], Callable[[str], Iterator[bytes]]]) -> DataFrame:
    """CHUNK of docs: a row per block and hash of words (part) with those words and their places, and the block's own row, whose places are null."""
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = arrow_schema(CHUNK)

    def rows(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        words, _, _, own = block.finished()
        part = np.fromiter((xxhash.xxh32_intdigest(w) % parts for w in words), dtype=np.int64, count=len(words))
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh32_intdigest(str(number)) % parts], pa.int32()), pa.array([number]), pa.nulls(1, pa.binary()), pa.array([own])], schema=schema)
        by = np.argsort(part, kind="stable")
        out = []
        for some in np.split(by, np.flatnonzero(np.diff(part[by])) + 1) if len(by) else ():
            out.append((int(part[some[0]]), number, small(np.diff(some, prepend=0)), squeezed(BETWEEN.join([words[k] for k in some.tolist()]))))
        for lo in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[lo : lo + 256]), schema)], schema=schema)

    return in_task_blocks(docs, tokens, rows, CHUNK, BLOCK_CHARS)


def words_of(data: bytes) -> list[bytes]:
    return unsqueezed(data).split(BETWEEN)


def in_blocks(rows: DataFrame, finish: Callable[[list, np.ndarray, np.ndarray, pa.Table], dict], schema: str) -> DataFrame:
    """The second shuffle. rows: block, place, data and what is known of each word or chunk; the block's own row has the least place.

    finish(doc_ids, sizes, places, words) gives a block's columns: ids and numbers of tokens of its documents, the
    places of all their tokens, and the other rows in the order of place.
    """
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, ["block"]):
            table = pa.Table.from_batches(held)
            ids, sizes, once, places = pickle.loads(table["data"][0].as_py())
            out = finish(list(ids), np.array(sizes, dtype=np.int64), unpacked(places, once), table.slice(1))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return rows.repartition("block").sortWithinPartitions("block", "place").mapInArrow(run, schema)


def gather(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in a flat array of the pieces `at`, one after another."""
    n = sizes[at]
    ends = np.cumsum(n)
    return np.repeat(starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
