"""Byte-level BPE by a global shuffle of distinct pre-tokens, and decoding by the table of token bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import exchange
from .tokens import encoding, ranks

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Tokens of a document that are decoded at a time.
STEP = 1 << 20


def splitter():
    find = regex.compile(public_tokenizers.PATTERN).finditer
    whole = regex.compile(public_tokenizers.PATTERN).findall

    def split(text: str) -> Iterator[bytes]:
        if len(text) < 1 << 22:
            return (w.encode("utf-8", "replace") for w in whole(text))
        return (m[0].encode("utf-8", "replace") for m in find(text))

    return split


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(block, place, sizes, data): the ids of each block's distinct pre-tokens by part, in `place`; -1 is the block's own row.

    Chunks of a part follow one another, so each distinct pre-token is encoded once and its ids joined to all its uses.
    """
    names = ["block", "place", "places", "sizes", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, known = encoding(vocabulary)._encode_single_piece, None, {}
        for b in batches:
            out = []
            for part, block, places, data in zip(*(c.to_pylist() for c in b.columns)):
                if places is None:
                    out.append((block, -1, None, None, data))
                    continue
                if part != at:
                    at, known = part, {}
                ids = [known.get(w) or known.setdefault(w, encode(w)) for w in exchange.words_of(data)]
                flat = np.array([x for i in ids for x in i])
                out.append((block, part, places, exchange.small(np.array([len(i) for i in ids])), exchange.small(flat)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    chunks = exchange.chunk_rows(docs, splitter).repartition("part").sortWithinPartitions("part")
    return chunks.mapInArrow(run, "block long, place int, places binary, sizes binary, data binary")


class Decoder:
    """The table of token bytes, which has a fixed number of rows; ids are joined to it and their bytes put together."""

    def __init__(self, vocabulary: str):
        known = {r: t for t, r in ranks(vocabulary).items()}
        table = [known.get(r, b"") for r in range(max(known) + 1)]
        self.letters, self.widths = np.frombuffer(b"".join(table), dtype=np.uint8), np.array([len(t) for t in table], dtype=np.int64)
        self.begins = np.cumsum(self.widths) - self.widths

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.letters[exchange.gather(self.begins, self.widths, ids[k : k + STEP])].tobytes() for k in range(0, len(ids), STEP))


def assembled(rows: DataFrame, vocabulary: str, finish, schema: str) -> DataFrame:
    """finish(ids, decoded bytes) of each document, in columns after doc_id."""
    shared = rows.sparkSession.sparkContext.broadcast(Decoder(vocabulary))
    names = exchange.arrow_schema(schema).names

    def assemble(docs: list, counts: np.ndarray, places: np.ndarray, words: pa.Table) -> dict:
        joined = lambda c: np.concatenate([exchange.large(x) for x in words[c].to_pylist()]) if len(words) else np.zeros(0, dtype=np.int64)
        order = np.concatenate([np.cumsum(exchange.large(x)) for x in words["places"].to_pylist()]) if len(words) else np.zeros(0, dtype=np.int64)
        told, flat = joined("sizes"), joined("data").astype("<u4")
        sizes, starts = np.empty_like(told), np.empty_like(told)
        sizes[order], starts[order] = told, np.cumsum(told) - told
        out: dict[str, list] = {n: [] for n in names}
        upto = np.cumsum(counts)
        for doc, lo, hi in zip(docs, upto - counts, upto):
            ids = flat[exchange.gather(starts, sizes, places[lo:hi])]
            for n, v in zip(names, (doc, *finish(ids, shared.value.decode(ids)))):
                out[n].append(v)
        return out

    return exchange.in_blocks(rows, assemble, schema)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the ids of each whole text, and the text that they decode to.

    A null or empty text has no ids and decodes to the empty text; rows with equal or null doc_id are encoded each on its
    own; an empty table gives an empty result; other columns don't matter.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return assembled(encoded(docs, path), path, lambda ids, text: (ids.astype("int32").tolist(), text.decode("utf-8", "replace")), "doc_id long, ids array<int>, text string")


def bpe_query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return assembled(encoded(docs, path), path, lambda ids, text: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()), OUT)
