"""Document fingerprints: SimHash of weighted terms, compared between neighbours and searched within a Hamming radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written
from .exchange import arrow_schema
from .simhash import block_masks, signed

#: Words whose hash a task keeps at most.
MEMO = 300_000
#: Rows that a range of ids holds about, where there are more ranges than twice the shuffle's partitions.
RANGE_ROWS = 100_000
#: Bits that near fingerprints differ in at most.
RADIUS = 3


class Words(dict):
    """Hashes of words, those looked up lately kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def term_fingerprint(text: str, memo: Words) -> int:
    """SimHash over pairs of neighbouring words, the text's ends counting as words.

    A pair that occurs n times weighs 1 + log2(n). Each pair's hash votes with that weight for or against every bit;
    a bit is one where the votes for it prevail. Equal texts have equal fingerprints.
    """
    h = np.array([1, *map(memo.__getitem__, text.encode("utf-8", "replace").lower().split()), 2], dtype=np.uint64)
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor(h[1:], h[1:] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    x, n = np.unique(x ^ (x >> np.uint64(29)), return_counts=True)
    weight = (1 + np.log2(n)).astype(np.float32)
    votes = np.zeros(64)
    for lo in range(0, len(x), 65536):
        bits = np.unpackbits(x[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weight[lo : lo + 65536] @ bits.astype(np.float32)
    return int(np.packbits(votes * 2 > weight.sum(dtype=np.float64), bitorder="little").view("<i8")[0])


def likeness(a: int, b: int) -> float:
    """The cosine of the angle between two documents' terms that the share of differing bits stands for; 0 beyond a right angle."""
    return max(0.0, float(np.cos(np.pi * ((a ^ b) & (2**64 - 1)).bit_count() / 64)))


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by as many from the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def ordered(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text) in ranges of falling id, null ids last; rows of one id by a hash of their text, so that many of them divide."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("__row")]
    return rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def with_next(docs: DataFrame, compare, schema: str, ranges: int | None = None) -> DataFrame:
    """compare(text, next text) for each document and the one with the next smaller id (after the smallest: the largest).

    compare gives the columns after doc_id. Texts are shuffled once, into ranges of ids that a task walks through with
    two texts in hand. What stands at a range's ends is a row with its first and its last text; those rows, one for each
    range, are put in order to compare each range's last text with the first one of the next range that isn't empty.
    """
    names = ["doc_id", *(f.split()[0] for f in schema.split(", "))]
    edge = "place int, last_id long, first string, last string"
    kinds = arrow_schema(f"doc_id long, {schema}, {edge}")
    ranges = ranges or max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // RANGE_ROWS)

    def filled(values: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in kinds], schema=kinds)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if last is None:
                    first = text
                else:
                    rows.append((last[0], *compare(last[1], text)))
                last = doc, text
            if rows:
                yield filled(dict(zip(names, zip(*rows))), len(rows))
        if last is not None:
            yield filled({"place": [TaskContext.get().partitionId()], "last_id": [last[0]], "first": [first], "last": [last[1]]}, 1)

    done = written(ordered(docs, ranges).mapInArrow(walk, f"doc_id long, {schema}, {edge}"), "walked")
    # the window sees the ranges' numbers alone; texts meet by number
    by = W.orderBy("place")
    places = done.where(F.col("place").isNotNull()).select("place")
    after = places.select("place", F.coalesce(F.lead("place").over(by), F.first("place").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    at = done.where(F.col("place").isNotNull())
    ends = at.select("place", "last_id", "last").join(after, "place").join(at.select(F.col("place").alias("after"), F.col("first").alias("following")), "after").select("last_id", "last", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *compare(t, n)) for i, t, n in zip(*(c.to_pylist() for c in b.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], names=names)

    return done.where(F.col("place").isNull()).select(*names).unionByName(ends.mapInArrow(close, f"doc_id long, {schema}"))


def tables(fps: DataFrame, name: str, masks: list[int]) -> DataFrame:
    """(name, part, key): each distinct fingerprint (column fp) under the bits of each table's blocks."""
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("part", "key")
    return fps.select("fp").where(F.col("fp").isNotNull()).distinct().select(F.col("fp").alias(name), keys)


def near_pairs(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(q, f, distance) of distinct fingerprints within `radius` differing bits, by permuted block tables.

    queries, fps: column fp. One table per choice of blocks - radius blocks, keyed by those blocks' bits: two
    fingerprints within the radius agree on one choice at least. A pair counts under the first table where it meets.
    """
    masks = block_masks(list(range(64)), radius, blocks or max(2 * radius, 1))
    differs = F.col("q").bitwiseXOR(F.col("f"))
    before = F.when(F.lit(False), -1)
    for k, m in enumerate(masks):
        before = before.when(differs.bitwiseAND(F.lit(signed(m))) == 0, k)
    met = tables(queries, "q", masks).join(tables(fps, "f", masks).hint("merge"), ["part", "key"])
    return met.where((F.bit_count(differs) <= radius) & (F.col("part") == before)).select("q", "f", F.bit_count(differs).alias("distance"))


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(query_id, doc_id, distance) of all fingerprints within `radius` differing bits of each query.

    queries: query_id, fp; fps: doc_id, fp. Equal fingerprints are joined as one and get their documents back at the
    end: ties and repeated rows all come, once for each row. Rows without a fingerprint find nothing and are not found;
    empty tables give an empty result; other columns don't matter.
    """
    pairs = near_pairs(queries, fps, radius, blocks)
    return queries.select("query_id", "fp").join(pairs, F.col("fp") == F.col("q")).select("query_id", "f", "distance").join(fps.select("doc_id", F.col("fp").alias("f")), "f").select("query_id", "doc_id", "distance")


def count_within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n_near): how many rows of fps have a fingerprint within `radius` bits of each distinct one of queries. Pairs are counted, never gathered."""
    copies = fps.where(F.col("fp").isNotNull()).groupBy(F.col("fp").alias("f")).agg(F.count("*").alias("n"))
    return near_pairs(queries, fps, radius).join(copies.hint("merge"), "f").groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("n_near"))


def fingerprint_query(docs: DataFrame, every: int = 20, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document's are.

    n_near: for documents whose id is divisible by `every`, how many other documents have a fingerprint within RADIUS
    bits; null for the others. A null text counts as empty. Of rows with equal ids each has the next of them, by a hash
    of the text, as its next document. A document alone is its own next one. Empty tables give empty results; other
    columns don't matter. A task holds a batch of rows at a time, however long a range is.
    """
    memo = Words()

    def compare(text: str, following: str) -> tuple:
        other = edited(text, following)
        own, theirs, changed = (term_fingerprint(t, memo) for t in (text, following, other))
        return len(text), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), own, changed, likeness(own, changed), likeness(own, theirs)

    out = with_next(docs, compare, "n_chars long, edited_sha256 string, fingerprint long, edited_fingerprint long, near_edited double, near_next double", ranges)
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    fps = out.select(F.col("fingerprint").alias("fp"))
    near = count_within(out.where(asks).select(F.col("fingerprint").alias("fp")), fps)
    asked = out.where(asks).join(near, F.col("fingerprint") == F.col("fp"), "left").select(*out.columns, (F.col("n_near") - 1).alias("n_near"))
    out = asked.unionByName(out.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
    for c in ("fingerprint", "edited_fingerprint"):
        out = out.withColumn(c, F.lower(F.lpad(F.hex(c), 16, "0")))
    return out
