"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming checks, connected components.

Two fingerprints that differ in at most `radius` bits agree in at least BLOCKS - radius of BLOCKS blocks. Each
fingerprint goes into one table per choice of that many blocks, under the bits of those blocks; fingerprints that share
a table's key are compared. A key that gathers more than `most` fingerprints is divided once more the same way: its
other bits are cut into blocks, and members meet only where they agree in all but `radius` of those as well. What is
left then has so few free bits that a group can't outgrow a task, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names, spread_join

RADIUS = 3
BLOCKS = 6
#: Members of a key that are compared at once; keys with more are divided further.
MOST = 2048
LINKS = "a long, b long, part int"


def shingle_fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the XXH64 (seed 42) of word shingles, as a signed integer: a bit is one where over half of the hashes have it."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size))))
    hashes = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def block_masks(bits: list[int], radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """A mask per table: the bits of each choice of blocks - radius blocks out of the given bit positions."""
    parts = [[int(x) for x in p] for p in np.array_split(np.array(bits), min(blocks, len(bits)))]
    keep = max(len(parts) - radius, 0)
    return [sum(1 << b for part in chosen for b in part) for chosen in combinations(parts, keep)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


TABLES = block_masks(list(range(64)))
#: For each table, masks of its second division.
DEEPER = [[t | m for m in block_masks([b for b in range(64) if not t >> b & 1])] for t in TABLES]


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of distinct fingerprints, the place of the first one that links reach; each is compared with the rest once."""
    out = np.full(len(fps), -1, dtype=np.int64)
    rest = np.arange(len(fps))
    while len(rest):
        root, front = rest[0], rest[:1]
        out[root], rest = root, rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            step = max(1, (1 << 22) // len(rest))
            for lo in range(0, len(front), step):
                near |= (np.bitwise_count(fps[front[lo : lo + step]][:, None] ^ fps[rest][None, :]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            out[front] = root
    return out


def links_in(most: int | None, radius: int = RADIUS):
    """mapInArrow over (part, key, fp) sorted by part and key: links (fp, its root in this key), or, of keys with over `most` members, those members as (fp, null).

    A key's members are held up to `most`; beyond that all of them pass through, so that no key fills a task's memory.
    """

    def batch(a: np.ndarray, b: np.ndarray | None, part: int) -> pa.RecordBatch:
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.full(len(a), part, dtype=np.int32))], names=["a", "b", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, held, size, crowded = None, [], 0, False

        def linked_here() -> None:
            if size > 1 and not crowded:
                fps = np.concatenate(held)
                root = linked(fps, radius)
                own = root != np.arange(len(fps))
                if own.any():
                    found.append((fps[own], fps[root[own]]))

        for b in batches:
            if not b.num_rows:
                continue
            part, key, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edges = (np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(fp)]):
                if (part[lo], key[lo]) != at:
                    linked_here()
                    at, held, size, crowded = (part[lo], key[lo]), [], 0, False
                held.append(fp[lo:hi])
                size += hi - lo
                if most and size > most:
                    crowded = True
                    yield batch(np.concatenate(held), None, int(part[lo]))
                    held = []
            if sum(len(a) for a, _ in found) > 50_000:
                yield batch(*map(np.concatenate, zip(*found)), 0)
                found = []
        linked_here()
        if found:
            yield batch(*map(np.concatenate, zip(*found)), 0)

    return run


def keyed(fps: DataFrame, tables: list[tuple[int, int]], column: str = "fp") -> DataFrame:
    """A row per fingerprint and table: (part, key, fp), those of a key together and in order."""
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(column).bitwiseAND(F.lit(signed(m))).alias("key")) for p, m in tables)))
    return fps.select(F.col(column).alias("fp"), rows.alias("x")).select("x.part", "x.key", "fp").repartition("part", "key").sortWithinPartitions("part", "key")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in at most RADIUS bits, enough of them to connect all that are linked.

    fps: distinct fingerprints in a long column fp.
    """
    first = checkpointed(keyed(fps, list(enumerate(TABLES))).mapInArrow(links_in(MOST), LINKS))
    crowded = first.where(F.col("b").isNull()).select(F.col("a").alias("fp"), "part")
    masks = F.array(*(F.array(*(F.lit(signed(m)) for m in ms)) for ms in DEEPER))
    wide = len(DEEPER[0])
    second = crowded.select("fp", "part", F.posexplode(masks[F.col("part")]).alias("k", "m")).select((F.col("part") * wide + F.col("k")).alias("part"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    second = second.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(links_in(None), LINKS)
    return first.where(F.col("b").isNotNull()).unionByName(second).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for each node that has any.

    Rounds of large-star and small-star steps: each node's neighbours move to the smallest of them, until nothing
    moves. A node of very many links is joined, never gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(low, "u")
        if large:
            return moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()

    now = edges.where(F.col("a") != F.col("b"))
    was = None
    while True:
        now = checkpointed(star(star(now, True), False))
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == was or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        was = state


def digest(docs: DataFrame) -> Column:
    """What tells rows with equal ids apart: a hash of the whole text, where a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, fp) of whole texts, and digest if it is asked for; a null text counts as empty."""
    also = [digest(docs).alias("digest")] if digests else []
    names = ["doc_id", "fp", *["digest"][: len(also)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_fingerprint(t) for t in b.column(1).to_pylist()], pa.int64()), *b.columns[2:]], names=names)

    return docs.select("doc_id", "text", *also).mapInArrow(run, "doc_id long, fp long" + ", digest binary" * len(also))


def with_component(fps: DataFrame) -> DataFrame:
    """The rows of distinct fingerprints fp with their component: the smallest fingerprint that links reach."""
    found = checkpointed(components(links(fps.select("fp"))))
    return fps.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most RADIUS differing bits reach.

    A row for each row of docs. Null and empty texts have fingerprint zero and are linked like any other; rows whose
    doc_id is null keep their links but never name a component (null if nothing else is reachable); repeated rows
    repeat in the result; an empty table gives an empty result; other columns don't matter.
    """
    marked = checkpointed(fingerprints(docs))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = with_component(fps)
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(spread_join(placed.select("fp", "component"), ids, "component").select("fp", "component_id"))
    return spread_join(marked, named, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: one row of each component, that of the smallest doc_id.

    Rows whose doc_id is null come after all others; among them, and among rows of one id in a component, the smallest
    digest of the text decides; of rows with equal id and text any one stays.
    """
    marked = checkpointed(fingerprints(docs, digests=True))
    counted = marked.groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest", "n")).alias("first")
    best = with_component(checkpointed(counted.groupBy("fp").agg(first))).groupBy("component").agg(F.min("first").alias("first"))
    key, own, wanted, n = free_names(docs, "id", "digest", "chosen", "n")
    chosen = checkpointed(best.select(F.col("first.doc_id").alias(key), F.col("first.digest").alias(wanted), F.col("first.n").alias(n)))
    rows = docs.withColumn(own, digest(docs))
    kept = rows.join(chosen, (F.col("doc_id") == F.col(key)) & (F.col(own) == F.col(wanted)))
    again = kept.where(F.col(n) > 1).dropDuplicates(["doc_id", own])
    # copies without an id meet before they are joined, so that a common text doesn't fill one task
    unknown = rows.where(F.col("doc_id").isNull()).dropDuplicates([own]).join(chosen.where(F.col(key).isNull()), F.col(own) == F.col(wanted))
    return kept.where(F.col(n) == 1).unionByName(again).unionByName(unknown).select(*docs.columns)
