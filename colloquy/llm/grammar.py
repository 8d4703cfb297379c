"""Token ids in files: a Re-Pair grammar for each block of documents, with expansion lengths for reading at any place.

The file format is Parquet, written and committed by Spark, so that it can lie in any store that Spark reaches and
survives lost executors. A row is a block of whole documents:

| column | |
|-|-|
| shard, block | the task that wrote it, and its number there; ascending in doc_id |
| before, n_ids | ids of the shard's earlier blocks, and of this one |
| base | symbols under it are token ids; symbol base + k stands for rule k |
| width | bytes of a symbol, 2 or 4, little-endian and unsigned, in rules and sequence |
| rules | pairs of symbols, each under the symbol it defines |
| lengths | ids that each rule stands for, unsigned in 4 bytes |
| sequence | the block's ids as symbols |
| doc_ids, symbols | each document, and how many symbols of the sequence it has |
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import fresh_path

END = 1
#: Ids of a block about (and one document more).
BLOCK_IDS = 1 << 20
#: A pair must stand so often in a block to become a rule; rounds of replacing, and rules, of a block at most.
LEAST_PAIRS, PAIR_ROUNDS, MOST_RULES = 8, 4, 15_000
#: Buckets by which a round looks its pairs up.
BUCKETS = 1 << 18
#: Bytes of texts that are encoded together, or one text.
SLICE_BYTES = 8 << 20
#: Pieces and words whose ids a Python worker remembers, and characters of those, at most.
PIECES, WORDS, LONGEST = 150_000, 400_000, 64
#: Characters that the tokenizer's steps change in no way but by lower letters; then its words among those, and spaces.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
WORD = re.compile("[a-zß-öø-ÿ]+|[0-9]| |'(?:s|t|re|ve|m|ll|d)|[^ a-zß-öø-ÿ0-9]+")
BLOCKS = "shard long, block long, before long, n_ids long, base long, width int, rules binary, lengths binary, sequence binary, doc_ids array<long>, symbols array<long>"
READ = "doc_id long, shard long, at long, n_tokens long, ids_crc32 long"


def is_plain(text: str) -> bool:
    return bool(PLAIN.fullmatch(text)) and "<|" not in text


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, in less time.

    The tokenizer composes characters, turns white space into spaces, lowers letters, splits words and drops spaces, so
    pieces between spaces and line feeds may be encoded on their own. A piece of PLAIN characters changes by nothing
    but lower letters; one pattern splits it into words, which the tokenizer's model encodes. Any other goes through the
    tokenizer as it stands. Ids are held as bytes; the first pieces and words that are met are remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "I" if self.tokenizer.get_vocab_size() > 1 << 16 else "H"
        self.wide = np.dtype(self.kind)
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {k: shown.pre_tokenize_str(chr(k))[0][0] for k in range(33, 256)}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {" ": b""}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def of_words(self, words: list[str]) -> list[bytes]:
        out = list(map(self.words.get, words))
        for k, found in enumerate(out):
            if found is None:
                word = words[k]
                out[k] = self.packed([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.shown))])
                if len(self.words) < WORDS and len(word) <= LONGEST:
                    self.words[word] = out[k]
        return out

    def of_plain(self, pieces: list[str]) -> list[bytes]:
        """What PLAIN pieces give, split together: a space ends each."""
        words = WORD.findall(" ".join(pieces).lower())
        found = self.of_words(words)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        cuts = np.flatnonzero(np.fromiter((w == " " for w in words), bool, len(words)))
        whole, at = b"".join(found), [0, *ends[cuts].tolist(), int(ends[-1]) if len(ends) else 0]
        return [whole[lo:hi] for lo, hi in zip(at, at[1:])]

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        out = list(map(self.pieces.get, pieces))
        new = [k for k, found in enumerate(out) if found is None]
        plain = new
        if not is_plain("".join(pieces[k] for k in new)):
            plain = [k for k in new if is_plain(pieces[k])]
            for k in set(new).difference(plain):
                out[k] = self.packed(self.tokenizer.encode(pieces[k], add_special_tokens=False).ids)
        if plain:
            for k, found in zip(plain, self.of_plain([pieces[k] for k in plain])):
                out[k] = found
        for k in new:
            if len(self.pieces) >= PIECES:
                break
            if len(pieces[k]) <= LONGEST:
                self.pieces[pieces[k]] = out[k]
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, one text after another, and where each text's ids end. Each distinct piece is looked up once."""
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        found = lists.flatten().dictionary_encode()
        packed = self.of_pieces(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, packed), np.int32, len(packed)) // self.wide.itemsize
        held = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)]), pa.array(np.frombuffer(b"".join(packed), dtype=self.wide)))
        ends = np.r_[0, np.cumsum(sizes[found.indices.to_numpy()], dtype=np.int64)]
        return held.take(found.indices).flatten().to_numpy(), ends[np.cumsum(lists.value_lengths().to_numpy())]


def slices(b: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold `most` bytes, or one text."""
    ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < b.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


#: One for each vocabulary that this Python process has met; tasks that run in it one after another share them.
KNOWN: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in KNOWN:
        KNOWN[path] = Encoder(path)
    return KNOWN[path]


def frequent_pairs(key: np.ndarray, least: int) -> np.ndarray:
    """The keys that occur `least` times or more, the most frequent first."""
    key = np.sort(key)
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.r_[begins, len(key)])
    found, n = key[begins[n >= least]], n[n >= least]
    return found[np.argsort(-n, kind="stable")]


def bucket(key: np.ndarray) -> np.ndarray:
    return (key * key.dtype.type(0x9E3779B1)) >> key.dtype.type(10) & key.dtype.type(BUCKETS - 1)


def repair(ids: np.ndarray, base: int, end: int = END, least: int = LEAST_PAIRS, rounds: int = PAIR_ROUNDS, most: int = MOST_RULES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, lengths): frequent pairs replaced by new symbols, round after round, until no pair is frequent or a bound is reached.

    A round takes the most frequent pairs of which none begins as another ends, so their occurrences can't overlap; of
    a run of one symbol every second pair is taken. No pair begins with a symbol that ends a document.
    """
    narrow = base + most <= 1 << 16
    symbol, pair_of, half = (np.uint16, np.uint32, 16) if narrow else (np.uint32, np.uint64, 32)
    seq = ids.astype(symbol)
    rules: list[tuple[int, int]] = []
    lengths: list[int] = []
    ends = np.zeros(base + most, dtype=bool)
    ends[end] = True
    for _ in range(rounds):
        if len(seq) < 2 or len(rules) >= most:
            break
        left, right = seq[:-1], seq[1:]
        key = (left.astype(pair_of) << pair_of(half)) | right
        inner = ~ends[left]
        twins = np.flatnonzero(left == right)
        if len(twins):  # a pair that a pair of the same symbol precedes overlaps it, unless an even number do
            new = np.r_[True, np.diff(twins) > 1]
            begin = twins[np.maximum.accumulate(np.where(new, np.arange(len(twins)), 0))]
            inner[twins[(twins - begin) % 2 == 1]] = False
        begins, finishes = bytearray(base + most), bytearray(base + most)
        chosen = []
        found = frequent_pairs(key[inner], least)
        for pair, a, b in zip(found.tolist(), (found >> pair_of(half)).tolist(), (found & pair_of((1 << half) - 1)).tolist()):
            if not (finishes[a] or begins[b] or a == b and begins[a]):
                begins[a] = finishes[b] = 1
                chosen.append(pair)
                if len(rules) + len(chosen) >= most:
                    break
        if not chosen:
            break
        wanted = np.array(chosen, dtype=pair_of)
        slot = np.zeros(BUCKETS, dtype=np.int32)
        slot[bucket(wanted)[::-1]] = np.arange(len(wanted))[::-1]  # of pairs that meet in a bucket the most frequent is taken, the others wait
        wanted = wanted[slot[bucket(wanted)] == np.arange(len(wanted))]
        slot[bucket(wanted)] = np.arange(len(wanted))
        place = slot[bucket(key)]
        where = np.flatnonzero(inner & (wanted[place] == key))
        place = place[where]
        seq[where] = base + len(rules) + place
        stay = np.ones(len(seq), dtype=bool)
        stay[where + 1] = False
        seq = seq[stay]
        size = lambda s: 1 if s < base else lengths[s - base]
        for a, b in zip((wanted >> pair_of(half)).tolist(), (wanted & pair_of((1 << half) - 1)).tolist()):
            ends[base + len(rules)] = ends[b]
            rules.append((a, b))
            lengths.append(size(a) + size(b))
    return seq, np.array(rules, dtype=np.int64).reshape(-1, 2), np.array(lengths, dtype=np.int64)


class Grammar:
    """A block's rules, whose expansions stand one after another in `ids`; a token id's is itself."""

    def __init__(self, block: dict):
        kind = "<u2" if block["width"] == 2 else "<u4"
        self.base = block["base"]
        self.sequence = np.frombuffer(block["sequence"], dtype=kind)
        rules = np.frombuffer(block["rules"], dtype=kind).reshape(-1, 2).tolist()
        lengths = np.frombuffer(block["lengths"], dtype="<u4").astype(np.int64)
        own: list[np.ndarray] = []
        part = lambda s: np.array([s], dtype="<u4") if s < self.base else own[s - self.base]
        for a, b in rules:
            own.append(np.concatenate([part(a), part(b)]))
        #: Token ids as they are, then what each rule stands for; where each symbol's are, and how many.
        self.ids = np.concatenate([np.arange(self.base, dtype="<u4"), *own])
        self.offset = np.r_[np.arange(self.base), self.base + np.cumsum(lengths) - lengths].astype(np.int32)
        self.sizes = np.r_[np.ones(self.base, dtype=np.int32), lengths.astype(np.int32)]
        #: Ids before each symbol of the sequence, and all of them.
        self.starts = np.r_[0, np.cumsum(self.sizes[self.sequence], dtype=np.int64)]

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(self.offset[symbols] - ends + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at]

    def between(self, lo: int, hi: int) -> np.ndarray:
        """The ids at lo to hi; only the symbols that hold them are expanded."""
        first, last = np.searchsorted(self.starts, lo, side="right") - 1, np.searchsorted(self.starts, hi, side="left")
        ids = self.expanded(self.sequence[max(first, 0) : last])
        return ids[lo - self.starts[max(first, 0)] :][: max(0, hi - lo)]


def block_row(shard: int, number: int, before: int, docs: list[tuple[int, np.ndarray]], base: int, **options) -> dict:
    ids = np.concatenate([d for _, d in docs])
    sequence, rules, lengths = repair(ids, base, **options)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    # documents end where symbols end
    size = np.ones(base + len(rules), dtype=np.int64)
    size[base:] = lengths
    starts = np.r_[0, np.cumsum(size[sequence])]
    at = np.searchsorted(starts, np.cumsum([0, *(len(d) for _, d in docs)]))
    return {
        "shard": shard, "block": number, "before": before, "n_ids": len(ids), "base": base, "width": width, "rules": rules.astype(kind).tobytes(), "lengths": lengths.astype("<u4").tobytes(),
        "sequence": sequence.astype(kind).tobytes(), "doc_ids": [d for d, _ in docs], "symbols": np.diff(at).tolist(),
    }


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Encodes whole texts, appends `end` to each, and writes all ids in ascending doc_id order as files of the format above.

    A null or empty text is the end id alone. Null ids come first; rows of equal ids follow one another, ordered by a
    hash of their text; an empty table gives an empty table; other columns don't matter. Shards are ranges of (doc_id,
    hash, place in the input), so even rows of one id, or wholly equal ones, may lie in several. A task holds a block of
    BLOCK_IDS ids, and the document that fills it, at a time.
    """
    own, names = tokenizer or public_tokenizers.path("word_bpe_49k.json"), [f.split()[0] for f in BLOCKS.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(own), TaskContext.get().partitionId()
        base, mark = encoder.tokenizer.get_vocab_size(), np.array([end], dtype=encoder.wide)
        held: list[tuple[int, np.ndarray]] = []
        number = before = size = 0

        def out() -> pa.RecordBatch:
            nonlocal number, before, size, held
            row = block_row(shard, number, before, held, base, end=end)
            number, before, size, held = number + 1, before + size, 0, []
            return pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in zip(names, kinds)], names=names)

        for b in batches:
            for part in slices(b, 1):
                ids, ends = encoder.of(part.column(1))
                for doc, lo, hi in zip(part.column(0).to_pylist(), np.r_[0, ends], ends):
                    held.append((doc, np.concatenate([ids[lo:hi], mark])))
                    size += int(hi - lo) + 1
                    if size >= BLOCK_IDS:
                        yield out()
        if held:
            yield out()

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    ranged = keyed.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place").select("doc_id", "text")
    ranged.mapInArrow(run, BLOCKS).write.parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def shard_starts(held: DataFrame) -> DataFrame:
    """(shard, first): ids of all shards before each. A row per task that wrote, so a window over all of them stays small."""
    sizes = held.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return sizes.select("shard", F.coalesce(before, F.lit(0)).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from their expanded ids."""
    held, names = blocks(spark, path), [f.split()[0] for f in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                g = Grammar(row)
                ids = g.expanded(g.sequence)
                cuts = g.starts[np.r_[0, np.cumsum(row["symbols"])]]
                crcs = [zlib.crc32(ids[lo:hi].tobytes()) for lo, hi in zip(cuts[:-1], cuts[1:])]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(crcs), row["shard"])), pa.array(row["before"] + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())]
                yield from pa.Table.from_arrays(cols, names=names).to_batches(max_chunksize=20_000)

    read = held.mapInArrow(run, READ)
    return read.join(F.broadcast(shard_starts(held)), "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """(lo, hi, ids) of each row of `ranges` (lo, hi: places among all ids of the files): the ids there, fewer where the files end.

    Blocks that a range touches expand the symbols that hold it, by their expansion lengths, and nothing else.
    """
    held = blocks(spark, path)
    placed = held.join(F.broadcast(shard_starts(held)), "shard").withColumn("first", F.col("first") + F.col("before"))
    asked = ranges.select("lo", "hi").where((F.col("lo") >= 0) & (F.col("hi") > F.col("lo"))).distinct()
    # a block and a range meet in buckets of places, of which either has few
    bucket = lambda lo, hi: F.explode(F.sequence(F.expr(f"{lo} div {BLOCK_IDS}"), F.expr(f"({hi} - 1) div {BLOCK_IDS}")))
    spans = placed.select("shard", "block", "first", (F.col("first") + F.col("n_ids")).alias("last")).withColumn("bucket", bucket("first", "last"))
    met = asked.withColumn("bucket", bucket("lo", "hi")).join(spans, "bucket").where((F.col("lo") < F.col("last")) & (F.col("hi") > F.col("first")))
    wanted = met.select("shard", "block", "lo", "hi", "first").distinct().groupBy("shard", "block", "first").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                g, first = Grammar(row), row["first"]
                for r in row["asked"]:
                    ids = g.between(max(0, r["lo"] - first), min(row["n_ids"], r["hi"] - first))
                    yield pa.RecordBatch.from_arrays([pa.array([r["lo"]]), pa.array([r["hi"]]), pa.array([first]), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["lo", "hi", "first", "ids"])

    found = held.join(wanted, ["shard", "block"]).mapInArrow(run, "lo long, hi long, first long, ids array<long>")
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first", "ids"))), lambda x: x["ids"]))
    return found.groupBy("lo", "hi").agg(joined.alias("ids"))


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents written to files (in the folder all executors share, unless a path is given) and read back from them."""
    path = path or fresh_path(docs.sparkSession, "token-ids")
    write_ids(docs, path)
    return read_documents(docs.sparkSession, path)
