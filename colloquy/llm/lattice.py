"""Subword lattice likelihood: a unigram vocabulary's scores weigh every segmentation of a text.

A text is its words, each with the mark of a word's beginning, and one end. Pieces never reach beyond a word, so a text's
marginal probability is the product of its words'. For a word, the forward recursion in log space sums over all ways to
put it together from pieces of the vocabulary; letters that no piece has are spelled by the pieces of their bytes. A word
of the training texts is an arc of its own beside those ways: P(word) = (c + u * P(pieces)) / (N + u), where c is the
word's count, N that of all tokens and u the number of distinct ones.

The vocabulary's scores are those of a byte-pair merge list: minus the rank, 0 to -31,740. As logarithms they would give
the second piece a third of the first one's weight and the hundredth e^-100 of it, which is no distribution that text
follows. So they serve as what they are, ranks, which a law of 1 / (2.7 + rank) turns into the first weights; rounds of
expectation and maximisation then fit the weights, the tokenizer's pieces staying as they are. The pieces only have to
tell how likely a word is that training texts don't have, so every distinct training word weighs the same in fitting,
however often it occurs: new words resemble the list of words, not running text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import crc_mod, written

MARK = "▁"
#: Words longer than this (with their mark) go through the recursion one at a time, the others by length, many at once.
LONG = 48
ROUNDS = 2
#: Tokens' worth of the vocabulary's own weights that the fitted ones keep.
PRIOR = 1000.0
#: The rank from which the vocabulary's weights fall as one over the rank.
FLAT = 2.7
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary's pieces, found by a rolling hash of their letters."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, spell, names = [], {}, {}
        for k in range(model.get_piece_size()):
            scores.append(model.get_score(k))
            name = model.id_to_piece(k)
            if model.is_byte(k):
                spell[int(name[1:-1], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                names[name] = k
        rank = np.empty(len(scores))
        rank[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(scores))
        self.start = 1.0 / (FLAT + rank)  # the scores say an order, which such a law turns into shares
        self.start /= self.start.sum()
        self.names, self.spell = names, spell
        self.longest = max(map(len, names))
        hashes = {hash_of(n): k for n, k in names.items()}
        self.keys = np.array(sorted(hashes), dtype=np.uint64)
        self.ids = np.array([hashes[int(k)] for k in self.keys], dtype=np.int64)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.letters = np.sort(np.array([ord(n) for n in names if len(n) == 1], dtype=np.uint32))

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids) of the keys that are pieces."""
        some = np.flatnonzero(self.maybe[(keys >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[at] == keys[some]
        return some[hit], self.ids[at[hit]]


def hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
    return h


def forward_backward(words: list[str], pieces: Pieces, logp: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(natural log of each word's marginal probability, expected uses of each piece over all words, if counts are given)."""
    out = np.empty(len(words))
    used = np.zeros(len(logp))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    by = np.argsort(sizes, kind="stable")
    for some in np.split(by, np.flatnonzero(np.diff(sizes[by])) + 1) if len(by) else ():
        n = int(sizes[some[0]])
        if n > LONG:
            for k in some:
                out[k] = one_by_one(words[k], pieces, logp, used, counts[k] if counts is not None else None)
            continue
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            text = MARK + MARK.join(words[k] for k in part)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(part), n)
            out[part] = same_length(codes, pieces, logp, used, counts[part] if counts is not None else None)
    return out, used


def same_length(codes: np.ndarray, pieces: Pieces, logp: np.ndarray, used: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    m, n = codes.shape
    sums = [np.zeros(m, dtype=np.uint64)]
    for j in range(n):
        sums.append(sums[-1] * BASE + codes[:, j].astype(np.uint64) + np.uint64(1))
    powers = [np.uint64(1)]
    for _ in range(n):
        powers.append(np.uint64(int(powers[-1]) * int(BASE) & (2**64 - 1)))
    alpha = [np.zeros(m)] + [np.full(m, -np.inf) for _ in range(n)]
    arcs = []
    for j in range(1, n + 1):
        for i in range(max(0, j - pieces.longest), j):
            at, ids = pieces.lookup(sums[j] - sums[i] * powers[j - i])
            if len(at):
                alpha[j][at] = np.logaddexp(alpha[j][at], alpha[i][at] + logp[ids])
                arcs.append((i, j, at, ids))
        letters = codes[:, j - 1]
        known = pieces.letters[np.minimum(np.searchsorted(pieces.letters, letters), len(pieces.letters) - 1)] == letters
        for k in np.flatnonzero(~known):  # spelled by its bytes
            ids = np.array([pieces.spell[b] for b in chr(int(letters[k])).encode("utf-8", "surrogatepass")])
            alpha[j][k] = np.logaddexp(alpha[j][k], alpha[j - 1][k] + logp[ids].sum())
            arcs.append((j - 1, j, np.array([k]), ids))
    if counts is not None:
        beta = [np.full(m, -np.inf) for _ in range(n)] + [np.zeros(m)]
        for i, j, at, ids in reversed(arcs):
            spelled = len(ids) != len(at)
            step = logp[ids].sum() if spelled else logp[ids]
            share = np.exp(alpha[i][at] + step + beta[j][at] - alpha[n][at]) * counts[at]
            beta[i][at] = np.logaddexp(beta[i][at], step + beta[j][at])
            used += np.bincount(ids, weights=np.full(len(ids), share[0]) if spelled else share, minlength=len(used))
    return alpha[n]


def one_by_one(word: str, pieces: Pieces, logp: np.ndarray, used: np.ndarray, count: float | None) -> float:
    """The same recursions for one word, letter by letter."""
    text = MARK + word
    n = len(text)
    weight = logp.tolist()
    alpha = [0.0] + [-math.inf] * n
    arcs: list[tuple[int, int, list[int], float]] = []
    for j in range(1, n + 1):
        first = len(arcs)
        for i in range(max(0, j - pieces.longest), j):
            k = pieces.names.get(text[i:j])
            if k is not None:
                arcs.append((i, j, [k], weight[k]))
        if text[j - 1] not in pieces.names:
            ids = [pieces.spell[b] for b in text[j - 1].encode("utf-8", "surrogatepass")]
            arcs.append((j - 1, j, ids, sum(weight[k] for k in ids)))
        alpha[j] = log_sum([alpha[i] + step for i, _, _, step in arcs[first:]])
    if count:
        beta = [-math.inf] * n + [0.0]
        for i, j, ids, step in reversed(arcs):
            share = math.exp(min(alpha[i] + step + beta[j] - alpha[n], 0.0)) * count
            beta[i] = log_sum([beta[i], step + beta[j]])
            for k in ids:
                used[k] += share
    return alpha[n]


def log_sum(x: list[float]) -> float:
    top = max(x, default=-math.inf)
    return top + math.log(sum(math.exp(v - top) for v in x)) if top > -math.inf else top


def text_words(text: str) -> Iterator[bytes]:
    """Words of a text, A-Z in lower case; very long texts in stretches that end at white space."""
    data = text.encode("utf-8", "replace").lower()
    if len(data) < 1 << 22:
        return iter(data.split())
    def stretches() -> Iterator[list[bytes]]:
        lo = 0
        while lo < len(data):
            hi = min(len(data), lo + (1 << 20))
            while hi < len(data) and data[hi] not in b" \t\n\v\f\r":
                hi += 1
            yield data[lo:hi].split()
            lo = hi
    return chain.from_iterable(stretches())


def trains(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i in ids], dtype=bool)


def decoded(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words]


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log weights of the vocabulary's pieces, fitted to the distinct words (column word); a round adds up a row per piece."""
    own = weights = Pieces(path).start
    for _ in range(rounds):
        logp = np.log(weights)

        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            pieces, used = Pieces(path), np.zeros(len(logp))
            for b in batches:
                found = decoded(b.column(0).to_pylist())
                used += forward_backward(found, pieces, logp, np.ones(len(found)))[1]
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(used[at])], names=["piece", "used"])

        found = words.select("word").mapInArrow(expect, "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect()
        used = np.zeros(len(own))
        for piece, n in found:
            used[piece] = n
        weights = (used + PRIOR * own) / (used.sum() + PRIOR)
    return np.log(weights)


def mixed(counts: np.ndarray, logs: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of each word's probability from its count and the natural log of its marginal, which may be far below what a double holds."""
    if not n:
        return logs / np.log(10)
    with np.errstate(divide="ignore"):
        return (np.logaddexp(np.log(counts), np.log(v) + logs) - np.log(n + v)) / np.log(10)


def sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of each of the runs that x consists of, some of which may be empty."""
    out = np.zeros(len(size))
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(x, (np.cumsum(size) - size)[some], dtype=float)
    return out


def word_scores(counts: DataFrame, path: str, weights, n: int, v: int) -> DataFrame:
    """(word, c, p): each distinct word's training count and the log10 of its probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            logs = forward_backward(decoded(b.column("word").to_pylist()), pieces, weights.value)[0]
            p = mixed(b.column("c").to_numpy(), logs, n, v)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(p)], names=["word", "c", "p"])

    return counts.select("word", "c").mapInArrow(run, "word binary, c long, p double")


def score_texts(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """OUT for each document: what the base and the lattice make of its whole text.

    Learns from documents whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as the empty text). A null or
    empty text is the end alone; rows with equal ids are each counted and scored; with nothing to learn from, the weights
    are the vocabulary's own; an empty table gives an empty result; other columns don't matter. A score stays finite
    however long a word is.

    Words are counted by one shuffle, joined back to the blocks they stand in by a second, and summed up by document
    after a third, by block.
    """
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    rows = written(exchange.word_rows(docs, lambda: text_words, trains), "words")
    counts = written(rows.where(~exchange.is_block()).groupBy("word").agg(F.sum("known").alias("c")), "counts")
    learnt = counts.where(F.col("c") > 0)
    n, v = learnt.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = docs.where(crc_mod("doc_id", 7) != 2).count()
    n, v = n + ends, v + bool(ends)
    weights = docs.sparkSession.sparkContext.broadcast(fit(learnt, path, rounds))  # one number for each piece of the vocabulary

    def finish(ids: list, size: np.ndarray, places: np.ndarray, words: pa.Table) -> dict:
        c, p = words["c"].to_numpy(), words["p"].to_numpy()
        add = lambda x: sums(x[places], size)
        tokens = size + 1
        end = np.log10((ends + 1) / (n + v)) if n else 0.0
        return {
            "doc_id": ids, "held_out": ~trains(ids), "n_tokens": tokens, "n_known": add(c > 0).round().astype(np.int64) + bool(ends), "train_tokens": np.full(len(ids), n),
            "base_score": add(np.log10(c + 1.0)) + np.log10(ends + 1) - tokens * np.log10(n + v + 1), "score": add(p) + end,
        }

    block, place = F.shiftright("at", exchange.PLACE).alias("block"), F.col("at").alias("place")
    told = rows.where(~exchange.is_block()).select(block, place, "word").join(word_scores(counts, path, weights, n, v), "word").select("block", "place", "c", "p")
    own = rows.where(exchange.is_block()).select(block, place, F.col("word").alias("data"))
    return exchange.in_blocks(told.unionByName(own, allowMissingColumns=True), finish, OUT)
