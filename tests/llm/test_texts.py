"""Packing, BPE, SimHash, fingerprints and language-model scores against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import bpe, fingerprints, lattice, packing, simhash
from colloquy.llm.tokens import ranks

from .helpers import LONG, documents, empty, table


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["given", "odd"])
def docs(spark, request):
    return table(spark, "documents") if request.param == "given" else documents(spark)


def test_packing(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in pairs(docs):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        want[doc, len(ids), zlib.crc32(ids.tobytes()) if len(ids) <= 2048 else None] += 1
    rows = packing.pack(docs).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    used = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        used += at if not at & (at - 1) else 2048
    texts: dict = defaultdict(list)  # every id in exactly one piece: pieces of a document follow one another and say its ids
    for doc, text in pairs(docs):
        texts[doc].append(np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == texts.keys()
    for doc, own in texts.items():
        if len(own) == 1:
            at = 0
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(own[0])) and r.ids_crc32 == zlib.crc32(own[0][at : at + r.length].tobytes())
                at += r.length
            assert at == len(own[0])
    total = sum(r.length for r in rows)
    assert total == sum(n * c for (_, n, _), c in want.items())
    assert used / total < 1.02
    spans = defaultdict(int)
    for r in rows:
        spans[r.doc_id, r.doc_tokens] += r.length
        if r.length == r.doc_tokens <= 2048:
            assert want[r.doc_id, r.doc_tokens, r.ids_crc32]
    for (doc, n, _), c in want.items():
        assert spans[doc, n] % n == 0 and spans[doc, n] >= n * c


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []

    def plain(lengths, window):
        out, free = [], []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [f for f in free if f >= lengths[k]]
            if fits:
                at = max(w for w, f in enumerate(free) if f == min(fits))
            else:
                at = len(out)
                out.append([])
                free.append(window)
            out[at].append(k)
            free[at] -= lengths[k]
        return sorted(map(len, out)), sorted(free)

    for seed in range(20):
        lengths = np.random.default_rng(seed).integers(1, 65, 80).tolist()
        got = packing.best_fit(lengths, 64)
        assert (sorted(map(len, got)), sorted(64 - sum(lengths[k] for k in w) for w in got))[1] == plain(lengths, 64)[1]
    lengths = np.random.default_rng(1).integers(1, 2049, 500).tolist()
    assert sorted(k for w in packing.best_fit(lengths) for k in w) == list(range(500))


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for doc, text in pairs(docs):
        ids = whole.encode_ordinary(text)
        want[doc, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(text.encode())] += 1
    assert Counter(map(tuple, bpe.bpe_query(docs).collect())) == want
    got = bpe.encode(docs.where("length(text) < 1000")).collect()
    assert all(whole.decode(r.ids) == r.text for r in got)


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def roots(fps, radius=3):
    left, out = set(fps), {}
    while left:
        root = todo = [left.pop()]
        todo = list(root)
        while todo:
            x = todo.pop()
            out[x] = root[0]
            near = [y for y in left if (x ^ y).bit_count() <= radius]
            left.difference_update(near)
            todo += near
    return out


def test_near_duplicates(docs):
    fps = [(doc, plain_fingerprint(text)) for doc, text in pairs(docs)]
    root = roots({fp for _, fp in fps})
    least = {}
    for doc, fp in fps:
        if doc is not None:
            least[root[fp]] = min(doc, least.get(root[fp], doc))
    want = Counter((doc, f"{fp:016x}", least.get(root[fp])) for doc, fp in fps)
    assert Counter(map(tuple, simhash.near_duplicate_query(docs).collect())) == want


def test_links_of_a_crowded_key(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**16, 300, dtype=np.uint64)  # all alike in most blocks
    fps = sorted({int(x) for x in np.concatenate([base, base ^ np.uint64(1) << np.uint64(40), base ^ np.uint64(7) << np.uint64(20)])})
    monkeypatch.setattr(simhash, "MOST", 50)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    own = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    want = roots(fps)
    group = lambda root: sorted(map(sorted, {k: [x for x in fps if root.get(x, x) == k] for k in {root.get(x, x) for x in fps}}.values()))
    assert group(own) == group(want)


def test_keep_one(spark):
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 6), (False, 7), (False, 8), (False, 10), (True, 0)]


def test_keep_one_of_rows_without_an_id_and_of_clashing_ids(spark):
    rows = [(None, "alpha one"), (None, "ALPHA  one"), (None, "alpha one"), (5, "beta two"), (None, "Beta two"), (7, "gamma three"), (7, "delta four"), (3, "epsilon five"), (7, "EPSILON five"), (None, None), (None, " "), (8, "zeta six"), (8, "zeta six"), (8, "Zeta six")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, digest string")
    kept = Counter((r.doc_id, (r.text or "").lower().strip().replace("  ", " ")) for r in simhash.keep_one(docs).collect())
    assert kept == Counter([(None, "alpha one"), (5, "beta two"), (7, "gamma three"), (7, "delta four"), (3, "epsilon five"), (None, ""), (8, "zeta six")])


def plain_simhash(text):
    """Weighted votes of the pairs of neighbouring words, by whole numbers and one bit after another."""
    m = 2**64 - 1
    h = [1, *(xxhash.xxh64_intdigest(w) for w in "".join(c.lower() if c.isascii() else c for c in text).encode().split()), 2]
    counts = Counter()
    for a, b in zip(h, h[1:]):
        x = (a * 0x9E3779B97F4A7C15 + ((b ^ b >> 29) * 0xBF58476D1CE4E5B9)) & m
        x = ((x ^ x >> 32) * 0x94D049BB133111EB) & m
        counts[x ^ x >> 29] += 1
    weight = {x: 1 + math.log2(n) for x, n in counts.items()}
    votes = [sum(w if x >> b & 1 else -w for x, w in weight.items()) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 1e-9), {b for b in range(64) if abs(votes[b]) < 1e-2}


@pytest.mark.parametrize("ranges", [None, 37])
def test_fingerprints(spark, docs, ranges):
    docs = docs.where("length(text) < 20000 or text is null")
    rows = pairs(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(F.col("doc_id").desc_nulls_last(), "h"))
    got = fingerprints.fingerprint_query(docs, ranges=ranges).collect()
    assert len(got) == len(rows)
    want, own = Counter(), {}
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        e = text[: len(text) - n] + following[:n]
        digest = hashlib.sha256(e.encode()).hexdigest()
        want[doc, len(text), digest] += 1
        own[digest] = text, e, following
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    like = lambda x: max(0.0, math.cos(math.pi * x.bit_count() / 64))
    for r in got[:: max(1, len(got) // 150)]:
        text, e, following = own[r.edited_sha256]
        a, b = int(r.fingerprint, 16), int(r.edited_fingerprint, 16)
        for value, t in ((a, text), (b, e)):
            plain, even = plain_simhash(t)
            assert all((value ^ plain) >> k & 1 == 0 for k in range(64) if k not in even)
        assert math.isclose(r.near_edited, like(a ^ b), abs_tol=1e-12)
        if r.n_chars > 0:
            theirs = {int(g.fingerprint, 16) for g in got if g.n_chars == len(following)}
            assert any(math.isclose(r.near_next, like(a ^ x), abs_tol=1e-12) for x in theirs)
    fps = [int(r.fingerprint, 16) for r in got]
    for r in got:
        asked = r.doc_id is not None and r.doc_id % 20 == 0
        assert r.n_near == (sum((int(r.fingerprint, 16) ^ x).bit_count() <= 3 for x in fps) - 1 if asked else None)


def test_edited_texts_are_nearer_than_others(spark):
    got = fingerprints.fingerprint_query(table(spark, "documents").where("length(text) > 300")).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.9


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_within_radius(spark, radius):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 40)
    fps = [(k, int(x) ^ int(sum(1 << int(b) for b in rng.choice(62, k % 6, replace=False)))) for k, x in enumerate(np.repeat(base, 5))]
    fps += [(500, fps[0][1]), (500, fps[0][1])]  # ties and repeated rows
    df = spark.createDataFrame([(*r, 7) for r in [*fps, (999, None)]], "doc_id long, fp long, distance int")
    got = Counter(tuple(r) for r in fingerprints.within_radius(df.withColumnRenamed("doc_id", "query_id"), df, radius).collect())
    assert got == Counter((a, b, n) for a, x in fps for b, y in fps if (n := ((x ^ y) & (2**64 - 1)).bit_count()) <= radius)
    assert fingerprints.within_radius(empty(df).withColumnRenamed("doc_id", "query_id"), df, radius).collect() == []


def test_base_scores(docs):
    texts = pairs(docs)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    tokens = lambda t: [*"".join(c.lower() if c.isascii() else c for c in t).encode().split(), None]
    counts = Counter(w for d, t in texts if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in texts:
        own = tokens(t)
        want[d, held(d), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 3)] += 1
    got = lattice.score_texts(docs, rounds=1).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_fitting_raises_the_probability_of_held_out_texts(spark):
    docs = table(spark, "documents")
    total = lambda rounds: lattice.score_texts(docs, rounds=rounds).where("held_out").agg(F.sum("score")).first()[0]
    assert total(2) > total(0)


def test_lattice_sums_over_all_segmentations():
    pieces = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    logp = np.log(pieces.start)

    def ways(text):
        if not text:
            return 1.0
        total = 0.0
        for n in range(1, len(text) + 1):
            k = pieces.names.get(text[:n])
            if k is not None:
                total += math.exp(logp[k]) * ways(text[n:])
        if text[0] not in pieces.names:
            total += math.exp(sum(logp[pieces.spell[b]] for b in text[0].encode())) * ways(text[1:])
        return total

    words = ["the", "hello", "xq", "日本", "naïve", "ꙮa", "ab" * 30]
    got, used = lattice.forward_backward(words, pieces, logp, np.ones(len(words)))
    for word, value in zip(words[:-1], got):
        assert math.isclose(value, math.log(ways(lattice.MARK + word)), rel_tol=1e-9)
    assert math.isfinite(got[-1]) and used.sum() > 0


def test_improbable_words_keep_scores_finite(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    seen = [(k, "the cat sat on the mat", "x") for k in range(200) if k not in held][:20]
    letters = np.random.default_rng(3).integers(0, 26, 2000)
    long = "".join(chr(97 + int(k)) for k in letters)
    odd = ["the cat", long, "", "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ" * 20, "", "the mat sat", f"the {long} cat", "on the mat"]
    docs = spark.createDataFrame([*seen, *((k, t, "x") for k, t in zip(held, odd))], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r for r in lattice.score_texts(docs, rounds=0).collect()}
    words = [w for _, t, _ in seen for w in [*t.split(), None]]
    counts, n, v = Counter(words), len(words), len(set(words))
    pieces = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for k, text in zip(held, odd):
        own = text.split()
        logs = lattice.forward_backward(own, pieces, np.log(pieces.start))[0]
        assert all(x < -745 for w, x in zip(own, logs) if len(w) > 50)
        want = math.log10((counts[None] + 1) / (n + v))
        for w, x in zip(own, logs):
            want += math.log10((counts[w] + v * math.exp(x)) / (n + v)) if counts[w] else (x + math.log(v / (n + v))) / math.log(10)
        assert math.isclose(got[k].score, want, rel_tol=1e-5)


@pytest.mark.parametrize("operator", [packing.pack, bpe.bpe_query, simhash.near_duplicate_query, fingerprints.fingerprint_query, lattice.score_texts])
def test_empty_tables(spark, operator):
    assert operator(empty(documents(spark))).collect() == []


def test_long_texts_are_read_whole(spark):
    docs = spark.createDataFrame([(1, LONG + "a"), (2, LONG + "b")], "doc_id long, text string")
    assert len({r.ids_sha256 for r in bpe.bpe_query(docs).collect()}) == 2
    assert docs.agg(F.max(F.length("text"))).first()[0] == len(LONG) + 1
