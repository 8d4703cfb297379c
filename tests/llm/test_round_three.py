"""Source divergence, centroid clustering and token files against SQL and plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import centroids, divergence, grammar
from tests.oracle import database, differences

from .helpers import SF, documents, empty, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def over(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con, sql


def plain_divergence(rows, least, top=50):
    """(lang, source, text) rows, by the definition."""
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(a or "", b or "", words(t)) for a, b, t in rows]
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    for lang in {r[0] for r in rows}:
        had = Counter(w for a, _, t in rows if a == lang for w in set(t))
        kept = sorted((w for w, n in had.items() if n >= least), key=str.encode)
        n = {}
        for a, b, t in rows:
            if a == lang:
                n.setdefault(b, Counter()).update(w for w in t if had[w] >= least)
        whole = sum(n.values(), Counter())
        p = {b: {w: share(c[w], sum(c.values()), len(kept)) for w in kept} for b, c in n.items()}
        q = {w: share(whole[w], sum(whole.values()), len(kept)) for w in kept}
        for b in n:
            pairs = [(sum(abs(p[b][w] - p[o][w]) for w in kept), o) for o in n if o != b]
            terms = [(p[b][w] - q[w], w) for w in kept if n[b][w] and p[b][w] > q[w]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                out += [(lang, b, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
    return sorted(out)


def test_divergence_against_sql(spark):
    assert differences(divergence.source_divergence(table(spark, "documents")), database(SF), divergence.DIVERGENCE_SQL) is None


@pytest.mark.parametrize("least", [1, 2, 100])
def test_divergence_of_odd_rows(spark, monkeypatch, least):
    monkeypatch.setattr(divergence, "CHUNK_ROWS", 5)
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 3)
    monkeypatch.setattr(divergence, "CELLS", 7)
    monkeypatch.setattr(divergence, "ENTRIES", 4)
    more = [(k, t, lang, s) for k, (t, lang, s) in enumerate([("Ünï ÜNï b\x7fc a\x00a É é", "en", "b"), ("zz zz a 😀 ｚ", "en", "c"), ("", "de", "a"), (None, "de", "b"), ("nur hier", "fr", "x"), ("a b", "en", ""), ("a b", "en", None)])]
    docs = documents(spark).select("doc_id", "text", "lang", "source", "score").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = sorted(map(tuple, divergence.source_divergence(docs, least).collect()))
    assert got == plain_divergence([(r.lang, r.source, r.text) for r in docs.collect()], least)
    assert divergence.source_divergence(empty(docs), least).collect() == []


def test_shares_are_exact_where_products_pass_a_long():
    n = np.array([[0, 1, 10**13, 9 * 10**15 - 1], [3, 3, 3, 3]], dtype=np.int64)
    total = n.sum(axis=1)
    want = [[1 + 10**9 * (int(c) + 5) // (int(t) + 20) for c in row] for row, t in zip(n, total)]
    assert divergence.shares(n, total[:, None], 4).tolist() == want
    assert divergence.shares(np.array([[7]]), np.array([[7]]), 1).tolist() == [[1 + 10**9]]


def test_clusters_against_sql(spark):
    assert differences(centroids.clustered(table(spark, "embeddings")), database(SF), centroids.CLUSTER_SQL) is None


def plain_clusters(vectors, k=16, rounds=3):
    own = [(i, [int(np.floor(64 * float(c))) for c in x]) for i, x in vectors if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x)]
    h = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    at = [list(x) for _, x in sorted(((h(i), x) for i, x in own))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        by = {}
        for _, x in own:
            by.setdefault(near(x)[1], []).append(x)
        at = [[sum(c) // len(by[j]) for c in zip(*by[j])] if j in by else c for j, c in enumerate(at)]
    found = [(i, *near(x)) for i, x in own]
    sums = Counter()
    for _, d, j in found:
        sums[j] += d
    cut = lambda v: min(v, 2**63 - 1)
    return sorted(((i, j, cut(d), cut(sums[j]), cut(sum(sums.values())), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def odd_vectors(spark, big=1.0):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.integers(-3, 4, 64) * (big if k % 7 == 0 else 1.0)).tolist()) for k in range(60)]
    rows += rows[:5] + [(3, rows[8][1]), (None, rows[9][1]), (None, rows[1][1])] + [(k, [0.25] * 64) for k in range(200, 230)]
    rows += [(100, None), (101, [1.0] * 63), (102, [None] + [1.0] * 63), (103, [float("nan")] * 64), (104, [float("inf")] + [0.0] * 63), (105, []), (106, [1.0] * 65)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, x int"), rows


@pytest.mark.parametrize("big", [1.0, 3e8, 5e15])
def test_clusters_of_odd_vectors(spark, big):
    """Large components leave longs: sums and distances stay exact, and what passes a long counts as the largest."""
    df, rows = odd_vectors(spark, big)
    got = sorted(map(tuple, centroids.clustered(df).collect()), key=repr)
    assert got == plain_clusters(rows)
    assert centroids.clustered(empty(df)).collect() == [] and centroids.clustered(empty(df)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = df.where("vec_id in (1, 2, 102)")
    assert sorted(map(tuple, centroids.clustered(few).collect()), key=repr) == plain_clusters([r for r in rows if r[0] in (1, 2, 102)])


def test_block_norms_pass_over_centroids():
    """Where energy lies in different blocks, few centroids are left; bounds never pass the distance."""
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (400, 64))
    for k in range(400):
        x[k, 8 * (k % 8) : 8 * (k % 8) + 8] += 200
    at = [x[k].tolist() for k in range(8)]
    s = centroids.Screen(at)
    c, d = s.nearest(x, centroids.block_norms(x))
    away = ((x[:, None] - np.array(at)[None]) ** 2).sum(axis=2)
    assert (c == away.argmin(axis=1)).all() and (d == away.min(axis=1)).all()
    assert s.taken < 0.2 * s.seen and (s.bounds(centroids.block_norms(x)) <= away).all()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("which", ["given", "odd", "small"])
def test_token_files(spark, tokenizer, monkeypatch, tmp_path, which):
    docs = documents(spark) if which == "odd" else table(spark, "documents", "/root/testdata/sf0.001" if which == "small" else SF)
    if which != "given":
        monkeypatch.setattr(grammar, "BLOCK_IDS", 3000)
    path = str(tmp_path / "ids")
    got = grammar.token_files(docs, path).collect()
    # rows of one id may stand in either order
    own = sorted(((r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for i, x in own)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    if which == "odd":
        assert grammar.token_files(empty(docs)).collect() == []
        return
    flat = [k for _, x in own for k in x]
    ranges = [(0, 1), (5, 4000), (2990, 3010), (len(flat) - 3, len(flat) + 9), (len(flat) + 1, len(flat) + 2), (0, len(flat)), (7, 7)]
    asked = spark.createDataFrame(ranges + ranges[:1], "lo long, hi long")
    found = {(r.lo, r.hi): r.ids for r in grammar.read_ranges(spark, path, asked).collect()}
    assert found == {(lo, hi): flat[lo:hi] for lo, hi in ranges if flat[lo:hi]}
    sizes = grammar.blocks(spark, path).selectExpr("sum(length(sequence) + length(rules) + length(lengths)) as n").first().n
    assert which == "small" or sizes < 2 * 0.75 * len(flat)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAB'sStTreRE 0129.,!?-|<>\n\t\r éÉßÆæÿŒœİıΣσς́̈ﬁ你😀ªº×«»  \x1c\x85\x00~")), max_size=40))
def test_encoder_equals_the_tokenizer(tokenizer, text):
    texts = [text, text + "<|endoftext|>" + text, None, "We're I'LL'd " + text, "", text]
    ids, ends = grammar.encoder_of(WORD_BPE).of(pa.array(texts, pa.string()))
    assert [ids[lo:hi].tolist() for lo, hi in zip([0, *ends], ends)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(2, 5), max_size=60), min_size=1, max_size=6), st.sampled_from([60_000, 6, 70_000]))
def test_grammar_gives_the_ids_back(docs, base):
    held = [(k, np.array([*d, 1])) for k, d in enumerate(docs)]
    row = grammar.block_row(3, 0, 0, held, base, least=2, most=500)
    g = grammar.Grammar(row)
    flat = [k for d in docs for k in (*d, 1)]
    assert g.expanded(g.sequence).tolist() == flat and row["width"] == (4 if base == 70_000 else 2)
    cuts = g.starts[np.r_[0, np.cumsum(row["symbols"])]]
    assert np.diff(cuts).tolist() == [len(d) + 1 for d in docs]
    for lo in range(0, len(flat), 7):
        assert g.between(lo, lo + 11).tolist() == flat[lo : lo + 11]


def test_frequent_pairs_become_rules():
    seq, rules, lengths = grammar.repair(np.array([7, 8, 9] * 100 + [5] * 33 + [1]), 10, least=2, rounds=12, most=100)
    assert len(seq) < 20 and lengths.max() >= 32 and rules[0].tolist() in ([7, 8], [5, 5])
    assert not any(len(x) for x in grammar.repair(np.array([], dtype=int), 10)[1:])
