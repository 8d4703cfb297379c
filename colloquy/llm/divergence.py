"""How the sources of a language differ in their words: exact distances between sources, and each source's own terms.

Words are counted by input partition and summed in Spark. Ranges of (language, term) in UTF-8 order then become chunks:
a sorted array of kept terms, whose places are the terms' ids, and the counts of each source under those ids. Chunks of
a language are compared as dense vectors, one chunk after another, and what they give is summed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import spread_join, written

LEAST_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
#: Distinct (group, term) entries that a task counts before it hands them on.
ENTRIES = 300_000
#: Rows of (source, term) and terms that a chunk holds about, and cells of a dense block at most.
CHUNK_ROWS, CHUNK_TERMS, CELLS = 100_000, 4096, 1 << 21
#: Bytes that part terms (0-64, 91-96 and 123-127 become a space); A-Z become a-z; what lies above ASCII stays.
WORD_BYTES = bytes(k + 32 if 65 <= k <= 90 else 32 if k < 65 or 90 < k < 97 or 122 < k < 128 else k for k in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
CHUNKS = "lang string, chunk long, terms array<string>, sources array<string>, at array<int>, id array<int>, n array<long>"
FOUND = "lang string, source string, part string, item string, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row with the empty term for each group."""
    names = [f.split()[0] for f in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Counter] = defaultdict(Counter)
        had: dict[tuple, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in seen.items():
                terms, docs_of = list(counts), had[lang, source]
                cols = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64()), pa.array(map(docs_of.__getitem__, terms), pa.int64())]
                yield from pa.Table.from_arrays(cols, names=names).to_batches(max_chunksize=20_000)
            seen.clear()
            had.clear()

        for b in batches:
            texts = b.column(2).cast(pa.binary())
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
                words = (text.as_py() or b"").translate(WORD_BYTES).split()
                key = lang or "", source or ""
                seen[key].update(words)
                seen[key][b""] += 0
                had[key].update({*words, b""})
            if sum(map(len, seen.values())) > ENTRIES:
                yield from out()
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chunks_of(lang: str, terms: np.ndarray, sources: list[str], n: np.ndarray, docs: np.ndarray, least_docs: int, most: int) -> Iterator[tuple]:
    """Chunks, of `most` terms at most, of rows of one language that hold all rows of their terms, sorted by term."""
    new = np.ones(len(terms), dtype=bool)
    new[1:] = terms[1:] != terms[:-1]
    place = np.cumsum(new) - 1
    kept = terms[new][np.bincount(place, weights=docs) >= least_docs]
    for lo in range(0, len(kept), most):
        own = kept[lo : lo + most]
        ids = np.searchsorted(own, terms)
        mine = np.flatnonzero(own[np.minimum(ids, len(own) - 1)] == terms)
        of = [sources[k] for k in mine]
        names = sorted(set(of))
        at = {s: k for k, s in enumerate(names)}
        yield lang, own.tolist(), names, [at[s] for s in of], ids[mine].tolist(), n[mine].tolist()


def term_chunks(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Chunks of the terms that a language keeps, in UTF-8 order: sorted terms, and counts by source and id of a term."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Chunks of all rows held, but for those of the last term, which may go on."""
            nonlocal number, held
            t = pa.Table.from_batches(held).combine_chunks()
            langs, terms = (np.array(t.column(k).to_pylist(), dtype=object) for k in ("lang", "term"))
            end = len(terms)
            if not last:
                while end and terms[end - 1] == terms[-1] and langs[end - 1] == langs[-1]:
                    end -= 1
            held = t.slice(end).to_batches() if end < len(terms) else []
            starts = np.flatnonzero(np.r_[True, langs[1:end] != langs[: end - 1]]) if end else np.array([], dtype=int)
            n, docs, sources = t.column("n").to_numpy(), t.column("docs").to_numpy(), t.column("source").to_pylist()
            for lo, hi in zip(starts, [*starts[1:], end]):
                for lang, *rest in chunks_of(langs[lo], terms[lo:hi], sources[lo:hi], n[lo:hi], docs[lo:hi], least_docs, CHUNK_TERMS):
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((lang, number, *rest), kinds)], names=names)
                    number += 1

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK_ROWS:
                yield from cut(False)
        if held:
            yield from cut(True)

    ranged = counts.where(F.col("term") != "").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return ranged.mapInArrow(run, CHUNKS)


def shares(counts: np.ndarray, totals, terms: int, smooth: int = SMOOTH) -> np.ndarray:
    """1 + floor(10^9 (count + smooth) / (total + smooth terms)), exact: a long division by three digits at a time, as 10^9 times a count may pass a long."""
    whole = np.asarray(totals) + smooth * terms
    if np.max(whole, initial=0) > np.iinfo(np.int64).max // 1000:
        counts, whole = counts.astype(object), whole.astype(object)
    out, rest = np.zeros_like(counts), counts + smooth
    for _ in range(3):
        digits, rest = rest * 1000 // whole, rest * 1000 % whole
        out = out * 1000 + digits
    # the share of a language's only term is 1, whose digits are 1000, 0 and 0, and add up all the same
    return (1 + out).astype(np.int64)


def compared(chunk: dict, names: list[str], totals: np.ndarray, terms: int, top: int, cells: int) -> Iterator[tuple]:
    """(source, part, item, value) of a chunk: parts of the distance of each two sources, and the terms that may be among a source's first."""
    place = np.searchsorted(np.array(names, dtype=object), np.array(chunk["sources"], dtype=object)) if chunk["sources"] else np.array([], dtype=int)
    rows, ids, n = place[np.array(chunk["at"], dtype=int)], np.array(chunk["id"], dtype=int), np.array(chunk["n"], dtype=np.int64)
    size, width = len(names), max(1, cells // len(names))
    first, second = np.triu_indices(size, 1)
    between = np.zeros(len(first), dtype=np.int64)
    for lo in range(0, len(chunk["terms"]), width):
        own = chunk["terms"][lo : lo + width]
        k = (ids >= lo) & (ids < lo + len(own))
        dense = np.zeros((size, len(own)), dtype=np.int64)
        dense[rows[k], ids[k] - lo] = n[k]
        p, q = shares(dense, totals[:, None], terms), shares(dense.sum(axis=0), totals.sum(), terms)
        at = 0
        for a in range(size - 1):
            between[at : at + size - 1 - a] += np.abs(p[a + 1 :] - p[a]).sum(axis=1)
            at += size - 1 - a
        for a in range(size):
            more = np.flatnonzero((dense[a] > 0) & (p[a] > q))
            for j in more[np.argsort(q[more] - p[a][more], kind="stable")[:top]]:
                yield names[a], "term", own[j], int(p[a][j] - q[j])
    for a, b, v in zip(first, second, between):
        yield names[a], "pair", names[b], int(v)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language, and the `top` terms that a source has more of than its language.

    Null text, lang and source count as empty texts, so a group of the empty name may occur; a group without terms is
    compared like any other; rows that repeat count as often as they stand; no documents give no rows; other columns
    don't matter. Ties go to the smaller item in UTF-8 order.

    A task counts at most ENTRIES entries and one batch before they are handed on, and sums meet by (lang, source,
    term), so a hot source or word is summed where it is read. A chunk holds about CHUNK_ROWS rows and a dense block at most CELLS
    cells (one term of all sources at least); a language's list of sources goes to the parts its chunks are dealt to. What
    is held per language is the square of its sources, as many as it has rows in the result.
    """
    names = [f.split()[0] for f in FOUND.split(", ")]
    counts = written(term_counts(docs), "term-counts")
    chunks = written(term_chunks(counts, least_docs), "term-chunks")
    groups = counts.where(F.col("term") == "").select("lang", "source")
    own = chunks.select("lang", F.explode(F.arrays_zip(F.transform("at", lambda k: F.get("sources", k)).alias("source"), "n")).alias("x"))
    sums = own.groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    each = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
    langs = each.join(kept, "lang", "left").select("lang", "groups", F.coalesce("kept", F.lit(0)).alias("kept"))
    langs = written(langs, "languages")
    none = langs.select("lang", F.lit(-1).cast("long").alias("chunk"), *(F.array().cast(kind).alias(name) for name, kind in (f.split() for f in CHUNKS.split(", ")[2:])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = list(compared(row, [g["source"] for g in row["groups"]], np.array([g["n"] for g in row["groups"]], dtype=np.int64), row["kept"], top, CELLS))
                if found:
                    source, part, item, value = zip(*found)
                    yield from pa.Table.from_arrays([pa.array([row["lang"]] * len(found)), pa.array(source), pa.array(part), pa.array(item), pa.array(value, pa.int64())], names=names).to_batches(max_chunksize=20_000)

    # chunks are large rows: a task gets a few at a time
    parts = written(spread_join(chunks.unionByName(none), langs, "lang", least=4).mapInArrow(run, FOUND), "compared")
    pairs = parts.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "part", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.select("lang", "x.source", "part", "x.item", "value").withColumn("rank", F.row_number().over(order))
    terms = parts.where(F.col("part") == "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)


DIVERGENCE_SQL = rf"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents),
w as (select r, lang, source, unnest(words) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= {LEAST_DOCS}),
size as (select lang, count(*) as v from kept group by lang),
own as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by lang, source, term),
groups as (select distinct lang, source from d),
cells as (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as n
  from groups g join kept k on k.lang = g.lang left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
p as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + {SMOOTH})) // (sum(n) over (partition by lang, source) + {SMOOTH} * v)::hugeint as p
  from cells join size using (lang)),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + {SMOOTH})) // (sum(sum(n)) over (partition by lang) + {SMOOTH} * any_value(v))::hugeint as q
  from cells join size using (lang) group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by 1, 2, 3),
terms as (select lang, source, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', item, value::bigint, row_number() over (partition by lang, source order by value desc, item) from terms qualify row_number() over (partition by lang, source order by value desc, item) <= {TOP_TERMS})
select lang, source, part, item, value, rank::int as rank from ranked
"""
