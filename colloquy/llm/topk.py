"""Exact top-k by inner product: ball trees per shard, nodes in order of their bounds, the k-th score handed on.

Vectors are dealt to cells, each to the nearest of a bounded number of centres, and crowded cells to several shards. A
shard's tree is built once and written. Queries go to shards in rounds: first to the cell of the highest upper bound,
then to the next few, then to all others whose bound still reaches the query's k-th score so far. A round's scores are
the floor of the next one, in choosing cells as well as within the trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import runs, written

K = 20
LEAF = 256
#: Vectors that a shard holds about.
SHARD_ROWS = 20_000
#: Centres at least, so that few vectors still spread over a cluster, and at most, so that what is sent to tasks is bounded.
CELLS, MOST_CELLS = 24, 2048
#: Cells that a query goes to, by their order, in each round.
ROUNDS = ((0, 1), (1, 4), (4, None))
#: Queries that are searched together.
QUERIES = 1024
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "uid long, query_id long, vec_id long, score long"
ROUTED = "cell int, sub int, kind int, uid long, query_id long, x array<double>, floor long, tree binary"


class BallTree:
    """Nodes (centre, radius, rows or children) over the rows of x; ids break ties, the smaller first."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.x, self.ids, self.leaf = x, ids, leaf
        self.top = float(np.abs(x).max(initial=0))
        with np.errstate(over="ignore", invalid="ignore"):
            self.root = self.node(np.arange(len(x))) if len(x) else None

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, top: float, root) -> BallTree:
        """A tree that was written before."""
        tree = cls.__new__(cls)
        tree.x, tree.ids, tree.top, tree.root = x, ids, top, root
        return tree

    def node(self, rows: np.ndarray):
        own = self.x[rows]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        radius = float(away.max()) * (1 + 1e-9) + 1e-9
        if len(rows) <= self.leaf or away.max() == 0 and len(rows) <= 16 * self.leaf:
            return centre, radius, rows, None
        one = own[away.argmax()]
        other = own[((own - one) ** 2).sum(axis=1).argmax()]
        low = np.argsort(own @ (other - one), kind="stable")
        half = len(rows) // 2
        return centre, radius, None, (self.node(rows[low[:half]]), self.node(rows[low[half:]]))


def upper(q: np.ndarray, norm: np.ndarray, centres: np.ndarray, radius) -> np.ndarray:
    """Bounds of the inner products with anything in a ball, a little above; beyond what doubles hold they are infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        dot = q @ centres
        b = dot + norm * radius
        b = b + 1e-9 * (np.abs(dot) + norm * radius) + 1e-6
    return np.where(np.isnan(b), np.inf, b)


def norms(q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)


def products(q: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Inner products as long numbers; where doubles might round, by whole numbers of any size, cut to a long's range."""
    if top < 2**53:
        return np.rint(q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x).T, LOW + 1, HIGH).astype(np.int64)


class Search:
    """The k best of some queries in one tree. floor: a score that k other vectors are known to reach; nothing below is looked for."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int = K):
        self.q, self.own, self.k, self.floor = queries, ids, k, floor
        self.norm, self.top = norms(queries), np.abs(queries).max(axis=1, initial=0)
        self.score = np.full((len(ids), k), LOW)
        self.found = np.full((len(ids), k), HIGH)

    def bound(self, node, at: np.ndarray) -> np.ndarray:
        return upper(self.q[at], self.norm[at], node[0], node[1])

    def visit(self, tree: BallTree, node, at: np.ndarray) -> None:
        """Nodes whose bound is under a query's k-th score are passed over; ties may still be better by id."""
        at = at[self.bound(node, at) >= np.maximum(self.score[at, -1], self.floor[at])]
        if not len(at):
            return
        if node[3] is None:
            self.leaf(tree, node[2], at)
            return
        one, two = node[3]
        first = self.bound(one, at) >= self.bound(two, at)
        self.visit(tree, one, at[first])
        self.visit(tree, two, at[~first])
        self.visit(tree, two, at[first])
        self.visit(tree, one, at[~first])

    def leaf(self, tree: BallTree, rows: np.ndarray, at: np.ndarray) -> None:
        x, ids = tree.x[rows], tree.ids[rows]
        for lo in range(0, len(at), 512):
            part = at[lo : lo + 512]
            s = products(self.q[part], x, float(self.top[part].max(initial=0)) * tree.top * x.shape[1])
            s[ids[None, :] == self.own[part][:, None]] = LOW
            s[s < self.floor[part][:, None]] = LOW
            some = ((s >= self.score[part, -1][:, None]) & (s > LOW)).any(axis=1)
            if not some.any():
                continue
            part, s = part[some], s[some]
            score = np.concatenate([self.score[part], s], axis=1)
            found = np.concatenate([self.found[part], np.where(s > LOW, ids, HIGH)], axis=1)
            best = np.lexsort((found, ~score), axis=1)[:, : self.k]  # ~ turns long numbers around without overflow
            self.score[part] = np.take_along_axis(score, best, axis=1)
            self.found[part] = np.take_along_axis(found, best, axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, x): floor(scale * component) as doubles, of vectors that hold finite components only, before and after."""
    x = F.transform("embedding", lambda v: floored(v.cast("double") * scale))
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", x.alias("x")).where(F.coalesce(fits, F.lit(False)))


def floored(v):
    """The floor as a double; from 2^52 on, doubles are whole."""
    return F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)


class Cells:
    """Centres, radii and shards of cells, by the vectors' length. Bounded: MOST_CELLS and one for each further length."""

    def __init__(self, sample: list[np.ndarray]):
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length -> (cells, centres)
        for n in sorted({len(x) for x in sample}):
            at = [k for k, x in enumerate(sample) if len(x) == n]
            self.by[n] = np.array(at, dtype=np.int32), np.stack([sample[k] for k in at])
        self.radius: dict[int, float] = {}
        self.shards: dict[int, int] = {}

    def centres(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return self.by.get(n) or (np.array([-n], dtype=np.int32), np.zeros((1, n)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of each row."""
        cells, centres = self.centres(x.shape[1])
        at, away = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        with np.errstate(over="ignore", invalid="ignore"):
            for lo in range(0, len(x), 1024):
                part = x[lo : lo + 1024]
                near = (((centres**2).sum(axis=1) / 2)[None, :] - part @ centres.T).argmin(axis=1)
                at[lo : lo + 1024] = near
                away[lo : lo + 1024] = np.sqrt(((part - centres[near]) ** 2).sum(axis=1))
        return cells[at], away

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, bounds) of each row, the highest bound first; cells without vectors are left out."""
        cells, centres = self.centres(x.shape[1])
        held = np.array([int(c) in self.shards for c in cells], dtype=bool)
        cells, centres = cells[held], centres[held]
        if not len(cells):
            return np.zeros((len(x), 0), dtype=np.int32), np.zeros((len(x), 0))
        b = upper(x, norms(x)[:, None], centres.T, np.array([self.radius[int(c)] for c in cells])[None, :])
        by = np.argsort(-b, axis=1, kind="stable")
        return cells[by], np.take_along_axis(b, by, axis=1)


def by_length(b: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the lists of each length in a batch."""
    lists = b.column(b.schema.names.index(column))
    sizes = np.diff(lists.offsets.to_numpy())
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, matrix(lists.take(pa.array(rows)))


def placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(vec_id, x, cell, away): each vector with its cell and how far from its centre it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, away = np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows)
            for rows, x in by_length(b, "x"):
                cell[rows], away[rows] = cells.nearest(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], names=["vec_id", "x", "cell", "away"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, x array<double>, cell int, away double")


def built(vectors: DataFrame) -> DataFrame:
    """(cell, sub, tree): the ball tree of each shard. vectors: vec_id, x, cell, sub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, ["cell", "sub"]):
            t = pa.Table.from_batches(held).combine_chunks()
            tree = BallTree(np.concatenate([matrix(c) for c in t["x"].chunks]), t["vec_id"].to_numpy())
            yield pa.RecordBatch.from_arrays([t["cell"].chunk(0).slice(0, 1), t["sub"].chunk(0).slice(0, 1), pa.array([pickle.dumps((tree.x, tree.ids, tree.top, tree.root))], pa.binary())], names=["cell", "sub", "tree"])

    return vectors.select("cell", "sub", "vec_id", "x").repartition("cell", "sub").sortWithinPartitions("cell", "sub", "vec_id").mapInArrow(run, "cell int, sub int, tree binary")


def routed(queries: DataFrame, cells: Cells, first: int, last: int | None) -> DataFrame:
    """ROUTED rows of queries (uid, query_id, x, floor): one for each shard of the cells first to last, by bound, that may hold a score of the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floor = b.column(3).fill_null(LOW).to_numpy()
            for rows, x in by_length(b, "x"):
                for lo in range(0, len(rows), QUERIES):
                    part = rows[lo : lo + QUERIES]
                    cell, bound = (a[:, first:last] for a in cells.ranked(x[lo : lo + QUERIES]))
                    at, k = np.nonzero(bound >= floor[part][:, None])
                    shards = np.array([cells.shards[int(c)] for c in cell[at, k]], dtype=np.int64)
                    many = np.repeat(np.arange(len(at)), shards)
                    sub = np.arange(len(many)) - np.repeat(np.cumsum(shards) - shards, shards)
                    own = b.take(pa.array(part[at[many]]))
                    n = len(many)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at, k][many], pa.int32()), pa.array(sub, pa.int32()), pa.array(np.ones(n), pa.int32()), own.column(0), own.column(1), own.column(2), own.column(3), pa.nulls(n, pa.binary())], names=[f.split()[0] for f in ROUTED.split(", ")])

    return queries.select("uid", "query_id", "x", "floor").mapInArrow(run, ROUTED)


def searched(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """FOUND of queries (ROUTED) in the trees of their shards. A shard's tree comes first and its queries stream by."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("uid", "long"), ("query_id", "long"), ("x", "array<double>"), ("floor", "long"))]
    both = queries.unionByName(trees.select("cell", "sub", F.lit(0).alias("kind"), *none, "tree"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for b in batches:
            for held in runs(iter([b]), ["cell", "sub"]):
                rows = held[0]
                key = rows.column(0)[0].as_py(), rows.column(1)[0].as_py()
                if key != at:
                    at, tree = key, BallTree.of(*pickle.loads(rows.column(7)[0].as_py()))
                    rows = rows.slice(1)
                for lo in range(0, rows.num_rows, QUERIES):
                    part = rows.slice(lo, QUERIES)
                    s = Search(matrix(part.column(5)), part.column(4).to_numpy(), part.column(6).fill_null(LOW).to_numpy(), k)
                    s.visit(tree, tree.root, np.arange(part.num_rows))
                    row, place = np.nonzero(s.score > LOW)
                    yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(row)), pa.array(s.own[row]), pa.array(s.found[row, place]), pa.array(s.score[row, place])], names=["uid", "query_id", "vec_id", "score"])

    return both.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "kind").mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank. A limit on a window's rank is applied before rows are shuffled, too."""
    w = W.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors of its length but those of its own id.

    vectors: vec_id, x; queries: query_id, x; x: arrays of whole numbers. Ties go to the smaller vec_id. Each row of the
    queries is a query of its own, also where an id is repeated; each row of the vectors counts, repeated ids and vectors
    too. A product beyond a long's range counts as the end of that range. Empty vectors find and are found nothing; with
    fewer than k vectors all are returned; empty tables give an empty result; other columns don't matter. Cells are a
    matter of speed alone: their centres are at most MOST_CELLS vectors, chosen by a hash of the id.
    """
    as_double = F.col("x").cast("array<double>").alias("x")
    vectors = written(vectors.where(F.size("x") > 0).select("vec_id", as_double), "vectors")
    queries = written(queries.where(F.size("x") > 0).select(F.monotonically_increasing_id().alias("uid"), "query_id", as_double), "queries")
    n = vectors.count()
    most = min(MOST_CELLS, max(CELLS, n // SHARD_ROWS))
    cells = Cells([np.array(r.x) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()])
    own = written(placed(vectors, cells), "cells")
    for r in own.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        cells.shards[r.cell], cells.radius[r.cell] = -(-r.n // SHARD_ROWS), r.radius * (1 + 1e-9) + 1e-9
    sizes = own.sparkSession.createDataFrame([(c, s) for c, s in cells.shards.items()], "cell int, shards int")  # a row per cell
    subs = own.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")).cast("int"))
    trees = written(built(subs), "trees")
    found, told = None, queries.withColumn("floor", F.lit(None).cast("long"))
    for first, last in ROUNDS:
        now = searched(trees, routed(told, cells, first, last), k)
        if last is not None:
            now = written(now, "found")
        found = now if found is None else found.unionByName(now)
        if last is not None:
            reached = best(found, k).groupBy(F.col("uid").alias("__uid")).agg(F.min("score").alias("__least"), F.count("*").alias("__n"))
            told = queries.join(reached, F.col("uid") == F.col("__uid"), "left").withColumn("floor", F.when(F.col("__n") >= k, F.col("__least")))
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def topk_query(vectors: DataFrame) -> DataFrame:
    whole = whole_vectors(vectors)
    return top_k(whole, whole.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "x"))


TOPK_SQL = """
with v as (
  select row_number() over () as uid, vec_id, list_transform(embedding, lambda c: floor(64 * c::double)) as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
s as (
  select q.uid, q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.x, v.x) as bigint) as score
  from v q join v on q.vec_id <> v.vec_id and len(q.x) = len(v.x) where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by uid order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
