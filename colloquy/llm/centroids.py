"""Centroid clustering in whole numbers, exact: block norms screen centroids before any exact distance is taken.

A vector is compressed to its norms by block, made once and written beside it. By Cauchy-Schwarz the squared distance of
a block is at least the squared difference of its two norms, so their sum bounds the distance to a centroid from below.
The exact distance to the centroid of the least bound comes first; only centroids whose bound doesn't pass it get theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SIZE, SCALE, BLOCK = 64, 64, 8
CENTROIDS, ROUNDS = 16, 3
LOW, HIGH = -(2**62), 2**62
#: Whole components under this leave every squared distance of SIZE of them in a long.
PLAIN = 2**27
#: What bounds lose by rounding, at most, as a share.
SAFE = 1e-9
LONGEST = np.iinfo(np.int64).max


def block_norms(x: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Euclidean norms of each row's blocks."""
    return np.sqrt((x.astype(float).reshape(len(x), x.shape[1] // block, block) ** 2).sum(axis=2))


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, x, norms): floor(scale * component) of vectors of `size` finite components, and their norms by block; the others are left out.

    Components beyond 2^62 on either side count as that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            fits = pa.array(np.diff(lists.offsets.to_numpy()) == size)
            ids, given = b.column(0).filter(fits), lists.filter(fits).flatten()
            raw = given.fill_null(float("nan")).to_numpy().reshape(-1, size)
            good = np.isfinite(raw).all(axis=1)
            with np.errstate(over="ignore"):
                scaled = np.clip(np.floor(scale * raw[good]), float(LOW), float(HIGH))
            x = scaled.astype(np.int64)
            norms = block_norms(x)
            listed = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), listed(x, pa.int64()), listed(norms, pa.float64())], names=["vec_id", "x", "norms"])

    return vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, x array<long>, norms array<double>")


def exact(x: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Squared distances, in longs where they fit and else in whole numbers of any size."""
    if max(np.abs(x).max(initial=0), *map(abs, centroid)) < PLAIN:
        away = x - np.array(centroid, dtype=np.int64)
        return np.einsum("ij,ij->i", away, away)
    away = x.astype(object) - np.array(centroid, dtype=object)
    return (away * away).sum(axis=1)


class Screen:
    """The nearest of some centroids. `taken` and `seen` count exact distances and all pairs."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids, self.norms = centroids, block_norms(np.array(centroids, dtype=float))
        self.taken = self.seen = 0

    def bounds(self, norms: np.ndarray) -> np.ndarray:
        """Squared distances at least, by row and centroid, less what rounding may have added."""
        gap = norms[:, None, :] - self.norms[None, :, :]
        most = (norms**2).sum(axis=1)[:, None] + (self.norms**2).sum(axis=1)[None, :]
        return (gap**2).sum(axis=2) - SAFE * most - 1e-6

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row; of equally near centroids the smaller number."""
        low = self.bounds(norms)
        first = low.argmin(axis=1)
        best, at = np.zeros(len(x), dtype=object), first.copy()
        plain = max(np.abs(x).max(initial=0), *(abs(v) for c in self.centroids for v in c)) < PLAIN
        if plain:
            best = best.astype(np.int64)
        for c, centroid in enumerate(self.centroids):
            rows = np.flatnonzero(first == c)
            if len(rows):
                best[rows] = exact(x[rows], centroid)
        self.taken, self.seen = self.taken + len(x), self.seen + low.size
        for c, centroid in enumerate(self.centroids):
            rows = np.flatnonzero((first != c) & (low[:, c] <= best.astype(float) * (1 + SAFE)))
            if not len(rows):
                continue
            self.taken += len(rows)
            d = exact(x[rows], centroid)
            less = (d < best[rows]) | (d == best[rows]) & (c < at[rows])
            best[rows[less]], at[rows[less]] = d[less], c
        return at, best


def parts(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    x, norms = (b.column(b.schema.names.index(k)).flatten().to_numpy() for k in ("x", "norms"))
    return x.reshape(-1, size), norms.reshape(-1, size // BLOCK)


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the floor of the mean of its vectors; those without vectors stay. The driver gets a row per centroid and component."""
    size = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, sums, counts = Screen(centroids), np.zeros((len(centroids), size), dtype=object), [0] * len(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            x, norms = parts(b, size)
            at, _ = screen.nearest(x, norms)
            small = np.abs(x).max(initial=0) < 2**40  # of a batch's rows, far fewer than 2^22
            for c in np.unique(at):
                own = x[at == c]
                sums[c] += (own if small else own.astype(object)).sum(axis=0).astype(object)
                counts[c] += len(own)
        used = [c for c, n in enumerate(counts) if n]
        rows = [(c, j, str(sums[c][j]), counts[c]) for c in used for j in range(size)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["cluster", "component", "total", "n"])

    found = vectors.select("x", "norms").mapInArrow(run, "cluster int, component int, total string, n long")
    out = [list(c) for c in centroids]
    for r in found.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster][r.component] = int(r.total) // r.n
    return out


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The k vectors of the smallest hashes of their ids; of equal ids (null: no digits) the smaller vectors first."""
    hashed = vectors.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x")
    return [list(r.x) for r in hashed.orderBy("h", "x").limit(k).collect()]


def clustered(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of `size` finite components.

    Null vectors, vectors of another length and those with null or non-finite components take no part; with fewer than k
    vectors there are as many centroids; no vectors give no rows; each row counts, repeated ids and equal vectors too;
    other columns don't matter. Sums and means are exact; a distance or inertia beyond a long counts as the largest long.

    The driver holds k centroids and, from each round, their k * size sums, whatever the number of vectors: each task sums
    its own vectors first. A cluster may hold any share of all rows.
    """
    held = written(whole_vectors(vectors, size, scale), "vectors")
    centroids = first_centroids(held, k)
    columns = "vec_id long, cluster int, distance long"
    if not centroids:
        rest = [F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return held.select("vec_id", *rest)
    for _ in range(rounds):
        centroids = moved(held, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for b in batches:
            if b.num_rows:
                at, d = screen.nearest(*parts(b, size))
                d = d if d.dtype == np.int64 else np.minimum(d, LONGEST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    own = written(held.select("vec_id", "x", "norms").mapInArrow(run, columns), "clusters")
    sums = {r.cluster: int(r.d) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    cut = lambda v: min(v, int(LONGEST))
    rows = [(c, cut(sums.get(c, 0)), cut(sum(sums.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    told = own.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return own.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def rounds_sql(rounds: int = ROUNDS, k: int = CENTROIDS) -> str:
    """The same by SQL, a few tables a round."""
    out = [
        f"""with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::double)::bigint) as x from embeddings
  where embedding is not null and len(embedding) = {SIZE} and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
c0 as (select (row_number() over (order by h, x))::int - 1 as cluster, x from (select sha256('1:' || coalesce(vec_id::varchar, '')) as h, x from v order by h, x limit {k}))"""
    ]
    for t in range(rounds + 1):
        out.append(
            f"""a{t} as (
  select r, vec_id, v.x, cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
  from v, c{t} c qualify row_number() over (partition by r order by distance, cluster) = 1)"""
        )
        if t < rounds:
            out.append(
                f"""c{t + 1} as (
  select c.cluster, coalesce(m.x, c.x) as x from c{t} c left join (
    select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as x from (
      select cluster, j, sum(x)::hugeint as s, count(*)::hugeint as n from (select cluster, unnest(x) as x, generate_subscripts(x, 1) as j from a{t}) group by cluster, j)
    group by cluster) m on m.cluster = c.cluster)"""
            )
    last = f"""select vec_id, a.cluster, distance, sum(distance) over (partition by a.cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.cluster = c.cluster"""
    return ",\n".join(out) + "\n" + last


CLUSTER_SQL = rounds_sql()
