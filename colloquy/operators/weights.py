"""Weight vectors kept as low-rank factors by module, and their algebra; no full matrix is ever made.

A vector is a table (module, b, a): b its columns (rank x out), a its rows (rank x in), so the weights are the sum over
the rank of column times row. Adding concatenates both on the rank's axis.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import reduced_product

FACTORS = "module string, b array<array<double>>, a array<array<double>>"


def times(rows: Column, c: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda v: v * c))


def scaled(x: DataFrame, c: float) -> DataFrame:
    """c times a vector: one of the two factors is scaled."""
    return x.select("module", times(F.col("b"), F.lit(float(c))).alias("b"), "a")


def negated(x: DataFrame) -> DataFrame:
    return scaled(x, -1.0)


def with_scaling(x: DataFrame, alpha: float, rank: float) -> DataFrame:
    """A stored vector with its scaling alpha / rank taken into b."""
    return scaled(x, alpha / rank)


def added(x: DataFrame, y: DataFrame) -> DataFrame:
    """x + y. Other modules, or modules of another shape, are an error when rows are read."""
    right = y.select("module", F.col("b").alias("__b"), F.col("a").alias("__a"))
    both = x.join(right, "module", "full")
    length = lambda c: F.size(F.get(c, F.lit(0)))
    alone = F.col("b").isNull() | F.col("__b").isNull()
    other = (length("b") != length("__b")) | (length("a") != length("__a"))
    told = F.when(alone, F.raise_error(F.concat(F.lit("only one vector has module "), "module")).cast("boolean")).when(other, F.raise_error(F.concat(F.lit("shapes differ in module "), "module")).cast("boolean")).otherwise(True)
    return both.where(told).select("module", F.concat("b", "__b").alias("b"), F.concat("a", "__a").alias("a"))


def subtracted(x: DataFrame, y: DataFrame) -> DataFrame:
    return added(x, negated(y))


def zero_like(x: DataFrame) -> DataFrame:
    """A vector of the same modules and shapes, of rank 1, that is 0."""
    none = lambda c: F.array(F.transform(F.get(c, F.lit(0)), lambda v: F.lit(0.0)))
    return x.select("module", none("b").alias("b"), none("a").alias("a"))


def of_modules(x: DataFrame, endings: list[str] | None = None, layers: list[int] | None = None) -> DataFrame:
    """The modules whose name ends with one of `endings` (after a dot or whole) and whose first number is one of `layers`."""
    if endings is not None:
        x = x.where(F.reduce(F.array(*(F.lit(e) for e in endings)), F.lit(False), lambda s, e: s | (F.col("module") == e) | F.endswith("module", F.concat(F.lit("."), e))))
    if layers is not None:
        number = F.nullif(F.regexp_extract("module", r"(?:^|\.)(\d+)(?:\.|$)", 1), F.lit("")).cast("int")
        x = x.where(number.isin(*layers))
    return x


def sizes(x: DataFrame) -> DataFrame:
    """(modules, max_rank, parameters): ranks are the factors' sizes, not those of the weights."""
    rank, n = F.size("b"), lambda c: F.size(c) * F.size(F.get(c, F.lit(0)))
    return x.agg(F.count("*").alias("modules"), F.max(rank).alias("max_rank"), F.sum((n("b") + n("a")).cast("long")).alias("parameters"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """(dot): the sum over modules of trace((B1'B2)(A2A1')), by rows of factors; both vectors must have the same modules."""
    right = y.select("module", F.col("b").alias("__b"), F.col("a").alias("__a"))
    inner = lambda p, q: F.aggregate(F.zip_with(p, q, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    one = lambda b, a: F.aggregate(F.zip_with("__b", "__a", lambda p, q: inner(b, p) * inner(a, q)), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate(F.zip_with("b", "a", one), F.lit(0.0), lambda s, v: s + v)
    alone = F.col("b").isNull() | F.col("__b").isNull()
    told = F.when(alone, F.raise_error(F.concat(F.lit("only one vector has module "), "module")).cast("double")).otherwise(total)
    return x.join(right, "module", "full").agg(F.coalesce(F.sum(told), F.lit(0.0)).alias("dot"))


def norm(x: DataFrame) -> DataFrame:
    return dot(x, x).select(F.sqrt(F.greatest("dot", F.lit(0.0))).alias("norm"))


def cosine(x: DataFrame, y: DataFrame) -> DataFrame:
    """(cosine), 0 where a vector is 0."""
    both = dot(x, y).join(F.broadcast(norm(x).withColumnRenamed("norm", "n"))).join(F.broadcast(norm(y).withColumnRenamed("norm", "m")))  # single rows
    return both.select(F.coalesce(F.try_divide(F.col("dot"), F.col("n") * F.col("m")), F.lit(0.0)).alias("cosine"))


def rank_reduced(x: DataFrame, rank: int | None = None, tolerance: float | None = None) -> DataFrame:
    """The nearest vector whose modules have `rank` at most, or keep the singular values over tolerance times the largest.

    A module is a row, solved in a task by the triangles of its factors: the work is that of rank x rank matrices.
    """
    if (rank is None) == (tolerance is None):
        raise ValueError("give a rank or a tolerance")

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"module": [], "b": [], "a": []}
            for row in batch.to_pylist():
                b, a = np.array(row["b"], dtype=float).T, np.array(row["a"], dtype=float)
                values = np.linalg.svd(np.linalg.qr(b)[1] @ np.linalg.qr(a.T)[1].T, compute_uv=False)
                keep = rank if rank is not None else int((values > tolerance * values[0]).sum())
                b, a = reduced_product(b, a, max(1, min(keep, len(values))))
                for k, v in (("module", row["module"]), ("b", b.T.tolist()), ("a", a.tolist())):
                    out[k].append(v)
            lists = pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(out["module"], pa.string()), pa.array(out["b"], lists), pa.array(out["a"], lists)], names=["module", "b", "a"])

    return x.select(F.col("module").cast("string").alias("module"), "b", "a").mapInArrow(run, FACTORS)


def entries(x: DataFrame) -> DataFrame:
    """(module, i, j, w): the weights one by one, for small modules."""
    pairs = x.select("module", F.explode(F.arrays_zip("b", "a")).alias("p"))
    cells = pairs.select("module", F.posexplode("p.b").alias("i", "u"), "p.a").select("module", "i", "u", F.posexplode("a").alias("j", "v"))
    return cells.groupBy("module", "i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("w"))
