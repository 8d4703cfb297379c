"""Response matrices in long form (k, col, value), effect sizes, factor loadings and vectors.

Spark sums up moments in one pass; numpy sees a matrix whose sides are items, never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import stats


def complete_rows(cells: DataFrame, n_items: int) -> DataFrame:
    """Cells of the rows that have a value of every item."""
    full = cells.where(F.col("value").isNotNull()).groupBy("k").agg(F.count("value").alias("n")).where(F.col("n") == n_items)
    return cells.join(full, "k", "left_semi")


def steady_rows(cells: DataFrame, drop_share: float) -> DataFrame:
    """Without the rows of the highest variance: those at or under the percentile stay."""
    spread = cells.groupBy("k").agg(F.var_pop("value").alias("v"))
    cut = spread.agg(F.percentile("v", F.lit(1 - drop_share)).alias("cut"))
    return cells.join(spread.join(F.broadcast(cut), F.col("v") <= F.col("cut")), "k", "left_semi")


def varied_columns(cells: DataFrame, block: Column, least: float) -> DataFrame:
    """Items whose variance is at least `least` times the median positive one of their block; that of a block without any counts as 0 of it."""
    item = cells.groupBy(block.alias("block"), "col").agg(F.var_pop("value").alias("v"))
    middle = item.groupBy("block").agg(F.median(F.when(F.col("v") > 0, F.col("v"))).alias("m"))
    return item.join(F.broadcast(middle), "block").select("block", "col", "v", F.coalesce(F.try_divide(F.col("v"), F.col("m")), F.lit(0.0)).alias("ratio")).where(F.col("ratio") >= least)


def residuals(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """value minus its group's mean; a row without a group is one of its own. Means are aggregated and joined, so a hot group is no window."""
    means = df.groupBy(*group).agg(F.avg(value).alias("__mean"))
    return df.join(means, group, "left").withColumn(value, F.col(value) - F.coalesce("__mean", value)).drop("__mean")


def correlations(cells: DataFrame) -> DataFrame:
    """(a, b, r) of all pairs of items, a < b, from one row per respondent."""
    row = cells.where(F.col("value").isNotNull()).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("v"))
    left = row.select("v", F.posexplode("v").alias("i", "x"))
    pairs = left.select("x", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("y")).select(F.col("x.col").alias("a"), F.col("y.col").alias("b"), F.col("x.value").alias("p"), F.col("y.value").alias("q"))
    return pairs.groupBy("a", "b").agg(stats.pearson(F.col("p"), F.col("q")).alias("r"))


def vector_correlations(df: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(rows, correlations between components) of equally long vectors without gaps.

    Each task adds up its own products; sums by pair of components are all that is shuffled and brought to the driver.
    """

    def products(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.c_[np.stack(pdf[column].to_numpy()).astype(float), np.ones(len(pdf))]
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    whole = F.col(column).isNotNull() & ~F.coalesce(F.exists(column, lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    found = df.where(whole).select(column).mapInPandas(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    size = max((r.i for r in found), default=0)
    g = np.zeros((size + 1, size + 1))
    for r in found:
        g[r.i, r.j] = r.s
    n, mean = g[-1, -1], g[-1, :-1] / max(g[-1, -1], 1)
    cov = g[:-1, :-1] / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where((sd[:, None] > 0) & (sd > 0), cov / np.outer(sd, sd), 0.0)
    np.fill_diagonal(r, 1.0)
    return int(n), r


def principal_axes(r: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Loadings by iterated principal axes; each factor's sum is positive."""
    h = 1 - 1 / np.diag(np.linalg.pinv(r))
    load = np.zeros((len(r), k))
    for _ in range(rounds):
        own = r.copy()
        np.fill_diagonal(own, h)
        values, vectors = np.linalg.eigh(own)
        load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))
        h = np.clip((load**2).sum(axis=1), 0, 1)
    return load * np.where(load.sum(axis=0) < 0, -1, 1)


def varimax(load: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Turns pairs of factors, each by the angle that is best for it, until none moves."""
    load = load.copy()
    for _ in range(rounds):
        moved = 0.0
        for i in range(load.shape[1]):
            for j in range(i + 1, load.shape[1]):
                x, y = load[:, i].copy(), load[:, j].copy()
                u, v = x * x - y * y, 2 * x * y
                up = 2 * (u * v).sum() - 2 * u.sum() * v.sum() / len(x)
                along = (u * u - v * v).sum() - (u.sum() ** 2 - v.sum() ** 2) / len(x)
                angle = np.arctan2(up, along) / 4
                load[:, i], load[:, j] = x * np.cos(angle) + y * np.sin(angle), y * np.cos(angle) - x * np.sin(angle)
                moved = max(moved, abs(angle))
        if moved < 1e-9:
            break
    return load


def parallel_analysis(n_rows: int, n_items: int, real: np.ndarray, spark, draws: int = 100, share: float = 0.95, seed: int = 0) -> tuple[int, int]:
    """How many eigenvalues exceed those of noise: in all, and before the first that doesn't.

    Each draw is a row of a task. The products of n normal rows follow a Wishart law, which is drawn as such (a
    triangle of normal and chi values), so a draw's size doesn't depend on the number of rows.
    """

    def noise(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                a = np.tril(rng.normal(size=(n_items, n_items)), -1)
                np.fill_diagonal(a, np.sqrt(rng.chisquare(np.maximum(n_rows - 1 - np.arange(n_items), 1))))
                w = a @ a.T
                sd = np.sqrt(np.diag(w))
                out += [(int(i), j, float(e)) for j, e in enumerate(np.sort(np.linalg.eigvalsh(w / np.outer(sd, sd)))[::-1])]
            yield pd.DataFrame(out, columns=["draw", "rank", "e"])

    spread = spark.range(0, draws, 1, min(draws, 32)).mapInPandas(noise, "draw long, rank int, e double")
    limit = {r["rank"]: r["t"] for r in spread.groupBy("rank").agg(F.percentile("e", F.lit(share)).alias("t")).collect()}
    over = [bool(e > limit[j]) for j, e in enumerate(real)]
    return sum(over), over.index(False) if False in over else len(over)


def tucker(a: DataFrame, b: DataFrame) -> DataFrame:
    """(fa, fb, phi): congruence of two loading tables (item, factor, loading) over the items they share."""
    both = a.select("item", F.col("factor").alias("fa"), F.col("loading").alias("x")).join(b.select("item", F.col("factor").alias("fb"), F.col("loading").alias("y")), "item")
    phi = F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("y") ** 2)))
    return both.groupBy("fa", "fb").agg(phi.alias("phi"))


def top_loadings(loadings: DataFrame, n: int) -> DataFrame:
    """The n highest and lowest loadings of each factor."""
    w = W.partitionBy("factor")
    up, down = F.row_number().over(w.orderBy(F.desc("loading"), "item")), F.row_number().over(w.orderBy("loading", "item"))
    placed = loadings.withColumn("up", up).withColumn("down", down)
    side = lambda c, sign: placed.where((F.col(c) <= n) & (F.col("loading") * sign > 0)).select("factor", F.lit(sign).alias("sign"), F.col(c).alias("rank"), "item", "loading")
    return side("up", 1).unionByName(side("down", -1))


# --- effect sizes --------------------------------------------------------------------------------------------------


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the variance between groups, from the groups' moments."""
    part = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") ** 2) - n * mean * mean
    total = F.sum(F.col("n") * (F.col("v") + F.col("m") ** 2)) - n * mean * mean
    return part.agg(F.count("*").alias("n_groups"), F.try_divide(between, total).alias("eta2"))


def two_way_eta(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Shares of A, B, their interaction and the rest; negative ones are 0."""
    sets = df.groupingSets([[a], [b], [a, b], []], a, b).agg(F.grouping_id().alias("g"), F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    level = lambda g, c: F.sum(F.when(F.col("g") == g, c))
    part = lambda g: level(g, F.col("n") * F.col("m") ** 2) - level(3, F.col("n") * F.col("m") ** 2)
    total = level(3, F.col("n") * F.col("v"))
    one, two, cell = part(1), part(2), part(0)
    ratio = lambda c: F.greatest(F.lit(0.0), F.try_divide(c, total))
    return sets.agg(ratio(one).alias("eta_a"), ratio(two).alias("eta_b"), ratio(cell - one - two).alias("eta_ab"), ratio(total - cell).alias("eta_rest"))


def icc(df: DataFrame, group: str, value: str, confidence: float = 0.95, least: int = 5) -> DataFrame:
    """ICC(1) with its interval by the F distribution, and ICC(k), by one-way mean squares; k is the harmonic mean of the groups' sizes.

    Groups of two at least count; fewer than `least` of them give nulls. The quantiles are worked out for the one row
    of the result.
    """
    part = df.groupBy(group).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n >= 2")
    groups, n, mean = F.count("*").cast("double"), F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = (F.sum(F.col("n") * F.col("m") ** 2) - n * mean * mean) / (groups - 1)
    within, k = F.sum(F.col("n") * F.col("v")) / (n - groups), groups / F.sum(1 / F.col("n"))
    parts = part.agg(groups.alias("groups"), n.alias("n"), between.alias("b"), within.alias("w"), k.alias("k"))

    @F.pandas_udf("double")
    def quantile(p: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([stats.f_quantile(a, b, c) if b > 0 and c > 0 else None for a, b, c in zip(p, d1, d2)], dtype=float)

    b, w, k, groups = F.col("b"), F.col("w"), F.col("k"), F.col("groups")
    f = F.try_divide(b, w)
    edge = lambda p: F.try_divide(f, quantile(F.lit(p), groups - 1, F.col("n") - groups))
    bound = lambda r: F.try_divide(r - 1, r + k - 1)
    known = lambda c: F.when(groups >= least, c)
    return parts.select(
        groups.cast("long").alias("n_groups"), known(F.try_divide(b - w, b + (k - 1) * w)).alias("icc1"), known(bound(edge((1 + confidence) / 2))).alias("low"),
        known(bound(edge((1 - confidence) / 2))).alias("high"), known(F.try_divide(b - w, b)).alias("icck"), known(f).alias("f"),
    )


def cronbach(cells: DataFrame, n_items: int, signs: DataFrame | None = None) -> DataFrame:
    """alpha of the complete rows, its items turned by their sign (col, sign) if there is one; null for fewer than two items or rows, or sums that don't vary."""
    full = complete_rows(cells, n_items)
    if signs is not None:  # a row per item
        full = full.join(F.broadcast(signs), "col").withColumn("value", F.col("value") * F.col("sign"))
    items = full.groupBy("col").agg(F.var_samp("value").alias("v")).agg(F.sum("v").alias("items"))
    whole = full.groupBy("k").agg(F.sum("value").alias("s")).agg(F.var_samp("s").alias("whole"), F.count("*").alias("n_rows"))
    alpha = F.when(F.col("whole") > 0, n_items / max(n_items - 1, 1) * (1 - F.try_divide(F.col("items"), F.col("whole"))))
    return items.join(F.broadcast(whole)).select("n_rows", (alpha if n_items > 1 else F.lit(None).cast("double")).alias("alpha"))


def alpha_band(alpha: Column) -> Column:
    """What an alpha is called. The lower ends of the bands."""
    bands = (("redundant", 0.95), ("excellent", 0.90), ("good", 0.80), ("acceptable", 0.70), ("questionable", 0.60))
    out = F.when(alpha.isNull() | F.isnan(alpha), "n/a")
    for name, low in bands:
        out = out.when(alpha >= low, name)
    return out.otherwise("poor")


def cohens_d(x: Column, treated: Column, pooled: bool = False) -> Column:
    """Difference of means in units of the mean variance, or of the variance pooled by degrees of freedom; 0 without any."""
    a, b = F.when(treated, x), F.when(~treated, x)
    va, vb, na, nb = F.var_samp(a), F.var_samp(b), F.count(a), F.count(b)
    v = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) if pooled else (va + vb) / 2
    return F.when(v > 0, (F.avg(a) - F.avg(b)) / F.sqrt(v)).otherwise(0.0)


# --- vectors -------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-12) * (F.sqrt(dot(b, b)) + 1e-12))


def neighbours(vectors: DataFrame, target: list[float], k: int, group: str | None = None, most: int = 1) -> DataFrame:
    """The k rows nearest to a target by cosine, at most `most` of a group."""
    near = vectors.withColumn("similarity", cosine(F.col("embedding"), F.array(*map(F.lit, target))))
    order = [F.desc("similarity"), F.col("vec_id")]
    if group:
        near = near.withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__k") <= most).drop("__k")
    return near.orderBy(*order).limit(k)


def purity(scores: Column, factor: int, weight: float) -> Column:
    """How far one factor's score stands out: |own| - weight * mean |others|, 0 at least."""
    size = F.array_size(scores)
    every = F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double")))
    own = F.abs(F.element_at(scores, factor + 1).cast("double"))
    return F.greatest(F.lit(0.0), own - weight * (every - own) / (size - 1))


def best_window(df: DataFrame, key: str, place: str, value: str, width: int) -> DataFrame:
    """The first of the runs of `width` neighbouring places with the highest sum, by key."""
    w = W.partitionBy(key).orderBy(place).rowsBetween(0, width - 1)
    runs = df.withColumn("total", F.sum(value).over(w)).withColumn("__n", F.count(value).over(w)).where(F.col("__n") == width)
    return runs.groupBy(key).agg(F.max_by(F.struct(F.col(place).alias("start"), "total"), F.struct("total", -F.col(place))).alias("r")).select(key, "r.*")


def threshold(low: Column, high: Column, fraction: float) -> Column:
    """A floor at a fraction from low to high; of a negative fraction a ceiling, counted from high."""
    return low + fraction * (high - low) if fraction >= 0 else high + fraction * (high - low)


def low_rank_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, dot) of weight vectors kept as factors: (vec, module, b: out x r, a: r x in); sums over shared modules.

    B1 A1 : B2 A2 = trace((B1'B2)(A2A1')), so no full matrix is ever made.
    """

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            b1, b2, a1, a2 = (np.stack(m) for m in (r.b1, r.b2, r.a1, r.a2))
            out.append((r.x, r.y, float(((b1.T @ b2) * (a1 @ a2.T)).sum())))
        return pd.DataFrame(out, columns=["x", "y", "dot"])

    both = a.select("module", F.col("vec").alias("x"), F.col("b").alias("b1"), F.col("a").alias("a1")).join(b.select("module", F.col("vec").alias("y"), F.col("b").alias("b2"), F.col("a").alias("a2")), "module")
    return both.mapInPandas(lambda it: map(part, it), "x long, y long, dot double").groupBy("x", "y").agg(F.sum("dot").alias("dot"))
