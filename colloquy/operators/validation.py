"""Validation of factor models: cross-validation over rows and items, permuted controls, split items, resampled correlations.

Predictions by factor scores are linear in the answers, so their errors follow from sums of products: Spark adds those
up, and no row is brought to the driver. Where rows have to be permuted, they meet in parts of a bounded size by a hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import scratch
from . import models as mo
from .experiments import halves

#: Rows of a part that are permuted together.
PART_ROWS = 1 << 15


# --- permuted rows -------------------------------------------------------------------------------------------------


def in_parts(df: DataFrame, part_rows: int) -> DataFrame:
    """df (id, ...) with `part`: a hash of the id, about part_rows rows each; rows of a part come together, in the order of another hash.

    The number of parts follows from the number of rows alone, so results don't depend on partitions.
    """
    parts = max(1, -(-df.count() // part_rows))
    own = df.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)).cast("int"))
    return own.repartition("part").sortWithinPartitions("part", F.xxhash64("id"), "id")


def whole_parts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one part after another."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for part, own in pdf.groupby("part", sort=False):
            if held and held[0]["part"].iloc[0] != part:
                yield pd.concat(held)
                held = []
            held.append(own)
    if held:
        yield pd.concat(held)


def summed(found: DataFrame) -> DataFrame:
    """Arrays `s` (by key) added up place by place: (key, s)."""
    each = found.select("key", F.posexplode("s").alias("place", "v")).groupBy("key", "place").agg(F.sum("v").alias("v"))
    return each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("s"))


def vectors(df: DataFrame, column: str, row_id: Column) -> DataFrame:
    """(id, x) of the rows whose vector has no gap."""
    whole = F.col(column).isNotNull() & ~F.coalesce(F.exists(column, lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    return df.where(whole).select(row_id.cast("long").alias("id"), F.transform(column, lambda v: v.cast("double")).alias("x"))


def permuted_eigenvalues(df: DataFrame, column: str, row_id: Column, draws: int = 100, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """(draw, rank, e): eigenvalues, the largest first, of the correlations that are left when every item's values are permuted on their own.

    Permutations stay within parts of rows that a hash puts together, around each part's means, so what the parts'
    means share isn't mistaken for noise; up to part_rows rows they are permutations of the whole column. Each draw's
    sums of products (one triangle) are added up in Spark and solved in a task of their own.
    """
    rows = in_parts(vectors(df, column, row_id), part_rows)

    def permuted(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in whole_parts(batches):
            x = np.stack(pdf["x"].to_numpy())
            x = x - x.mean(axis=0)
            for d in range(draws):
                rng = np.random.default_rng([seed, d, int(pdf["part"].iloc[0])])
                y = rng.permuted(x, axis=0)
                total[d] = total.get(d, 0) + (y.T @ y)[np.triu_indices(y.shape[1])]
        if total:
            yield pd.DataFrame({"key": list(total), "s": list(total.values())})

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.asarray(pdf["s"].iloc[0])
        p = int((np.sqrt(8 * len(s) + 1) - 1) / 2)
        g = np.zeros((p, p))
        g[np.triu_indices(p)] = s
        sd = np.sqrt(np.diag(g))
        live = sd > 0
        r = np.where(np.outer(live, live), (g + np.triu(g, 1).T) / np.outer(np.where(live, sd, 1), np.where(live, sd, 1)), 0.0)
        np.fill_diagonal(r, 1.0)
        return pd.DataFrame({"draw": pdf["key"].iloc[0], "rank": np.arange(p), "e": np.linalg.eigvalsh(r)[::-1]})

    sums = summed(rows.mapInPandas(permuted, "key long, s array<double>"))
    return sums.groupBy("key").applyInPandas(solved, "draw long, rank int, e double")


def thresholds(noise: DataFrame, share: float = 0.95) -> np.ndarray:
    """The percentile of each place among the draws; a number per item."""
    found = {r["rank"]: r["t"] for r in noise.groupBy("rank").agg(F.percentile("e", F.lit(share)).alias("t")).collect()}
    return np.array([found[k] for k in sorted(found)])


def permutation_analysis(df: DataFrame, column: str, row_id: Column, draws: int = 100, share: float = 0.95, seed: int = 0, part_rows: int = PART_ROWS) -> dict:
    """Parallel analysis against permuted items: `total` eigenvalues over the noise, and `leading` ones before the first that isn't; the two differ where a later one rises again."""
    real = mo.eigenvalues(mo.Moments.of(sum(mo.sums_by(df, column, F.lit(0)).values())).correlations())
    limit = thresholds(permuted_eigenvalues(df, column, row_id, draws, seed, part_rows), share)
    return {"total": int((real > limit).sum()), "leading": mo.leading(real > limit), "eigenvalues": real, "thresholds": limit}


def shuffle_control(df: DataFrame, column: str, row_id: Column, draws: int = 100, alpha: float = 0.05, seed: int = 0, times: float = 2.0, least: int = 2) -> dict:
    """Parallel analysis of data whose items are permuted, which has no factors but by chance: passes if it finds at most max(least, times * alpha * items).

    The last draw stands for the shuffled data; the others are its noise, as a permutation of permuted items is one of the items.
    """
    noise = permuted_eigenvalues(df, column, row_id, draws + 1, seed)
    noise = noise.persist()  # items x draws numbers
    try:
        limit = thresholds(noise.where(F.col("draw") < draws), 1 - alpha)
        shuffled = np.array([r.e for r in noise.where(F.col("draw") == draws).orderBy("rank").collect()])
    finally:
        noise.unpersist()
    n, tolerance = int((shuffled > limit).sum()), max(least, int(np.ceil(times * alpha * len(limit))))
    return {"n_factors": n, "n_items": len(limit), "expected": alpha * len(limit), "tolerance": tolerance, "passes": n <= tolerance}


# --- rows x items --------------------------------------------------------------------------------------------------


def thomson_weights(load: np.ndarray, unique: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Seen items x factors: what turns centred answers to the seen items into regression scores."""
    l, psi = load[seen], np.maximum(unique[seen], 1e-6)
    inside = np.linalg.inv(np.eye(load.shape[1]) + (l.T / psi) @ l)
    return (l / psi[:, None]) @ (np.eye(load.shape[1]) - inside @ ((l.T / psi) @ l))


def centred(g: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sums of products around `mean`, from sums of products whose last row and column are the plain sums."""
    s = g[:-1, -1]
    return g[:-1, :-1] - np.outer(mean, s) - np.outer(s, mean) + g[-1, -1] * np.outer(mean, mean)


def choose_items(rng: np.random.Generator, n_items: int, seen: int, load: np.ndarray | None = None) -> np.ndarray:
    """Items to be seen; with loadings as many of each factor's own, and others until there are enough."""
    if load is None:
        return np.sort(rng.choice(n_items, seen, replace=False))
    top, k = np.abs(load).argmax(axis=1), load.shape[1]
    picks: list[int] = []
    for f in range(k):
        own = np.flatnonzero(top == f)
        picks += rng.choice(own, min(max(1, seen // k), len(own)), replace=False).tolist() if len(own) else []
    rest = np.setdiff1d(np.arange(n_items), picks)
    picks += rng.choice(rest, min(max(0, seen - len(picks)), len(rest)), replace=False).tolist()
    return np.sort(np.array(picks[:seen]))


def cross_products(rows: DataFrame, draws: int, seed: int, part_rows: int = PART_ROWS) -> dict[int, np.ndarray]:
    """By draw the sums over rows of [x of another row, 1] times [x, 1]: each part's rows are paired with a permutation of themselves. rows: id, x."""

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in whole_parts(batches):
            x = np.c_[np.stack(pdf["x"].to_numpy()), np.ones(len(pdf))]
            for d in range(draws):
                order = np.random.default_rng([seed, d, int(pdf["part"].iloc[0])]).permutation(len(x))
                total[d] = total.get(d, 0) + x[order].T @ x
        for d, g in total.items():
            yield pd.DataFrame({"key": [d], "s": [g.ravel()]})

    found = summed(in_parts(rows, part_rows).mapInPandas(products, "key long, s array<double>")).toLocalIterator()
    return {r.key: np.array(r.s).reshape(int(np.sqrt(len(r.s))), -1) for r in found}


def row_item_validation(
    df: DataFrame, column: str, row_id: Column, k: int, share: float = 0.7, strata: tuple[str, ...] = (), seen: int | None = None, balanced: bool = False, trials: int = 5, splits: int = 1, method: str = "principal", rotation: str | None = "oblimin", seed: int = 42
) -> DataFrame:
    """(item, main, shuffle, fewer, item_mean): R2 of items that weren't seen, of rows that weren't fitted, averaged over splits and trials.

    Rows fall into A and B by `halves` (share of each stratum in A). Factors are fitted to A; of each trial some items of
    B are seen, their regression scores predict the others. fewer: with k - 1 factors (A's means where k is 1); shuffle:
    with the scores of other rows; item_mean: A's means. Items that don't vary in B have nulls.
    """
    rng, dims = np.random.default_rng(seed), 0
    found: dict[str, list[dict[int, float]]] = {name: [] for name in ("main", "shuffle", "fewer", "item_mean")}
    kept = df.withColumns({"__id": row_id.cast("long"), "__all": F.lit(0)})
    for split in range(splits):
        sides = halves(kept, share, seed + 1000 + split, list(strata) or ["__all"], "__id")
        sums = mo.sums_by(sides, column, (F.col("side") == "B").cast("int"))
        if len(sums) < 2:
            raise ValueError("too few rows to split")
        a, dims = mo.Moments.of(sums[0]), len(sums[0]) - 1
        c = centred(sums[1], a.mean)
        whole = mo.Moments.of(sums[1]).cov.diagonal() * sums[1][-1, -1]
        mixed = cross_products(vectors(sides.where("side = 'B'"), column, F.col("__id")), trials, seed + split)
        r = a.correlations()
        full = mo.factor_solution(r, k, method, rotation)
        less = mo.factor_solution(r, k - 1, method, rotation) if k > 1 else None
        wanted = seen if seen is not None else max(20, 3 * k)
        wanted = min(wanted, dims - 5) if wanted >= dims - 5 else wanted
        if wanted < 1:
            raise ValueError(f"too few items: {dims}")

        def errors(s: mo.Solution, at: np.ndarray, out: np.ndarray, cross: np.ndarray) -> np.ndarray:
            """Squared errors of the unseen items; cross: sums of products of what is seen (rows) with what is true."""
            b = thomson_weights(s.loadings, 1 - s.communalities, at) @ s.loadings[out].T
            return c[out, out] - 2 * (b * cross[np.ix_(at, out)]).sum(axis=0) + (b * (c[np.ix_(at, at)] @ b)).sum(axis=0)

        def shares_of(error: np.ndarray, at: np.ndarray) -> dict[int, float]:
            return {int(j): 1 - e / max(whole[j], 1e-12) for j, e in zip(at, error) if whole[j] > 0}

        for trial in range(trials):
            at = choose_items(rng, dims, wanted, full.loadings if balanced else None)
            out = np.setdiff1d(np.arange(dims), at)
            p = mixed[trial]
            other = p[:-1, :-1] - np.outer(a.mean, p[-1, :-1]) - np.outer(p[:-1, -1], a.mean) + p[-1, -1] * np.outer(a.mean, a.mean)
            found["main"].append(shares_of(errors(full, at, out, c), out))
            found["shuffle"].append(shares_of(errors(full, at, out, other), out))
            found["fewer"].append(shares_of(errors(less, at, out, c) if less else c[out, out], out))
        found["item_mean"].append(shares_of(c.diagonal(), np.arange(dims)))
    mean = lambda name, j: float(np.mean(v)) if (v := [f[j] for f in found[name] if j in f]) else None
    return df.sparkSession.createDataFrame([(j, *(mean(name, j) for name in found)) for j in range(dims)], "item int, main double, shuffle double, fewer double, item_mean double")


def validation_summary(r2: DataFrame) -> DataFrame:
    """(main, shuffle, fewer, item_mean, passes_shuffle, passes_fewer, passes) of row_item_validation's means over items.

    Against shuffled scores: their gain over the means, if any, must be doubled by the gain of the right scores over them;
    without one, the right scores must only be the better.
    """
    m = r2.agg(*(F.avg(c).alias(c) for c in ("main", "shuffle", "fewer", "item_mean")))
    gain, by_chance = F.col("main") - F.col("shuffle"), F.col("shuffle") - F.col("item_mean")
    shuffle = F.when(by_chance > 0, (F.col("main") > 0) & (gain >= 2 * by_chance)).otherwise((F.col("main") > F.col("item_mean")) & (gain > 0))
    return m.withColumn("passes_shuffle", shuffle).withColumn("passes_fewer", F.col("main") > F.col("fewer")).withColumn("passes", F.col("passes_shuffle") & F.col("passes_fewer"))


# --- held-out items ------------------------------------------------------------------------------------------------


def step_up(p_values: DataFrame, p: str, alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows with `significant`: Benjamini and Hochberg's step-up, all up to the last p value that is at most its place's share of alpha. A row per test."""
    every, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(p)
    n = F.count(p).over(every)
    # of equal p values the last place counts, which a range frame gives
    place = F.count(p).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    limit = F.max(F.when(F.col(p) <= place / n * alpha, F.col(p))).over(every)
    return p_values.withColumn("significant", F.coalesce(F.col(p) <= limit, F.lit(False)))


def ols_r2(train: np.ndarray, test: np.ndarray, n_scores: int) -> np.ndarray:
    """R2 of each target on the test rows, by least squares on the train rows. Both: sums of products of [scores, 1, targets]."""
    q = n_scores + 1
    b = np.linalg.pinv(train[:q, :q]) @ train[:q, q:]
    n, own = test[n_scores, n_scores], test[q:, q:].diagonal()
    error = own - 2 * (b * test[:q, q:]).sum(axis=0) + (b * (test[:q, :q] @ b)).sum(axis=0)
    whole = own - test[n_scores, q:] ** 2 / max(n, 1)
    return np.where(whole > 0, 1 - error / np.maximum(whole, 1e-12), np.nan)


def item_holdout(
    df: DataFrame, column: str, row_id: Column, held: list[int], k: int, folds: int = 5, permutations: int = 100, alpha: float = 0.05, floor: float = 0.0, method: str = "principal", rotation: str | None = "oblimin", seed: int = 42, part_rows: int = PART_ROWS
) -> DataFrame:
    """(item, r2, p_value, significant, passes): how well factor scores of the other items predict each held-out item, beside permuted scores.

    Regression scores are columns of the rows; the rest follows from sums of products by fold (a hash of the id): least
    squares on the other folds, R2 on the fold, the mean over folds. p is the share of permutations (of the scores' rows,
    within parts) whose R2 is as high; significant by the step-up over all held-out items; passes if R2 reaches `floor` too.
    """
    g = sum(mo.sums_by(df, column, F.lit(0)).values())
    items = len(g) - 1
    train = np.setdiff1d(np.arange(items), held)
    m = mo.Moments.of(g)
    sub = mo.Moments(m.n, m.mean[train], m.cov[np.ix_(train, train)])
    r = sub.correlations()
    weights = np.zeros((items, k))
    weights[train] = mo.score_weights(r, mo.factor_solution(r, k, method, rotation))
    scored = mo.with_scores(vectors(df, column, row_id), "x", m, weights)
    u = scored.select("id", "scores", F.array(*(F.get("x", F.lit(j)) for j in held)).alias("y"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)).cast("int").alias("fold"))

    def products(batches):
        """By draw (the last: as they are) and fold the sums of products of [scores, 1, targets]."""
        total: dict[int, np.ndarray] = {}
        for pdf in whole_parts(batches):
            s, y, fold = np.stack(pdf["scores"].to_numpy()), np.stack(pdf["y"].to_numpy()), pdf["fold"].to_numpy()
            for d in range(permutations + 1):
                order = np.random.default_rng([seed, d, int(pdf["part"].iloc[0])]).permutation(len(s)) if d < permutations else slice(None)
                z = np.c_[s[order], np.ones(len(s)), y]
                for f in np.unique(fold):
                    own = z[fold == f]
                    total[d * folds + int(f)] = total.get(d * folds + int(f), 0) + own.T @ own
        for key, t in total.items():
            yield pd.DataFrame({"key": [key], "s": [t.ravel()]})

    def by_draw(pdf: pd.DataFrame) -> pd.DataFrame:
        gs = [np.asarray(s).reshape(k + 1 + len(held), -1) for s in pdf["s"]]
        every = sum(gs)
        r2 = np.mean([ols_r2(every - t, t, k) for t in gs], axis=0)
        return pd.DataFrame({"draw": int(pdf["key"].iloc[0]) // folds, "item": np.array(held, dtype=np.int32), "r2": r2})

    sums = summed(in_parts(u, part_rows).mapInPandas(products, "key long, s array<double>"))
    r2 = sums.groupBy(F.expr(f"key div {folds}").alias("d")).applyInPandas(by_draw, "draw int, item int, r2 double")
    real, null = r2.where(F.col("draw") == permutations).select("item", "r2"), r2.where(F.col("draw") < permutations).select("item", F.col("r2").alias("other"))
    p = real.join(null, "item").groupBy("item", "r2").agg(F.avg((F.col("other") >= F.col("r2")).cast("double")).alias("p_value"))
    return step_up(p, "p_value", alpha).withColumn("passes", F.col("significant") & (F.col("r2") >= floor))


# --- split items ---------------------------------------------------------------------------------------------------


def item_halves(groups: list, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two random halves of the items, as many of each group in either."""
    rng, a, b = np.random.default_rng(seed), [], []
    for g in sorted(set(groups), key=str):
        own = rng.permutation([j for j, x in enumerate(groups) if x == g])
        a += own[: len(own) // 2].tolist()
        b += own[len(own) // 2 : len(own) // 2 * 2].tolist()
    return np.sort(np.array(a, dtype=int)), np.sort(np.array(b, dtype=int))


def matched_scores(m: mo.Moments, a: np.ndarray, b: np.ndarray, k: int, method: str = "principal", rotation: str | None = "oblimin", least: float = 1e-10) -> list[float]:
    """Correlations of the paired factors' scores, of solutions over two sets of items: Wa' R_ab Wb over their deviations. No score is made; items that don't vary are left out."""
    live = m.cov.diagonal() > least
    a, b = a[live[a]], b[live[b]]
    if min(len(a), len(b)) < k + 1:
        return []
    r = m.correlations()
    w = [mo.score_weights(r[np.ix_(x, x)], mo.factor_solution(r[np.ix_(x, x)], k, method, rotation)) for x in (a, b)]
    sd = [np.sqrt(np.maximum(((r[np.ix_(x, x)] @ v) * v).sum(axis=0), 1e-300)) for x, v in zip((a, b), w)]
    phi = (w[0].T @ r[np.ix_(a, b)] @ w[1]) / np.outer(*sd)
    return [float(phi[i, j]) for i, j, _ in mo.best_pairs(phi)]


def split_items(df: DataFrame, column: str, k: int, groups: list, draws: int = 10, by_group: bool = True, seed: int = 42, **options) -> DataFrame:
    """(split, factor, r): do factors of some items agree with those of others?

    Random halves balanced by the items' groups, half_0 and so on; with by_group also each group against the rest and
    each two groups. All from one matrix of correlations.
    """
    m = mo.Moments.of(sum(mo.sums_by(df, column, F.lit(0)).values()))
    if len(groups) != len(m.mean):
        raise ValueError(f"{len(groups)} groups of {len(m.mean)} items")
    names = sorted(set(groups), key=str)
    of = lambda some: np.flatnonzero([g in some for g in groups])
    sets = [(f"half_{d}", *item_halves(groups, seed + d)) for d in range(draws)]
    if by_group and len(names) > 1:
        sets += [(f"{g} vs rest", of([g]), of([x for x in names if x != g])) for g in names]
        sets += [(f"{g} vs {h}", of([g]), of([h])) for i, g in enumerate(names) for h in names[i + 1 :]] if len(names) > 2 else []
    rows = [(name, f, r) for name, a, b in sets for f, r in enumerate(matched_scores(m, a, b, k, **options))]
    return df.sparkSession.createDataFrame(rows, "split string, factor int, r double")


def split_summary(found: DataFrame) -> DataFrame:
    """(factor, n, median, mean, p10, p90) of |r| over the splits."""
    size = F.abs("r")
    q = F.percentile(size, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return found.groupBy("factor").agg(F.count("*").alias("n"), q[1].alias("median"), F.avg(size).alias("mean"), q[0].alias("p10"), q[2].alias("p90"))


# --- resampled correlations ----------------------------------------------------------------------------------------

#: Shares of the Poisson law of mean 1 up to 0, 1, 2 .. 11.
STEPS = mo.POISSON.tolist()


def share(*of: Column) -> Column:
    """A number from 0 up to 1 by a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def poisson(u: Column) -> Column:
    """How many of the steps, which ascend, a share has passed: a chain of cases, which most rows leave at its first ones."""
    out = F.when(u <= STEPS[0], 0)
    for n, step in enumerate(STEPS[1:], 1):
        out = out.when(u <= step, n)
    return out.otherwise(len(STEPS))


def weight(*of: Column) -> Column:
    """A Poisson number by a hash."""
    return poisson(share(*of))


def weighted_ranks(cells: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, value, name): mean ranks of values that stand w times, from the counted values of each group."""
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = cells.groupBy(*by, value).agg(F.sum("w").alias("__w"))
    return counts.select(*by, value, (F.sum("__w").over(w) - (F.col("__w") - 1) / 2).alias(name))


def weighted_correlation(cells: DataFrame, by: list[str], x: str, y: str, ranks: bool) -> DataFrame:
    """(by, n, r): correlation of rows that stand w times, of their ranks if asked; r is null where one side doesn't vary."""
    if ranks:
        for side, name in ((x, "__rx"), (y, "__ry")):
            cells = cells.join(weighted_ranks(cells, by, side, name), [*by, side])
        x, y = "__rx", "__ry"
    n = F.sum("w")
    # ranks and values are taken around each group's mean, so that squares don't lose digits
    middle = cells.groupBy(*by).agg(n.alias("n"), (F.sum(F.col("w") * F.col(x)) / n).alias("__mx"), (F.sum(F.col("w") * F.col(y)) / n).alias("__my")).where("n > 0")
    around = cells.join(middle, by).select(*by, "n", "w", (F.col(x) - F.col("__mx")).alias("a"), (F.col(y) - F.col("__my")).alias("b"))
    s = around.groupBy(*by, "n").agg(*(F.sum(F.col("w") * F.col(p) * F.col(q)).alias(p + q) for p, q in ("aa", "bb", "ab")))
    tiny = lambda c: F.col(c) <= 1e-12 * F.col("n")
    return s.select(*by, "n", F.when(~tiny("aa") & ~tiny("bb"), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("r"))


def paired_bootstrap(df: DataFrame, keys: list[str], x: str, y: str, *ids: str, method: str = "spearman", draws: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(keys, n, r, low, high): correlation of pairs with the percentile interval of draws in which each pair counts a Poisson number of times.

    Pairs with a null or non-finite side are left out; r, low and high are null with fewer than three pairs or where a
    side doesn't vary; a draw without a correlation counts as 0. Pairs are counted by value and draw where they are read,
    so no group of rows comes together: a window for ranks holds the distinct values of one key and draw. The counts are
    written once, so that the draws aren't made anew for each sum over them; draw 0 is the pairs themselves.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"method must be spearman or pearson, not {method!r}")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    pairs = df.select(*keys, *ids, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where(finite("__x") & finite("__y"))
    # rows that a draw leaves out are told by their share, before it becomes a weight
    u = F.when(F.col("draw") == 0, STEPS[1]).otherwise(share(F.lit(seed), F.col("draw"), *map(F.col, ids)))
    drawn = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("__u", u).where(F.col("__u") > STEPS[0]).withColumn("w", poisson(F.col("__u")))
    cells = scratch.written(drawn.groupBy(*keys, "draw", "__x", "__y").agg(F.sum("w").alias("w")), "draws")
    each = weighted_correlation(cells, [*keys, "draw"], "__x", "__y", method == "spearman")
    own = each.where("draw = 0").drop("draw")
    q = F.percentile(F.coalesce("r", F.lit(0.0)), F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2)))
    ends = each.where("draw > 0").groupBy(*keys).agg(q.alias("__q"))
    known = (F.col("n") >= 3) & F.col("r").isNotNull()
    return own.join(ends, keys, "left").select(*keys, "n", *(F.when(known, c).alias(name) for name, c in (("r", F.col("r")), ("low", F.col("__q")[0]), ("high", F.col("__q")[1]))))


def convergent_validity(scores: DataFrame, traits: DataFrame, **options) -> DataFrame:
    """(factor, trait, n, r, low, high) of scores (id, factor, score) and traits (id, trait, value) of the same rows."""
    return paired_bootstrap(scores.join(traits, "id"), ["factor", "trait"], "score", "value", "id", **options)


def validity_verdict(matrix: DataFrame, least: float = 0.30, hits: int = 3) -> DataFrame:
    """(n_traits, n_hits, passes): how many traits have a factor whose |r| is `least` or more; `hits` of them are wanted."""
    best = matrix.groupBy("trait").agg(F.max(F.abs("r")).alias("top"))
    return best.agg(F.count("*").alias("n_traits"), F.count_if(F.col("top") >= least).alias("n_hits"), (F.count_if(F.col("top") >= least) >= hits).alias("passes"))
