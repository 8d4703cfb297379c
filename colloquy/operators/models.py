"""Factor models from moments: how many factors there are, extraction and rotation, comparison of solutions, resampling.

Spark adds up products of items, by split, fold or bootstrap draw; numpy sees matrices whose sides are items or
factors, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .factors import dot, principal_axes, varimax

#: Factors that the curves are followed up to, if nothing else is said.
MOST = 15


@dataclass(frozen=True)
class Moments:
    """Rows, means and covariance (by n) of items."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(g: np.ndarray) -> Moments:
        """From sums of products whose last row and column are the plain sums."""
        n = g[-1, -1]
        mean = g[-1, :-1] / max(n, 1)
        return Moments(float(n), mean, g[:-1, :-1] / max(n, 1) - np.outer(mean, mean))

    def correlations(self) -> np.ndarray:
        """1 on the diagonal, 0 beside it for items that don't vary."""
        sd = np.sqrt(np.maximum(np.diag(self.cov), 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where((sd[:, None] > 0) & (sd > 0), self.cov / np.outer(sd, sd), 0.0)
        np.fill_diagonal(r, 1.0)
        return r


def sums_by(df: DataFrame, column: str, key: Column, draws: int = 0, seed: int = 0) -> dict[int, np.ndarray]:
    """Sums of products of a vector column (and 1) by a whole-number key, or by bootstrap draw.

    With draws, each row counts a Poisson number of times in each, by a hash of its key, which must then tell rows apart.
    Only sums, a row for each key and pair of items, are shuffled and brought to the driver.
    """

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.c_[np.stack(pdf["x"].to_numpy()).astype(float), np.ones(len(pdf))]
            keys = pdf["key"].to_numpy()
            if draws:
                for d in range(draws):
                    u = (pd.util.hash_array((keys.astype(np.int64) * draws + d) ^ (seed << 40)) >> np.uint64(11)) / float(1 << 53)
                    w = np.searchsorted(POISSON, u, side="right")
                    total[d] = total.get(d, 0) + (x * w[:, None]).T @ x
            else:
                for k in np.unique(keys):
                    own = x[keys == k]
                    total[int(k)] = total.get(int(k), 0) + own.T @ own
        for k, g in total.items():
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"key": k, "i": i.ravel(), "j": j.ravel(), "s": g.ravel()})

    whole = F.col(column).isNotNull() & ~F.coalesce(F.exists(column, lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    rows = df.where(whole).select(key.cast("long").alias("key"), F.col(column).alias("x"))
    found = rows.mapInPandas(products, "key long, i long, j long, s double").groupBy("key", "i", "j").agg(F.sum("s").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    size = max((r.i for r in found), default=-1) + 1
    for r in found:
        out.setdefault(r.key, np.zeros((size, size)))[r.i, r.j] = r.s
    return out


POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


# The words by which the rules below say what their answer means.
# --- how many factors ----------------------------------------------------------------------------------------------


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * lead)
    b, c = x + 1 - a, 1e300
    h = d = 1 / b
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * lead


def adequacy(n: float, r: np.ndarray) -> dict:
    """Bartlett's test of sphericity, and the Kaiser-Meyer-Olkin measure overall and by item."""
    p = len(r)
    chi2 = -(n - 1 - (2 * p + 5) / 6) * float(np.linalg.slogdet(r)[1])
    inverse = np.linalg.pinv(r)
    d = np.sqrt(np.abs(np.diag(inverse)))
    partial = (inverse / np.outer(d, d)) ** 2
    square = r**2
    np.fill_diagonal(partial, 0)
    np.fill_diagonal(square, 0)
    return {"chi2": chi2, "p": upper_gamma(p * (p - 1) / 4, chi2 / 2), "kmo": square.sum() / (square.sum() + partial.sum()), "kmo_by_item": square.sum(axis=0) / (square.sum(axis=0) + partial.sum(axis=0))}


def eigenvalues(r: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh(r)[::-1]


def leading(passes: np.ndarray) -> int:
    """How many are true before the first that isn't."""
    return int(np.argmin(np.r_[passes, False]))


def map_test(r: np.ndarray, most: int = MOST) -> dict:
    """Velicer's minimum average partial, with second and fourth powers: the number of components after which it is least."""
    values, vectors = np.linalg.eigh(r)
    values, vectors = values[::-1], vectors[:, ::-1]
    off = ~np.eye(len(r), dtype=bool)
    curve = [(float((r[off] ** 2).mean()), float((r[off] ** 4).mean()))]
    for k in range(1, min(most, len(r) - 2) + 1):
        rest = r - (vectors[:, :k] * values[:k]) @ vectors[:, :k].T
        d = np.diag(rest)
        if values[k - 1] <= 0 or (d <= 0).any():
            break
        rest = (rest / np.sqrt(np.outer(d, d)))[off]
        curve.append((float((rest**2).mean()), float((rest**4).mean())))
    two, four = (int(np.argmin([c[i] for c in curve])) for i in (0, 1))
    last = len(curve) - 1
    return {"k": two, "k4": four, "saturated": last >= 1 and last in (two, four), "semantics": "argmin"}


def empirical_kaiser(n: float, eigen: np.ndarray) -> dict:
    """Eigenvalues over what noise would leave to them, 1 at least; those before the first that isn't count."""
    p = len(eigen)
    before = np.r_[0, np.cumsum(eigen)[:-1]]
    limit = np.maximum((1 + math.sqrt(p / n)) ** 2 * np.maximum(p - before, 0) / np.maximum(p - np.arange(p), 1), 1)
    return {"k": leading(eigen > limit), "total": int((eigen > limit).sum()), "semantics": "leading_run"}


def acceleration(eigen: np.ndarray, most: int | None = MOST) -> dict:
    """The number of eigenvalues before the sharpest bend: the largest second difference, 0 if none is positive."""
    bend = np.diff(eigen[:most], 2)
    return {"k": int(bend.argmax()) + 1 if len(bend) and bend.max() > 0 else 0, "semantics": "argmax_second_diff"}


def optimal_coordinates(eigen: np.ndarray, most: int | None = MOST) -> dict:
    """Eigenvalues over the line through those after them, before the first that isn't."""
    e = eigen[:most]
    p = len(e)
    over = []
    for k in range(1, p - 1):
        x = np.arange(k + 1, p + 1)
        slope, at = np.polyfit(x, e[k:], 1)
        over.append(e[k - 1] > at + slope * k)
    return {"k": leading(np.array(over, dtype=bool)), "semantics": "leading_run"}


def scree_elbow(eigen: np.ndarray, most: int | None = MOST) -> dict:
    """The eigenvalues before the one farthest from the line between the first and the last."""
    e = eigen[:most]
    if len(e) < 4:
        return {"k": 0, "semantics": "cattell_retain_above_knee"}
    x = np.arange(len(e))
    away = np.abs(e - (e[0] + (e[-1] - e[0]) * x / x[-1]))
    return {"k": int(away[1:-1].argmax()) + 1, "semantics": "cattell_retain_above_knee"}


def kaiser(eigen: np.ndarray) -> dict:
    return {"k": int((eigen > 1).sum()), "semantics": "total_count_above_threshold", "reference_only": True}


def cross_validated(folds: dict[int, np.ndarray], most: int = MOST) -> dict:
    """The number of factors under which held-out folds are likeliest: Gaussian, fitted to the other folds' moments; also by one standard error.

    folds: sums_by of the rows' fold. Only moments are needed, for the fit as for the likelihood.
    """
    every = sum(folds.values())
    losses = []
    for g in folds.values():
        train, test = Moments.of(every - g), Moments.of(g)
        sd = np.sqrt(np.maximum(np.diag(train.cov), 1e-12))
        r = train.correlations()
        shift = (test.mean - train.mean) / sd
        s = test.cov / np.outer(sd, sd) + np.outer(shift, shift)
        own = []
        for k in range(1, most + 1):
            load = principal_axes(r, k)
            model = load @ load.T + np.diag(np.maximum(1 - (load**2).sum(axis=1), 0.005))
            own.append(0.5 * (np.linalg.slogdet(model)[1] + np.trace(np.linalg.solve(model, s))))
        losses.append(own)
    mean, error = np.mean(losses, axis=0), np.std(losses, axis=0, ddof=1) / math.sqrt(len(losses))
    best = int(mean.argmin())
    return {"k": best + 1, "k_1se": int(np.argmax(mean <= mean[best] + error[best])) + 1, "saturated": best + 1 == most, "semantics": "argmin"}


def suggest(n: float, r: np.ndarray, folds: dict[int, np.ndarray] | None = None, most: int = MOST) -> dict[str, dict]:
    """What each rule says; every answer carries the rule's semantics, as they can't be compared without."""
    eigen = eigenvalues(r)
    out = {
        "map": map_test(r, most), "empirical_kaiser": empirical_kaiser(n, eigen), "acceleration": acceleration(eigen, most),
        "optimal_coordinates": optimal_coordinates(eigen, most), "scree_elbow": scree_elbow(eigen, most), "kaiser": kaiser(eigen),
    }
    return out | ({"cross_validated": cross_validated(folds, min(most, len(r) - 1))} if folds else {})


# --- extraction and rotation ---------------------------------------------------------------------------------------


def maximum_likelihood(r: np.ndarray, k: int, rounds: int = 2000, close: float = 1e-9) -> np.ndarray:
    """Loadings of the likeliest model, by expectation and maximisation from the principal axes."""
    load = principal_axes(r, k)
    unique = np.clip(1 - (load**2).sum(axis=1), 0.005, 1)
    for _ in range(rounds):
        beta = np.linalg.solve(load @ load.T + np.diag(unique), load).T
        cross = r @ beta.T
        new = cross @ np.linalg.inv(np.eye(k) - beta @ load + beta @ cross)
        moved = np.abs(new - load).max()
        load, unique = new, np.clip(np.diag(r) - (new * cross).sum(axis=1), 0.005, 1)
        if moved < close:
            break
    values, vectors = np.linalg.eigh(load.T @ (load / unique[:, None]))
    load = load @ vectors[:, ::-1]
    return load * np.where(load.sum(axis=0) < 0, -1, 1)


def promax(load: np.ndarray, power: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, correlations of factors): varimax loadings turned toward their own powers."""
    start = varimax(load)
    turn = np.linalg.lstsq(start, start * np.abs(start) ** (power - 1), rcond=None)[0]
    turn = turn * np.sqrt(np.diag(np.linalg.inv(turn.T @ turn)))
    inverse = np.linalg.inv(turn)
    return start @ turn, inverse @ inverse.T


def oblimin(load: np.ndarray, gamma: float = 0.0, rounds: int = 1000, close: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, correlations of factors) of the direct oblimin criterion, by gradient projection."""
    p, k = load.shape
    n = np.ones((k, k)) - np.eye(k)
    c = np.eye(p) - gamma / p

    def criterion(pattern: np.ndarray) -> tuple[float, np.ndarray]:
        squares = pattern**2
        other = c @ squares @ n
        return float((squares * other).sum() / 4), pattern * other

    t = np.eye(k)
    inverse = np.linalg.inv(t)
    pattern = load @ inverse.T
    value, slope = criterion(pattern)
    step = 1.0
    for _ in range(rounds):
        g = -(pattern.T @ slope @ inverse).T
        down = g - t * (t * g).sum(axis=0)
        size = np.linalg.norm(down)
        if size < close:
            break
        step *= 2
        for _ in range(20):
            x = t - step * down
            x = x / np.sqrt((x**2).sum(axis=0))
            inverse = np.linalg.inv(x)
            new = load @ inverse.T
            now, gradient = criterion(new)
            if now < value - 0.5 * size**2 * step:
                break
            step /= 2
        t, pattern, value, slope = x, new, now, gradient
    return pattern, t.T @ t


@dataclass(frozen=True)
class Solution:
    """loadings: items x factors; phi: correlations of factors; communalities, and each factor's share of the variance."""

    loadings: np.ndarray
    phi: np.ndarray
    communalities: np.ndarray
    shares: np.ndarray


def factor_solution(r: np.ndarray, k: int, method: str = "principal", rotation: str | None = "varimax") -> Solution:
    """method: principal or minres (both minimise what is left beside the diagonal; minres goes on until nothing moves) or ml; rotation: varimax, promax, oblimin or None."""
    rounds = {"principal": 100, "minres": 5000}
    if method not in (*rounds, "ml") or rotation not in ("varimax", "promax", "oblimin", None):
        raise ValueError(f"unknown method {method!r} or rotation {rotation!r}")
    load = maximum_likelihood(r, k) if method == "ml" else principal_axes(r, k, rounds[method])
    phi = np.eye(k)
    if rotation == "varimax" and k > 1:
        load = varimax(load)
    elif rotation and k > 1:
        load, phi = (promax if rotation == "promax" else oblimin)(load)
    return Solution(load, phi, ((load @ phi) * load).sum(axis=1), (load**2).sum(axis=0) / len(load))


def score_weights(r: np.ndarray, s: Solution) -> np.ndarray:
    """Items x factors: weights of standardised answers that give regression (Thomson) scores."""
    return np.linalg.pinv(r) @ s.loadings @ s.phi


def with_scores(df: DataFrame, column: str, m: Moments, weights: np.ndarray) -> DataFrame:
    """df with `scores`: (x - mean) / deviation times the weights, as column expressions; a row without its whole vector has none."""
    sd = np.sqrt(np.maximum(np.diag(m.cov), 1e-300))
    own = weights / sd[:, None]
    parts = [dot(F.col(column), F.array(*map(F.lit, own[:, k].tolist()))) - float(m.mean @ own[:, k]) for k in range(own.shape[1])]
    return df.withColumn("scores", F.array(*parts))


def components(m: Moments, k: int, standardise: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes: k x items, share of the variance of each, scale of the items) of principal components."""
    scale = np.sqrt(np.maximum(np.diag(m.cov), 0)) if standardise else np.ones(len(m.mean))
    scale = np.where(scale > 0, scale, 1)
    values, vectors = np.linalg.eigh(m.cov / np.outer(scale, scale))
    values, axes = values[::-1], vectors[:, ::-1].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]
    return axes[:k], values[:k] / values.sum(), scale


def back_projected(direction: np.ndarray, axes: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
    """A factor's direction in the space of the items, of length 1: through components, then through their scale."""
    out = direction if axes is None else direction @ axes
    out = out if scale is None else out * scale
    size = np.linalg.norm(out)
    return out / size if size > 1e-12 else out


# --- comparing solutions -------------------------------------------------------------------------------------------


def congruence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tucker's phi of each pair of columns."""
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=0)) > 0, n, 1)
    return unit(a).T @ unit(b)


def band(phi: float) -> str:
    """What a congruence is called. The bands' lower ends."""
    return next((name for name, low in (("equal", 0.95), ("fair", 0.85)) if abs(phi) >= low), "different")


def procrustes(ref: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(other turned onto ref, the turn), both of one shape."""
    if ref.shape != other.shape:
        raise ValueError(f"shapes differ: {ref.shape} and {other.shape}")
    u, _, v = np.linalg.svd(other.T @ ref)
    return other @ (u @ v), u @ v


def best_pairs(similarity: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, column, sign) of the pairing with the largest sum of absolute values; the smaller side is paired whole.

    Over sets of columns, for up to some fifteen factors.
    """
    if similarity.shape[0] > similarity.shape[1]:
        return sorted((r, c, s) for c, r, s in best_pairs(similarity.T))
    size = np.abs(similarity)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in size:
        now: dict[int, tuple[float, tuple[int, ...]]] = {}
        for taken, (total, chosen) in best.items():
            for c, v in enumerate(row):
                if not taken >> c & 1:
                    key, sum_ = taken | 1 << c, total + v
                    if key not in now or sum_ > now[key][0]:
                        now[key] = sum_, (*chosen, c)
        best = now
    chosen = max(best.values())[1]
    return [(r, c, 1.0 if similarity[r, c] >= 0 else -1.0) for r, c in enumerate(chosen)]


def compare(a: np.ndarray, b: np.ndarray, turn: bool = True) -> dict:
    """Pairs of factors of two solutions with their phi: b is turned onto a first if both have as many factors, and its paired factors are put in order and sign."""
    turned = procrustes(a, b)[0] if turn and a.shape == b.shape else b
    phi = congruence(a, turned)
    pairs = best_pairs(phi)
    return {"pairs": pairs, "phi": [float(phi[r, c]) for r, c, _ in pairs], "aligned": np.stack([turned[:, c] * s for _, c, s in pairs], axis=1), "matrix": phi, "median": float(np.median([abs(phi[r, c]) for r, c, _ in pairs]))}


def aligned_items(a: DataFrame, b: DataFrame, least: int = 10) -> DataFrame:
    """Loadings of two solutions (item, factor, loading) on the items that both have; fewer than `least` of them is an error."""
    shared = a.select("item").distinct().join(b.select("item").distinct(), "item")
    if shared.count() < least:
        raise ValueError(f"fewer than {least} items in common")
    return b.join(shared, "item", "left_semi")


def bootstrap_loadings(df: DataFrame, column: str, row_id: Column, k: int, draws: int = 100, confidence: float = 0.95, seed: int = 0) -> dict[str, np.ndarray]:
    """low, high, sign_stability (items x factors) of varimax loadings over Poisson draws, each turned onto the whole sample's."""
    whole = Moments.of(sum(sums_by(df, column, F.lit(0)).values()))
    anchor = factor_solution(whole.correlations(), k).loadings
    found = [procrustes(anchor, factor_solution(Moments.of(g).correlations(), k).loadings)[0] for g in sums_by(df, column, row_id, draws, seed).values()]
    low, high = np.quantile(found, [(1 - confidence) / 2, (1 + confidence) / 2], axis=0)
    return {"loadings": anchor, "low": low, "high": high, "sign_stability": (np.sign(found) == np.sign(anchor)).mean(axis=0), "share_clear": ((low > 0) | (high < 0)).mean(axis=1)}


def split_stability(df: DataFrame, column: str, split: Column, k: int, passes: float = 0.80) -> list[dict]:
    """Of each split (a whole number), the median congruence of its solution with that of all rows, and whether it passes."""
    parts = sums_by(df, column, split)
    anchor = factor_solution(Moments.of(sum(parts.values())).correlations(), k).loadings
    out = []
    for key in sorted(parts):
        m = Moments.of(parts[key])
        median = compare(anchor, factor_solution(m.correlations(), k).loadings)["median"]
        out.append({"split": key, "n": int(m.n), "median_phi": median, "stable": median >= passes})
    return out


def sensitivity(r: np.ndarray, k: int, least: float = 0.80) -> list[str]:
    """What becomes of each of k factors under one more and one fewer: split, merged or preserved."""
    base = factor_solution(r, k).loadings
    more = np.abs(congruence(base, factor_solution(r, k + 1).loadings)) >= least
    fewer = np.abs(congruence(base, factor_solution(r, k - 1).loadings)) >= least if k > 1 else np.ones((k, 1), dtype=bool)
    return ["split" if more[f].sum() >= 2 else "merged" if not fewer[f].any() else "preserved" for f in range(k)]


def anchored(ref: np.ndarray, refit: np.ndarray, anchors: list[int]) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """The refit factors in the order and sign of ref's, told by the loadings of anchor items alone."""
    pairs = best_pairs(congruence(ref[anchors], refit[anchors]))
    return np.stack([refit[:, c] * s for _, c, s in pairs], axis=1), pairs


def reduced(matrix: np.ndarray, rank: int) -> np.ndarray:
    """The best approximation of a rank, by singular values."""
    if not 1 <= rank <= min(matrix.shape):
        raise ValueError(f"no rank {rank} of a matrix {matrix.shape}")
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ v[:rank]


def reduced_product(b: np.ndarray, a: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(b', a') of a rank whose product is the best approximation of b @ a, which is never made."""
    qb, rb = np.linalg.qr(b)
    qa, ra = np.linalg.qr(a.T)
    u, s, v = np.linalg.svd(rb @ ra.T)
    if not 1 <= rank <= len(s):
        raise ValueError(f"no rank {rank} of factors of rank {len(s)}")
    return qb @ (u[:, :rank] * s[:rank]), v[:rank] @ qa.T


# --- tables of factors ---------------------------------------------------------------------------------------------


def trait_alignment(loadings: DataFrame, traits: DataFrame, top: int) -> DataFrame:
    """(factor, trait, n_top, n_pos, n_neg, mean_signed, mean_abs): how a factor's `top` largest loadings fall on the items' traits."""
    from pyspark.sql import Window as W

    size = F.abs(F.col("loading"))
    rank = F.row_number().over(W.partitionBy("factor").orderBy(size.desc(), "item"))  # as many rows as items
    own = loadings.withColumn("first", rank <= top).join(traits, "item")
    up = F.col("loading") >= 0
    return own.groupBy("factor", "trait").agg(F.count_if("first").alias("n_top"), F.count_if(F.col("first") & up).alias("n_pos"), F.count_if(F.col("first") & ~up).alias("n_neg"), F.avg("loading").alias("mean_signed"), F.avg(size).alias("mean_abs"))


def contrastive_direction(rows: DataFrame, score: Column, column: str, k: int) -> DataFrame:
    """(dim, direction): the mean vector of the k highest scores minus that of the k lowest, dim from 0, not scaled."""
    own = rows.select("vec_id", score.alias("s"), F.col(column).alias("x"))
    side = lambda order, sign: own.orderBy(order, "vec_id").limit(k).select(F.lit(sign).alias("sign"), F.posexplode("x").alias("dim", "v"))
    both = side(F.desc("s"), 1.0).unionByName(side(F.asc("s"), -1.0))
    mean = lambda sign: F.avg(F.when(F.col("sign") == sign, F.col("v").cast("double")))
    return both.groupBy("dim").agg((mean(1.0) - mean(-1.0)).alias("direction"))


def lagrangian_rank(rows: DataFrame, scores: str, factor: int, weight: float, quantile: float, n: int) -> DataFrame:
    """(side, rank, vec_id, objective): the n best of each end of a factor: +-score - weight * mean |other scores|, among the `quantile` most extreme scores (ties at the edge all count)."""
    if not 0 < quantile <= 0.5:
        raise ValueError(f"quantile must be over 0 and at most a half, not {quantile}")
    own, size = F.element_at(scores, factor + 1).cast("double"), F.array_size(scores)
    every = F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double")))
    base = rows.select("vec_id", own.alias("own"), ((every - F.abs(own)) / (size - 1)).alias("other"))
    edges = base.agg(F.expr(f"percentile_disc({quantile}) within group (order by own)").alias("low"), F.expr(f"percentile_disc({quantile}) within group (order by own desc)").alias("high"))
    near = base.join(F.broadcast(edges))

    def side(name: str, keep: Column, objective: Column) -> DataFrame:
        top = near.where(keep).select("vec_id", objective.alias("objective")).orderBy(F.desc("objective"), "vec_id").limit(n)
        ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("objective")).alias("o"), "vec_id"))).alias("r"))  # n rows
        return ranked.select(F.lit(name).alias("side"), F.posexplode("r").alias("k", "x")).select("side", (F.col("k") + 1).alias("rank"), "x.vec_id", (-F.col("x.o")).alias("objective"))

    high = side("high", F.col("own") >= F.col("high"), F.col("own") - weight * F.col("other"))
    return high.unionByName(side("low", F.col("own") <= F.col("low"), -F.col("own") - weight * F.col("other")))


def outlier_parts(rows: DataFrame, column: str, m: Moments, k: int) -> DataFrame:
    """(vec_id, l2, whitened, cosine): how far a vector is from the mean, the same in units of its first k components, and its cosine with the mean."""
    axes, _, _ = components(m, k, standardise=False)
    sd = np.sqrt(np.maximum(np.einsum("ki,ij,kj->k", axes, m.cov, axes) * m.n / max(m.n - 1, 1), 1e-300))
    lit = lambda x: F.array(*map(F.lit, np.asarray(x, dtype=float).tolist()))
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    away = F.zip_with(x, lit(m.mean), lambda a, b: a - b)
    parts = sum((F.pow(dot(away, lit(a)) / float(s), F.lit(2.0)) for a, s in zip(axes, sd)), F.lit(0.0))
    norm = float(np.linalg.norm(m.mean))
    cosine = dot(x, lit(m.mean)) / (F.sqrt(dot(x, x)) * norm + 1e-12) if norm > 1e-12 else F.lit(None).cast("double")
    return rows.select("vec_id", F.sqrt(dot(away, away)).alias("l2"), F.sqrt(parts).alias("whitened"), cosine.alias("cosine"))


def redundant_pairs(cells: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """(a, b, r) of items whose answers, turned by their sign (col, sign), correlate by `least` or more."""
    from .factors import correlations

    turned = cells.join(F.broadcast(signs), "col").withColumn("value", F.col("value") * F.col("sign"))
    return correlations(turned).where(F.col("r") >= least)


def r_squared(df: DataFrame, item: str, truth: str, guess: str) -> DataFrame:
    """(item, r2): 1 - squared errors / squares around the mean; null for an item that doesn't vary."""
    error, t = F.col(truth) - F.col(guess), F.col(truth)
    whole = F.var_pop(t) * F.count(t)
    return df.groupBy(item).agg(F.when(whole > 0, 1 - F.sum(error * error) / whole).alias("r2"))


def preprocessed(cells: DataFrame, n_items: int, drop_share: float, block: Column, least: float, group: DataFrame | None = None, epsilon: float = 1e-8) -> DataFrame:
    """Cells (k, col, value) after the whole chain: complete rows, steady rows, varied items, residuals by the rows' group (k, grp), items that still vary."""
    from .factors import complete_rows, residuals, steady_rows, varied_columns

    rows = steady_rows(complete_rows(cells, n_items), drop_share) if drop_share else complete_rows(cells, n_items)
    out = rows.join(varied_columns(rows, block, least).select("col"), "col", "left_semi")
    if group is None:
        return out
    out = residuals(out.join(group, "k", "left"), ["grp", "col"], "value").drop("grp")
    varied = out.groupBy("col").agg(F.var_pop("value").alias("v")).where(F.col("v") > epsilon)
    return out.join(varied, "col", "left_semi")
