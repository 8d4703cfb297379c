"""Statistics: column expressions over aggregates, quantiles of distributions, and bootstraps as grouped functions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = NormalDist().inv_cdf(0.975)


def std(x: Column | str, ddof: int) -> Column:
    """Standard deviation; 0 for a single value."""
    return F.coalesce((F.stddev_samp if ddof else F.stddev_pop)(x), F.lit(0.0))


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """(rate, low, high) of the Wilson interval; all 0 for n = 0."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p, m = F.try_divide(successes.cast("double"), n.cast("double")), n.cast("double")
    wide = 1 + z * z / m
    mid, half = (p + z * z / (2 * m)) / wide, z / wide * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    safe = lambda c: F.when(n > 0, c).otherwise(0.0)
    return safe(p), safe(F.greatest(F.lit(0.0), mid - half)), safe(F.least(F.lit(1.0), mid + half))


def binary(x: Column) -> Column:
    """x, which must be 0, 1 or null: anything else is an error when it is read."""
    return F.when(x.isNull() | x.isin(0, 1), x).otherwise(F.raise_error(F.concat(F.lit("not 0 or 1: "), x.cast("string"))).cast("double"))


def wilson_of(x: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """The same from values, which must be 0 or 1; nulls don't count."""
    own = binary(x.cast("double"))
    return wilson(F.sum(own), F.count(own), confidence)


def normal_half_width(x: Column, confidence: float = 0.95) -> Column:
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    return F.coalesce(z * F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two columns; null for fewer than two rows or a constant column."""
    sx, sy, sxy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return F.when((F.count(x) >= 2) & (sx > 0) & (sy > 0), F.try_divide(sxy, F.sqrt(sx * sy)))


def weighted_agreement(x: Column, y: Column) -> Column:
    """Agreement with quadratic weights: 1 - mean squared difference / that of independent raters."""
    apart = F.avg((x - y) * (x - y))
    chance = F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), F.lit(2.0))
    return F.when(chance > 0, 1 - apart / chance)


def slope(x: Column, y: Column, least: int = 3) -> Column:
    """Slope of y on x; null for fewer than `least` rows or a constant x."""
    return F.when((F.count(x) >= least) & (F.var_pop(x) > 0), F.try_divide(F.covar_pop(x, y), F.var_pop(x)))


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by the midpoint rule on a scale that flattens both ends' poles."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    n = 20_000
    t = (np.arange(n) + 0.5) / n * math.pi / 2  # u = sin(t) ** 2
    logs = (2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t))
    weight = np.exp(logs - logs.max())
    return float(weight[np.sin(t) ** 2 <= x].sum() / weight.sum())


def bisect(f, lo: float, hi: float) -> float:
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def student_t(p: float, df: float) -> float:
    """Quantile of Student's distribution, for p over a half."""
    return bisect(lambda t: 1 - beta_share(df / 2, 0.5, df / (df + t * t)) / 2 - p, 0.0, 1000.0)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution."""
    return bisect(lambda x: beta_share(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) - p, 0.0, 10_000.0)


@dataclass(frozen=True)
class Interval:
    """kind: std, normal, t, wilson, bootstrap, weighted; confidence as a share; draws of a bootstrap."""

    kind: str
    confidence: float = 0.95
    draws: int = 0

    @staticmethod
    def parse(spec: str) -> Interval:
        """std, ci95_from_std, ci95_from_ppf, ci95_from_wilson, ci95_from_bootstrap_1000, ci95_from_weighted_bootstrap_1000."""
        if spec == "std":
            return Interval("std")
        m = re.fullmatch(r"ci(\d+(?:\.\d+)?)_from_(?:(std|ppf|wilson)|(bootstrap|weighted_bootstrap)_(\d+))", spec)
        if not m or not 1 <= float(m[1]) < 100:
            raise ValueError(f"not an interval: {spec!r}")
        kind = {"std": "normal", "ppf": "t", "wilson": "wilson", "bootstrap": "bootstrap", "weighted_bootstrap": "weighted"}[m[2] or m[3]]
        return Interval(kind, float(m[1]) / 100, int(m[4] or 0))


def bca(values: np.ndarray, confidence: float = 0.95, draws: int = 1000, seed: int = 42) -> tuple[float, float]:
    """Bias-corrected and accelerated bootstrap interval of the mean; (0, 0) up to one value, (v, v) for equal ones."""
    v = np.sort(np.asarray(values, dtype=float))  # an order that doesn't depend on partitions
    if len(v) <= 1:
        return 0.0, 0.0
    if v[0] == v[-1]:
        return float(v[0]), float(v[0])
    rng = np.random.default_rng(seed)
    step = max(1, (1 << 22) // len(v))
    means = np.concatenate([v[rng.integers(0, len(v), (min(step, draws - lo), len(v)))].mean(axis=1) for lo in range(0, draws, step)])
    normal = NormalDist()
    below = ((means < v.mean()).sum() + 0.5 * (means == v.mean()).sum()) / draws
    z0 = normal.inv_cdf(min(max(below, 0.5 / draws), 1 - 0.5 / draws))
    jack = (v.sum() - v) / (len(v) - 1)
    gap = jack.mean() - jack
    a = float((gap**3).sum() / (6 * (gap**2).sum() ** 1.5))
    out = []
    for tail in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = z0 + normal.inv_cdf(tail)
        out.append(float(np.quantile(means, normal.cdf(z0 + z / (1 - a * z)))))
    return out[0], out[1]


def bootstrap_by_group(df: DataFrame, keys: list[str], value: str, confidence: float = 0.95, draws: int = 1000, seed: int = 42, weight: str | None = None) -> DataFrame:
    """(keys, n, mean, low, high): bootstrap interval of each group's mean.

    With a weight w each draw takes w * value + (1 - w) * noise. Values are counted before the shuffle, so that a hot
    group of repeated scores arrives as its distinct values; draws are multinomial over them.
    """
    cols = [value, weight] if weight else [value]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, *cols).agg(F.count("*").alias("n"))

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cols)
        x, n = pdf[value].to_numpy(float), pdf["n"].to_numpy()
        total, rng = int(n.sum()), np.random.default_rng(seed)
        if weight:
            w = pdf[weight].to_numpy(float)
            picks = rng.multinomial(total, n / total, size=draws)
            means = picks @ (w * x + (1 - w) * 0.5) / total
            means = means + rng.normal(size=draws) * np.sqrt(picks @ ((1 - w) ** 2 / 12)) / total  # the sum of many uniform noises
            low, high = (float(np.quantile(means, (1 + s * confidence) / 2)) for s in (-1, 1))
            mean = float((n * (w * x + (1 - w) * 0.5)).sum() / total)
        elif total <= 1:
            low = high = 0.0
            mean = float(x[0])
        elif x[0] == x[-1]:
            low = high = mean = float(x[0])
        else:
            mean = float((n * x).sum() / total)
            means = rng.multinomial(total, n / total, size=draws) @ x / total
            normal = NormalDist()
            below = ((means < mean).sum() + 0.5 * (means == mean).sum()) / draws
            z0 = normal.inv_cdf(min(max(below, 0.5 / draws), 1 - 0.5 / draws))
            gap = (x - mean) / (total - 1)  # jackknife means, all of a value alike
            a = float((n * gap**3).sum() / (6 * (n * gap**2).sum() ** 1.5))
            z = [z0 + normal.inv_cdf((1 + s * confidence) / 2) for s in (-1, 1)]
            low, high = (float(np.quantile(means, normal.cdf(z0 + k / (1 - a * k)))) for k in z)
        return pd.DataFrame([[*pdf.iloc[0][keys], total, mean, low, high]], columns=[*keys, "n", "mean", "low", "high"])

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return counted.groupBy(*keys).applyInPandas(interval, f"{kinds}, n long, mean double, low double, high double")


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, value: str, draws: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(keys, mean, low, high): clusters are drawn, then values inside each; the mean of the clusters' means.

    Only the distinct values of each cluster, with their counts, come together in a group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, cluster, value).agg(F.count("*").alias("n"))

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        parts = [(g[value].to_numpy(float), g["n"].to_numpy()) for _, g in pdf.sort_values([cluster, value]).groupby(cluster, sort=True)]
        own = np.array([(x * n).sum() / n.sum() for x, n in parts])
        inside = np.stack([rng.multinomial(int(n.sum()), n / n.sum(), size=(draws, len(parts))) @ x / n.sum() for x, n in parts], axis=2)
        picks = rng.integers(0, len(parts), (draws, len(parts)))
        means = np.take_along_axis(inside, picks[:, :, None], axis=2)[:, :, 0].mean(axis=1)
        low, high = (float(np.quantile(means, (1 + s * confidence) / 2)) for s in (-1, 1))
        return pd.DataFrame([[*pdf.iloc[0][keys], float(own.mean()), low, high]], columns=[*keys, "mean", "low", "high"])

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return counted.groupBy(*keys).applyInPandas(interval, f"{kinds}, mean double, low double, high double")
