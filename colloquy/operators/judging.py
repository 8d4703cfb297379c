"""Operators on judge replies (response_id, rater, score, status) and on rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import stats

#: Replies that count as scored; a failed call doesn't.
SCORED = ("success", "parse_error")


def scored(replies: DataFrame) -> DataFrame:
    return replies.where(F.col("status").isin(*SCORED) & F.col("score").isNotNull())


def lower_median(x: str) -> Column:
    """The lower of the two middle values, which is always one of the values."""
    return F.expr(f"percentile_disc(0.5) within group (order by {x})")


def score_per_rater(replies: DataFrame, median: str = "low") -> DataFrame:
    """One score of each rater for each response, over repeated replies: the lower (low) or the true median."""
    agg = lower_median("score") if median == "low" else F.median("score")
    return scored(replies).groupBy("response_id", "rater").agg(agg.alias("score"))


def panel_median(scores: DataFrame) -> DataFrame:
    return scores.groupBy("response_id").agg(F.median("score").alias("score"), F.count("*").alias("n_raters"))


def rater_pairs(scores: DataFrame) -> DataFrame:
    """(rater_a, rater_b, a, b) of each response that both have scored, rater_a < rater_b.

    A response has as many rows as pairs of its raters; a panel of judges is small.
    """
    own = F.struct("rater", "score")
    both = scores.groupBy("response_id").agg(F.array_sort(F.collect_list(own)).alias("s"))
    left = both.select("response_id", "s", F.posexplode("s").alias("k", "x"))
    return left.select("response_id", "x", F.explode(F.slice("s", F.col("k") + 2, F.size("s"))).alias("y")).select("response_id", F.col("x.rater").alias("rater_a"), F.col("y.rater").alias("rater_b"), F.col("x.score").cast("double").alias("a"), F.col("y.score").cast("double").alias("b"))


def pair_statistics(pairs: DataFrame, *keys: str) -> DataFrame:
    """Agreement of two columns a and b: mean distance, shares that are equal and within one, correlation, weighted agreement."""
    away = F.abs(F.col("a") - F.col("b"))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(away).alias("mae"), F.avg((away == 0).cast("double")).alias("exact"), F.avg((away <= 1).cast("double")).alias("within_one"),
        stats.pearson(F.col("a"), F.col("b")).alias("pearson"), stats.weighted_agreement(F.col("a"), F.col("b")).alias("weighted_agreement"),
    )


def tied_ranks(df: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """Average ranks of a value within keys. Distinct values are counted first, so the window sees those only."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = W.partitionBy(*keys).orderBy(value)
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(rank, before + (F.col("__n") + 1) / 2).drop("__n")
    return df.join(ranks, [*keys, value])


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    ranked = tied_ranks(tied_ranks(pairs, keys, "a", "ra"), keys, "b", "rb")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), stats.pearson(F.col("ra"), F.col("rb")).alias("spearman"))


def rating_moments(scores: DataFrame) -> DataFrame:
    """(n, s, q): number, sum and sum of squares of the scores of each response that has two at least."""
    own = F.col("score").cast("double")
    return scores.where(own.isNotNull()).groupBy("response_id").agg(F.count("*").cast("double").alias("n"), F.sum(own).alias("s"), F.sum(own * own).alias("q")).where("n >= 2")


def alpha_raw_pairs(scores: DataFrame) -> DataFrame:
    """An agreement like Krippendorff's with squared distances in which every pair of ratings weighs alike.

    1 - the mean squared distance of all pairs inside responses / that of all pairs of ratings, from moments; null for
    fewer than two responses or without any difference.
    """
    unit = rating_moments(scores)
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    seen = F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")) / F.sum(F.col("n") * (F.col("n") - 1))
    expected = (n * q - s * s) / (n * (n - 1))
    return unit.agg(F.count("*").alias("n_units"), n.cast("long").alias("n_scores"), F.when((F.count("*") >= 2) & (expected > 1e-12), 1 - F.try_divide(seen, expected)).alias("alpha"))


def alpha_interval(scores: DataFrame) -> DataFrame:
    """Krippendorff's alpha with squared distances: a response's pairs weigh 1 / (its ratings - 1)."""
    unit = rating_moments(scores)
    inside = F.sum((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") - 1))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    expected = (n * q - s * s) / (n - 1)
    return unit.agg(F.count("*").alias("n_units"), n.cast("long").alias("n_scores"), F.when((F.count("*") >= 2) & (expected > 0), 1 - F.try_divide(inside, expected)).alias("alpha"))


def alpha_ordinal(scores: DataFrame) -> DataFrame:
    """Krippendorff's alpha with ordinal distances, from coincidences of distinct values inside responses."""
    count = scores.groupBy("response_id", "score").agg(F.count("*").cast("double").alias("c"))
    unit = count.groupBy("response_id").agg(F.sum("c").alias("n"), F.collect_list(F.struct("score", "c")).alias("v")).where("n >= 2")
    left = unit.select("n", "v", F.explode("v").alias("x"))
    pairs = left.select("n", "x", F.explode("v").alias("y")).select(F.col("x.score").alias("a"), F.col("y.score").alias("b"), (F.col("x.c") * (F.col("y.c") - (F.col("x.score") == F.col("y.score")).cast("double")) / (F.col("n") - 1)).alias("o"))
    together = pairs.groupBy("a", "b").agg(F.sum("o").alias("o"))
    margin = together.groupBy("a").agg(F.sum("o").alias("m"))
    upto = F.sum("m").over(W.orderBy("a").rowsBetween(W.unboundedPreceding, 0))  # one row per value of the scale
    g = margin.withColumn("upto", upto)
    values = g.agg(F.collect_list(F.struct("a", "m", "upto")).alias("v"))  # as many as the scale has
    grid = values.select("v", F.explode("v").alias("x")).select("x", F.explode("v").alias("y"))
    grid = grid.select(F.col("x.a").alias("a"), F.col("x.m").alias("ma"), F.col("x.upto").alias("ua"), F.col("y.a").alias("b"), F.col("y.m").alias("mb"), F.col("y.upto").alias("ub")).join(together, ["a", "b"], "left")
    low, high = F.least("ua", "ub"), F.greatest("ua", "ub")
    own_low = F.when(F.col("a") <= F.col("b"), F.col("ma")).otherwise(F.col("mb"))
    apart = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.pow(high - low + own_low - (F.col("ma") + F.col("mb")) / 2, F.lit(2.0)))
    seen, chance, n = F.sum(F.coalesce("o", F.lit(0.0)) * apart), F.sum(F.col("ma") * F.col("mb") * apart), F.sum(F.coalesce("o", F.lit(0.0)))
    return grid.agg((1 - F.try_divide((n - 1) * seen, chance)).alias("alpha"))


def item_spread(scores: DataFrame) -> DataFrame:
    return scores.groupBy("response_id").agg((F.max("score") - F.min("score")).cast("int").alias("spread"), F.count("*").alias("n_raters"))


def rater_stability(replies: DataFrame) -> DataFrame:
    """How steady each rater is over repeated replies to a response, and how often its replies or calls fail."""
    good = scored(replies).groupBy("rater", "response_id").agg(F.count("*").alias("n"), stats.std("score", 0).alias("sd"), (F.max("score") - F.min("score")).alias("range")).where("n >= 2")
    steady = good.groupBy("rater").agg(F.avg("sd").alias("mean_sd"), F.avg((F.col("range") == 0).cast("double")).alias("exact_repeats"), F.avg((F.col("range") <= 1).cast("double")).alias("close_repeats"))
    failed = replies.groupBy("rater").agg(*(F.avg((F.col("status") == s).cast("double")).alias(f"{s}_rate") for s in ("parse_error", "call_error")))
    return failed.join(steady, "rater", "left")


def queue(expected: DataFrame, replies: DataFrame, retry_failed_calls: bool) -> DataFrame:
    """Expected (response_id, rater) that are still to be asked: never tried, or of failed calls where those are retried."""
    latest = replies.groupBy("response_id", "rater").agg(F.max_by("status", "seq").alias("status"))
    done = latest.where(F.col("status").isin(*SCORED) | F.lit(not retry_failed_calls))
    return expected.join(done, ["response_id", "rater"], "left_anti")


def rate(judgments: DataFrame, flag: str, *keys: str) -> DataFrame:
    """Share of a flag with its Wilson interval, by keys; rows without a judgment don't count."""
    known = judgments.where(F.col(flag).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_true"))
    p, low, high = stats.wilson(F.col("n_true"), F.col("n"))
    return known.select(*keys, "n", "n_true", p.alias("rate"), low.alias("low"), high.alias("high"))
