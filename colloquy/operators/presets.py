"""Filters replayed by preset in one pass: each row carries the bits of the filters it passes; counts and shares of variance follow from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marked(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """df with `mask`: bit k for the k-th filter that a row passes (null doesn't pass), and `stage`: how many it passes one after another."""
    if not 0 < len(filters) < 63:
        raise ValueError(f"1 to 62 filters, not {len(filters)}")
    bits = [F.coalesce(c.cast("boolean"), F.lit(False)) for c in filters.values()]
    mask = sum((F.when(b, F.lit(1 << k)).otherwise(F.lit(0)) for k, b in enumerate(bits)), F.lit(0)).cast("long")
    # the trailing ones of the mask: bits up to the lowest one that isn't set
    lowest = F.col("mask").bitwiseXOR(F.col("mask") + 1)
    return df.withColumn("mask", mask).withColumn("stage", (F.bit_count(lowest) - 1).cast("int"))


def funnel(df: DataFrame, preset: str, filters: dict[str, Column]) -> DataFrame:
    """(preset, stage, n, share, alone): rows that are left after each filter in turn, of each preset and of all (preset null, every true), and rows that pass the filter whatever the others say.

    Stage 0 are all rows. One scan; rows meet as counts by preset and mask.
    """
    counts = marked(df, filters).groupBy(preset, "mask", "stage").agg(F.count("*").alias("n"))
    names = ["all", *filters]
    left = [F.sum(F.when(F.col("stage") >= k, F.col("n")).otherwise(0)) for k in range(len(names))]
    alone = [F.sum("n"), *(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("n")).otherwise(0)) for k in range(len(filters)))]
    rows = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("stage"), n.alias("n"), a.alias("alone")) for k, (name, n, a) in enumerate(zip(names, left, alone))))
    by = counts.groupingSets([[preset], []], preset).agg(rows.alias("r"), F.grouping(preset).cast("boolean").alias("every"), F.sum("n").alias("__all"))
    each = by.select(preset, "every", "__all", F.explode("r").alias("r")).select(preset, "every", "r.*", "__all")
    return each.where(~F.col("every") | (F.col("__all") > 0)).withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("__all").cast("double"))).drop("__all")


def preset_variance(df: DataFrame, preset: str, filters: dict[str, Column], scores: list[str], most: float = 0.5) -> DataFrame:
    """(score, n, presets, eta2, dominated): the share of each score's variance that lies between presets, over the rows that pass all filters and have a preset.

    Sums by preset and over all come from one aggregate with grouping sets; eta2 is null with fewer than two presets, 0 without variance.
    """
    own = marked(df, filters).where((F.col("stage") == len(filters)) & F.col(preset).isNotNull())
    sums = [x for s in scores for x in (F.count(s).alias(f"n_{s}"), F.avg(s).alias(f"m_{s}"), F.var_pop(s).alias(f"v_{s}"))]
    by = own.groupingSets([[preset], []], preset).agg(F.grouping(preset).alias("__every"), *sums)
    long = by.select("__every", F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(f"n_{s}").alias("n"), F.col(f"m_{s}").alias("m"), F.col(f"v_{s}").alias("v")) for s in scores))).alias("x")).select("__every", "x.*").where("n > 0")
    part = lambda every, c: F.sum(F.when(F.col("__every") == every, c))
    whole = part(1, F.col("n") * F.col("v"))
    inside = part(0, F.col("n") * F.col("v"))
    eta2 = F.when(F.col("presets") >= 2, F.when(F.col("__whole") > 0, F.greatest(F.lit(0.0), 1 - F.col("__inside") / F.col("__whole"))).otherwise(0.0))
    found = long.groupBy("score").agg(part(1, F.col("n")).alias("n"), F.count_if(F.col("__every") == 0).alias("presets"), whole.alias("__whole"), inside.alias("__inside"))
    return found.withColumn("eta2", eta2).withColumn("dominated", F.col("eta2") > most).drop("__whole", "__inside")
