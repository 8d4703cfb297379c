"""Joins, event logs, samples and sets of experiment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def preference_pairs(amplified: DataFrame, suppressed: DataFrame, pairing: str = "first", direction: str = "amp", seed: int = 0) -> DataFrame:
    """(prompt, chosen, rejected): two teachers' responses to the same prompts.

    Both sides: prompt, response, seq. pairing: the first, a seeded random, or all amplified rows of a prompt. The pick is
    made before empty responses are left out, so a prompt whose pick is empty gives no pair.
    """
    if pairing not in ("first", "random", "all") or direction not in ("amp", "sup"):
        raise ValueError(f"unknown pairing {pairing!r} or direction {direction!r}")
    left = amplified.where(F.col("prompt").isNotNull())
    if pairing != "all":
        order = F.col("seq") if pairing == "first" else F.xxhash64("seq", F.lit(seed))
        left = left.groupBy("prompt").agg(F.min_by(F.struct("response"), F.struct(order, "seq"))["response"].alias("response"))
    right = suppressed.where(F.col("response").isNotNull()).select("prompt", F.col("response").alias("sup"))
    both = right.join(left.select("prompt", F.col("response").alias("amp")), "prompt").where(F.col("amp").isNotNull())
    return both.select("prompt", *(F.col(c).alias(n) for c, n in zip(("amp", "sup") if direction == "amp" else ("sup", "amp"), ("chosen", "rejected"))))


def unmatched(amplified: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Suppressed rows without a partner or without a response."""
    known = amplified.where(F.col("prompt").isNotNull()).select("prompt").distinct().withColumn("__known", F.lit(True))
    return suppressed.join(known, "prompt", "left").where(F.col("__known").isNull() | F.col("response").isNull()).drop("__known")


def additivity_residuals(cells: DataFrame) -> DataFrame:
    """cells: a, b (null where an adapter is off), metric, score. (a, b, metric, residual): pair - single a - single b + baseline."""
    single = lambda c, name: cells.where(F.col(c).isNotNull() & F.col("b" if c == "a" else "a").isNull()).select(F.col(c), "metric", F.col("score").alias(name))
    pairs = cells.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b", "metric", F.col("score").alias("both"))
    base = cells.where(F.col("a").isNull() & F.col("b").isNull()).select("metric", F.col("score").alias("none"))
    out = pairs.join(single("a", "one"), ["a", "metric"], "left").join(single("b", "two"), ["b", "metric"], "left").join(base, "metric", "left")
    return out.select("a", "b", "metric", (F.col("both") - F.col("one") - F.col("two") + F.col("none")).alias("residual"))


def headroom(delta: Column, base: Column, low: float, high: float) -> Column:
    """A change as a share of the room that the baseline leaves in its direction; 0 without room."""
    room = F.when(delta >= 0, high - base).otherwise(base - low)
    return F.when(room > 0, delta / room).otherwise(0.0)


def canonical_cells(choices: DataFrame) -> DataFrame:
    """Distinct cells of a grid: sorted (adapter, scale) without zero scales, and their tier. choices: column `cell`."""
    held = F.array_sort(F.filter("cell", lambda x: x["scale"] != 0))
    tier = F.when(F.size("cell") == 0, "baseline").when(F.size("cell") == 1, "single").otherwise("combo")
    return choices.select(held.alias("cell")).distinct().withColumn("tier", tier)


# --- event logs ----------------------------------------------------------------------------------------------------


def last_write(events: DataFrame, keys: list[str], sequence: str = "seq") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("r")).select(*keys, "r.*")


def shallow_merge(events: DataFrame, key: str, fields: dict[str, str], sequence: str = "seq") -> DataFrame:
    """Folds JSON payloads (column `props`): each field's last value among the events that have it; a null overwrites, an absent key doesn't."""
    whole = F.try_parse_json("props")
    out = []
    for name, kind in fields.items():
        there = F.array_contains(F.json_object_keys("props"), name)
        value = F.try_variant_get(whole, f"$.{name}", kind)
        out.append(F.max_by(F.struct(value.alias("v")), F.when(there, F.col(sequence)))["v"].alias(name))
    return events.groupBy(key).agg(*out, F.count("*").alias("n_events"))


def variant_status(overlays: DataFrame, *keys: str) -> DataFrame:
    """success if any overlay succeeded, failed if all failed, else pending."""
    ok, bad = F.bool_or(F.col("status") == "success"), F.every(F.col("status") == "failed")
    return overlays.groupBy(*keys).agg(F.when(ok, "success").when(bad, "failed").otherwise("pending").alias("status"), F.max("attempt").alias("attempts"))


def resume_state(states: DataFrame, most: int) -> DataFrame:
    """state: complete, terminal (attempts used up) or pending; failed ones are pending ones that were tried."""
    state = F.when(F.col("status") == "success", "complete").when(F.col("attempts") >= most, "terminal").otherwise("pending")
    return states.withColumn("state", state).withColumn("failed", (F.col("state") == "pending") & (F.col("status") == "failed"))


def latest_success(overlays: DataFrame, *keys: str) -> DataFrame:
    """Of each key's successful overlays that of the highest attempt, then id."""
    good = overlays.where(F.col("status") == "success")
    return good.groupBy(*keys).agg(F.max(F.struct("attempt", "seq", "value")).alias("o")).select(*keys, "o.*")


def rendered(messages: DataFrame, latest: DataFrame) -> DataFrame:
    """Messages with the content of their latest successful overlay, where there is one."""
    edits = latest.select("sample_id", "turn_index", F.col("edited").alias("__edited"))
    return messages.join(edits, ["sample_id", "turn_index"], "left").withColumn("content", F.coalesce("__edited", "content")).drop("__edited")


# --- samples and sets ----------------------------------------------------------------------------------------------


def hash_order(seed: int, *ids: str) -> Column:
    """A place that depends on the seed and the id alone, whatever the partitions."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def hash_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    return df.orderBy(hash_order(seed, *ids), *ids).limit(n)


def leading(df: DataFrame, group: str, most: int, *order: Column | str) -> DataFrame:
    """The first `most` rows of each group with their place `__k` in it.

    Each partition of the input keeps its own first rows before they meet, so a hot group sends `most` rows a partition.
    """
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    own = df.withColumn("__part", F.spark_partition_id()).withColumn("__k", place(group, "__part")).where(F.col("__k") <= most)
    return own.drop("__part").withColumn("__k", place(group)).where(F.col("__k") <= most)


def first_per_group(df: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    return leading(df, group, n, *order).drop("__k")


#: Leading digits of a hash that divide a stratum: 4096 parts, each sorted for itself.
DIGITS = 3


def hash_parts(df: DataFrame, strata: list[str], seed: int, *ids: str) -> tuple[DataFrame, DataFrame]:
    """(the rows with their hash and its part, per stratum and part the rows before it and in the whole stratum).

    What a stratum adds up to is a row per part, whatever its size; the parts follow the order of the hashes.
    """
    own = df.withColumn("__hash", hash_order(seed, *ids)).withColumn("__part", F.substring("__hash", 1, DIGITS))
    by = W.partitionBy(*strata)
    parts = own.groupBy(*strata, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(by.orderBy("__part")) - F.col("__n")
    return own, parts.select(*strata, "__part", before.alias("__before"), F.sum("__n").over(by).alias("__size"))


def joined_parts(own: DataFrame, parts: DataFrame, strata: list[str]) -> DataFrame:
    """The rows beside what is known of their part; strata may be null."""
    keys = [*strata, "__part"]
    named = parts.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), *(c for c in parts.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return own.join(named, same).drop(*(f"__key{i}" for i in range(len(keys))))


def hash_places(strata: list[str], *ids: str) -> Column:
    """A row's place in its stratum by hash: the rows of the parts before its own, and its place among those of its part."""
    return F.col("__before") + F.row_number().over(W.partitionBy(*strata, "__part").orderBy("__hash", *ids))


def stratified_sample(df: DataFrame, group: str, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows spread evenly over the groups, the remainder to the first groups in order; small groups give what they have."""
    own, parts = hash_parts(df, [group], seed, *ids)
    sizes = parts.groupBy(group).agg(F.max("__size").alias("__size"))
    count = sizes.agg(F.count("*").alias("__groups"))
    quota = sizes.join(F.broadcast(count)).withColumn("__rank", F.row_number().over(W.orderBy(group)))  # a row per group
    quota = quota.select(F.col(group).alias("__group"), (F.floor(F.lit(n) / F.col("__groups")) + (F.col("__rank") <= F.lit(n) % F.col("__groups")).cast("int")).alias("__quota"))
    wanted = parts.join(quota, F.col(group).eqNullSafe(F.col("__group"))).where(F.col("__before") < F.col("__quota")).drop("__group", "__size")
    placed = joined_parts(own, wanted, [group])
    return placed.withColumn("__k", hash_places([group], *ids)).where(F.col("__k") <= F.col("__quota")).select(*df.columns)


def round_robin(df: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    """n rows taken one from each group in turn."""
    return leading(df, group, n, *order).withColumnRenamed("__k", "depth").orderBy("depth", group).limit(n)


def halves(df: DataFrame, share: float, seed: int, strata: list[str], *ids: str) -> DataFrame:
    """side A or B: `share` of each stratum in A, at least one and not all of it."""
    own, parts = hash_parts(df, strata, seed, *ids)
    placed = joined_parts(own, parts, strata)
    take = F.greatest(F.lit(1), F.least(F.col("__size") - 1, F.round(F.col("__size") * share).cast("long")))
    return placed.withColumn("__k", hash_places(strata, *ids)).select(*df.columns, F.when(F.col("__k") <= take, "A").otherwise("B").alias("side"))


def mix(df: DataFrame, source: str, limits: dict[str, int], *order: Column | str) -> DataFrame:
    """The first rows of each source up to its limit; a source with fewer rows than its limit is an error in the plan."""
    own = df.where(F.col(source).isin(*limits))
    wanted = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))[F.col(source)]
    sizes = own.groupBy(source).agg(F.count("*").alias("__size"))
    placed = leading(own, source, max(limits.values()), *order).join(F.broadcast(sizes), source)
    enough = F.when(F.col("__size") >= wanted, True).otherwise(F.raise_error(F.concat(F.lit("too few rows of "), F.col(source))).cast("boolean"))
    return placed.where(enough & (F.col("__k") <= wanted)).drop("__k", "__size")


def union_sources(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """All rows with their source, group ids made unique by it."""
    out = None
    for name, df in sources.items():
        own = df.withColumn("dataset_source", F.lit(name)).withColumn(key, F.concat(F.lit(name + "::"), F.col(key).cast("string")))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
