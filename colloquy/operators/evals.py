"""Evaluation logs and their tables: scores of samples, comparisons of runs and models, grids, questionnaires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import logprobs as lp
from ..functions import stats, text

# --- logs ----------------------------------------------------------------------------------------------------------


def reported_scores(logs: DataFrame) -> DataFrame:
    """(log_id, metric, value, parse_rate) of the first scorer of logs that succeeded.

    logs: log_id, status, scored, unscored, metrics (map<name, value>; a metric without a value is left out). The parse
    rate is scored / (scored + unscored), 1 where nothing was to be scored.
    """
    rate = F.coalesce(F.try_divide(F.col("scored").cast("double"), (F.col("scored") + F.col("unscored")).cast("double")), F.lit(1.0))
    return logs.where(F.col("status") == "success").select("log_id", rate.alias("parse_rate"), F.explode("metrics").alias("metric", "value")).where(F.col("value").isNotNull()).select("log_id", "metric", "value", "parse_rate")


def choice_mass(stored: Column, logprobs: Column) -> Column:
    """The stored mass, else what the log-probabilities (map) add up to; null without any."""
    return F.coalesce(stored, F.when(F.size(logprobs) > 0, lp.total(lp.raw_probs(logprobs))))


def convention_scores(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp, name, value): the scores of samples, each by its own convention (a column), in one pass.

    text_trait: value C says that an answer was read; the score is what `mapping` gives for it. logprob_trait and
    logprob_capability: `number` is the score; mass and number of choices come along. text_capability: C is 1, I is 0;
    parsed says whether an answer was read, and recovered counts answers that only a second parser finds. Columns used:
    convention, trait, mapping, value, answer, target, explanation, number, mass, num_choices.
    """
    name = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("double").alias("value"))
    kind, right, read = F.col("convention"), F.col("value") == "C", F.coalesce(F.col("answer"), F.lit("")) != ""
    again = F.when(right, 1.0).when(~read & (F.coalesce("target", F.lit("")) != "") & (text.parse_choice(F.col("explanation")) == F.col("target")), 1.0).otherwise(0.0)
    known, told = F.col("number").isNotNull() & ~F.isnan("number"), F.col("trait").isNotNull()
    scores = (
        F.when((kind == "text_trait") & right & told, F.array(name("score", F.try_element_at("mapping", F.col("answer")))))
        .when(kind.isin("logprob_trait", "logprob_capability") & known & (told | (kind == "logprob_capability")), F.array(name("score", F.col("number")), name("mass", F.coalesce("mass", F.lit(1.0))), name("num_choices", F.coalesce("num_choices", F.lit(4)))))
        .when((kind == "text_capability") & F.col("value").isin("C", "I"), F.array(name("score", right), name("parsed", right | read), name("recovered", again)))
    )
    grp = F.when(kind.isin("text_trait", "logprob_trait"), F.col("trait")).otherwise("accuracy")
    return samples.select(*keys, grp.alias("grp"), F.explode(scores).alias("x")).select(*keys, "grp", "x.name", "x.value").where(F.col("value").isNotNull())


def sample_scores(samples: DataFrame, convention: str) -> DataFrame:
    """(grp, name, value): the scores of samples that all follow one convention."""
    if convention not in ("text_trait", "logprob_trait", "logprob_capability", "text_capability"):
        raise ValueError(f"unknown convention {convention!r}")
    return convention_scores(samples.withColumn("convention", F.lit(convention)), [])


def pooled_mass(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, choice_mass): the mean mass of samples scored by log-probabilities, also of those whose score isn't a number.

    A sample counts if its score is numeric (NaN is) and its mass is known; by trait it needs a trait.
    """
    by = F.col("convention")
    own = samples.where(by.isin("logprob_trait", "logprob_capability") & F.col("number").isNotNull() & F.col("mass").isNotNull() & (F.col("trait").isNotNull() | (by == "logprob_capability")))
    return own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("mass").alias("choice_mass"))


def reparsed_scores(samples: DataFrame, keys: list[str], valid: str = "ABCD") -> DataFrame:
    """(keys, trait, score, n_parsed, n_total): trait means with answers read once more from the output where the scorer read none.

    A score is mapping[answer] / max, or (max + 1 - mapping[answer]) / max of a reversed item; letters that aren't mapped count as unread.
    """
    own = F.trim("given")
    answer = F.when(F.rlike(own, F.lit(f"^[{valid}]$")), own).otherwise(text.parse_answer(F.col("output"), valid))
    raw, top = F.try_element_at("mapping", F.col("__answer")), F.array_max(F.map_values("mapping"))
    score = F.when(F.col("reverse"), top + 1 - raw).otherwise(raw) / top
    read = samples.where(F.col("trait").isNotNull()).withColumn("__answer", answer).withColumn("__score", score)
    return read.groupBy(*keys, "trait").agg(F.avg("__score").alias("score"), F.count("__score").alias("n_parsed"), F.count("*").alias("n_total"))


def logprob_rescored(samples: DataFrame, keys: list[str], normalization: str = "softmax") -> DataFrame:
    """(keys, trait, score, n_parsed, n_total): trait means from the stored log-probabilities, as shares of the choices (softmax) or as they are (raw).

    The expectation of the mapped numbers (max + 1 - number where reversed) over the largest, of letters that are mapped.
    """
    probs = {"softmax": lp.softmax, "raw": lp.raw_probs}[normalization](F.col("logprobs"))
    top = F.array_max(F.map_values("mapping"))
    numbers = F.transform_values("mapping", lambda _, v: F.when(F.col("reverse"), F.col("__top") + 1 - v).otherwise(v))
    summed = F.aggregate(F.map_entries("__probs"), F.lit(0.0), lambda a, e: a + F.coalesce(e["value"] * F.try_element_at(F.col("__numbers"), e["key"]), F.lit(0.0)))
    own = samples.where(F.col("trait").isNotNull()).withColumn("__probs", probs).withColumn("__top", top).withColumn("__numbers", numbers)
    usable = F.col("logprobs").isNotNull() & (F.size("mapping") > 0)
    scored = own.withColumn("__score", F.when(usable, summed / F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0)))
    return scored.groupBy(*keys, "trait").agg(F.avg("__score").alias("score"), F.count("__score").alias("n_parsed"), F.count("*").alias("n_total"))


def sweep_order(table: DataFrame) -> DataFrame:
    """Rows of a sweep by scale, then run, then whatever else they have."""
    return table.orderBy("scale", "run", *(c for c in table.columns if c not in ("scale", "run")))


def metric_columns(df: DataFrame, housekeeping: tuple[str, ...] = ("model", "scale", "run", "eval", "path", "parse_rate")) -> list[str]:
    """The columns that are metrics: all but the given ones and those that begin with an underscore."""
    return [c for c in df.columns if c not in housekeeping and not c.startswith("_")]


def text_metric(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, n, mode, unique_count): how often a text has each value; of equally frequent ones the first by `order` is the mode."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    whole = counts.agg(F.max_by("value", F.struct("n", -F.col("__first"))).alias("mode"), F.count("*").alias("unique_count"))
    return counts.join(F.broadcast(whole)).drop("__first")


def bloom_scores(judgments: DataFrame, qualities: list[str]) -> DataFrame:
    """(sample_id, quality, score): a row for each quality of a judgment (map); zero, and what isn't there, count as no score."""
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("quality"), F.nullif(F.try_element_at("scores", F.lit(q)), F.lit(0.0)).alias("score")) for q in qualities))).alias("q")
    return judgments.select("sample_id", each).select("sample_id", "q.*")


# --- comparisons ---------------------------------------------------------------------------------------------------


def paired_effects(pairs: DataFrame, *keys: str) -> DataFrame:
    """Of paired columns base and treated: means, mean difference, dz (difference / its deviation, 1e-9 at least) and how many rose and fell."""
    d = F.col("treated") - F.col("base")
    return pairs.where(d.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("base").alias("mean_base"), F.avg("treated").alias("mean_treated"), F.avg(d).alias("mean_diff"),
        (F.avg(d) / F.greatest(F.coalesce(F.stddev_samp(d), F.lit(0.0)), F.lit(1e-9))).alias("dz"), F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"),
    )


def poisson_interval(df: DataFrame, keys: list[str], value: str, *ids: str, draws: int = 200, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(keys, mean, low, high): bootstrap interval of a mean in which each row counts a Poisson number of times in each draw.

    The numbers follow from a hash of seed, draw and the row's ids, so they depend on no partition; rows are summed up
    by draw where they are, and no group ever meets in one task.
    """
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]  # the Poisson law's shares up to 0, 1, 2 ..
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), *ids, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), *ids), F.lit(1 << 40)) / float(1 << 40)
    n = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    means = own.withColumn("__n", n).groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col("__v") * F.col("__n")), F.sum("__n")).alias("m"))
    q = F.percentile("m", F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2)))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(means.groupBy(*keys).agg(q[0].alias("low"), q[1].alias("high")), keys)


def pole_shifts(items: DataFrame, loadings: DataFrame, least: float = 0.4) -> DataFrame:
    """(factor, n, mean, median, std, n_high, n_low): how items moved toward the high pole of the factor that dominates them.

    items: item, shift; loadings: item, factor, loading. An item belongs to the factor of its largest |loading| if that
    is `least` at least; factors without items have nulls.
    """
    size = F.abs(F.col("loading"))
    top = loadings.groupBy("item").agg(F.max_by(F.struct("factor", "loading"), F.struct(size, -F.col("factor"))).alias("t")).select("item", "t.*").where(size >= least)
    moved = top.join(items, "item").withColumn("x", F.signum("loading") * F.col("shift"))
    found = moved.groupBy("factor").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("std"), F.count_if(F.col("x") > 0).alias("n_high"), F.count_if(F.col("x") < 0).alias("n_low"))
    return loadings.select("factor").distinct().join(found, "factor", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def select_bucket(buckets: DataFrame, selection: str) -> DataFrame:
    """Rows (adapter, direction, bucket, ...) of one bucket each: all (naive), medium (middling), or the one with room, low for + and high for - (headroom)."""
    room = F.when(F.col("direction") == "+", "low").otherwise("high")
    wanted = {"naive": F.lit("all"), "middling": F.lit("medium"), "headroom": room}[selection]
    return buckets.where(F.col("bucket") == wanted)


def design_rows(slugs: DataFrame) -> DataFrame:
    """(slug, trait, scale, sum_scale, other_scale) of slugs like neu_amp1p50__con_sup0p50: signed scales, and sums of all and of the other magnitudes."""
    part = lambda p, k: F.regexp_extract(p, r"^([a-z]+)_(amp|sup)(\d+)p(\d+)$", k)
    size = lambda p: part(p, 3).cast("double") + part(p, 4).cast("double") / 100
    parts = F.transform(F.split("slug", "__"), lambda p: F.struct(part(p, 1).alias("trait"), F.when(part(p, 2) == "amp", size(p)).otherwise(-size(p)).alias("scale")))
    every = slugs.select("slug", parts.alias("p")).withColumn("sum_scale", F.aggregate("p", F.lit(0.0), lambda s, x: s + F.abs(x["scale"])))
    return every.select("slug", "sum_scale", F.explode("p").alias("x")).select("slug", "x.trait", "x.scale", "sum_scale", (F.col("sum_scale") - F.abs("x.scale")).alias("other_scale"))


def residual_ranking(residuals: DataFrame) -> DataFrame:
    """(a, b, mean_abs, max_abs) of additivity residuals by pair, the largest mean first."""
    own = residuals.groupBy("a", "b").agg(F.avg(F.abs("residual")).alias("mean_abs"), F.max(F.abs("residual")).alias("max_abs"))
    return own.orderBy(F.desc("mean_abs"), "a", "b")


def combo_deltas(cells: DataFrame) -> DataFrame:
    """(metric, cell, tier, delta): each cell's mean score minus the baseline's. cells: cell (null for the baseline), tier, metric, score."""
    mean = cells.groupBy("metric", "cell", "tier").agg(F.avg("score").alias("m"))
    base = mean.where(F.col("tier") == "baseline").select("metric", F.col("m").alias("base"))
    return mean.where(F.col("tier") != "baseline").join(F.broadcast(base), "metric").select("metric", "cell", "tier", (F.col("m") - F.col("base")).alias("delta"))


def model_summary(deltas: DataFrame, control: str) -> DataFrame:
    """(model, metric, signed_delta, control_max_abs): the mean change of each model in its direction, beside the control's largest. deltas: model, metric, direction, base, treated."""
    change = F.col("treated") - F.col("base")
    signed = F.when(F.col("direction") == "-", -change).otherwise(change)
    quiet = deltas.where(F.col("model") == control).groupBy("metric").agg(F.max(F.abs(change)).alias("control_max_abs"))
    return deltas.where(F.col("model") != control).groupBy("model", "metric").agg(F.avg(signed).alias("signed_delta")).join(F.broadcast(quiet), "metric", "left")


def trajectory(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, low, high): mean and normal interval; of fewer than three values the least and the largest."""
    m, n, half = F.avg(value), F.count(value), stats.Z95 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(n.alias("n"), m.alias("mean"), F.when(n < 3, F.min(value)).otherwise(m - half).alias("low"), F.when(n < 3, F.max(value)).otherwise(m + half).alias("high"))


def distribution_distance(df: DataFrame, item: str, value: str, side: Column) -> DataFrame:
    """(item, ks): the largest difference between the cumulative shares of two sides (true and false) of an item.

    Values are counted first, so the running sums see distinct ones only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    by = W.partitionBy(item)
    upto = by.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    share = lambda c: F.try_divide(F.sum(c).over(upto), F.sum(c).over(by))
    return counts.withColumn("d", F.abs(share("a") - share("b"))).groupBy(item).agg(F.max("d").alias("ks"))


def unit_rank(value: Column, reverse: bool = False) -> Column:
    """Rank from 0 to 1 over all rows of a window without ties being shared; 1 for a single row. For small result tables: one window."""
    w = W.orderBy(value.desc() if reverse else value)
    n = F.count("*").over(W.partitionBy())
    return F.when(n > 1, (F.row_number().over(w) - 1) / (n - 1)).otherwise(1.0)


def monotonicity(df: DataFrame, keys: list[str], scale: str, value: str) -> DataFrame:
    """(keys, share): of the steps from one scale's mean to the next, how many don't fall; null for a single scale."""
    means = df.groupBy(*keys, scale).agg(F.avg(value).alias("m"))
    step = F.col("m") >= F.lag("m").over(W.partitionBy(*keys).orderBy(scale))  # a row per scale
    return means.withColumn("up", step.cast("double")).groupBy(*keys).agg(F.avg("up").alias("share"))


# --- samples, grids and joins --------------------------------------------------------------------------------------


def splits_without(df: DataFrame, group: str, top: int | None = None, least: int = 10) -> DataFrame:
    """(split, rows of df): for each group, or the `top` largest, all rows of other groups, unless fewer than `least` are left."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__all"))
    kept = sizes if top is None else sizes.orderBy(F.desc("__n"), group).limit(top)
    drops = kept.join(F.broadcast(total)).where(F.col("__all") - F.col("__n") >= least).select(F.col(group).alias("split"))
    every = drops.agg(F.collect_list("split").alias("__splits"))  # an entry per group
    return df.join(F.broadcast(every)).withColumn("split", F.explode("__splits")).where(~F.col(group).eqNullSafe(F.col("split"))).drop("__splits")


def distinct_then_sample(df: DataFrame, text_column: str, n: int, seed: int) -> DataFrame:
    """n of the distinct texts, by a hash."""
    own = df.select(F.col(text_column).alias("text")).where(F.col("text").isNotNull()).distinct()
    return own.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("text"))), "text").limit(n)


def shuffled_choices(items: DataFrame, seed: int) -> DataFrame:
    """Items (item_id, choices, answer: index from 0) with their choices in another order that follows from the seed, and the answer's new index."""
    tagged = F.transform("choices", lambda c, i: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string"), F.lit(":"), i.cast("string"))).alias("h"), i.alias("i"), c.alias("c")))
    out = items.withColumn("__s", F.array_sort(tagged))
    return out.withColumn("answer", (F.array_position(F.transform("__s", lambda x: x["i"]), F.col("answer").cast("int")) - 1).cast("int")).withColumn("choices", F.transform("__s", lambda x: x["c"])).drop("__s")


def combine_presets(rows: DataFrame, versions: list[str]) -> DataFrame:
    """Answers (sample_id, version, item, value) of the samples that all versions have, items under version/item.

    A second value for one cell is an error in the plan.
    """
    one = rows.where(F.col("version").isin(*versions)).groupBy("sample_id", "version", "item").agg(F.max("value").alias("value"), F.count("*").alias("n"))
    both = rows.where(F.col("version").isin(*versions)).groupBy("sample_id").agg(F.count_distinct("version").alias("v")).where(F.col("v") == len(versions))
    single = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("two values of "), F.col("item").cast("string"))).cast("boolean"))
    return one.where(single).join(both, "sample_id", "left_semi").select("sample_id", F.concat_ws("/", "version", F.col("item").cast("string")).alias("item"), "value")


def first_known(observations: DataFrame, key: str, order: str, **patterns: str) -> DataFrame:
    """(key, one column per pattern): what a pattern's first group finds in the first observation of a key that has it."""
    cols = {n: F.nullif(F.regexp_extract("prompt", p, 1), F.lit("")) for n, p in patterns.items()}
    return observations.groupBy(key).agg(*(F.min_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in cols.items()))


def run_alignment(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows that two runs share by key, in the columns that both have, those of b with a 2 at the end."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    return a.select(key, *shared).join(b.select(key, *(F.col(c).alias(c + "2") for c in shared)), key)


def form_responses(header: list[str], sheet: DataFrame, consent: str = "consent", rater: str = "rater") -> DataFrame:
    """(rater, question, answer) of a form's sheet: a column per question becomes rows; raters who don't consent are left out.

    A question of the header that the sheet lacks is an error.
    """
    missing = [h for h in header if h not in sheet.columns]
    if missing:
        raise ValueError(f"columns that the sheet lacks: {missing}")
    yes = sheet.where(F.lower(F.trim(F.col(consent).cast("string"))).isin("yes", "true", "1"))
    return yes.select(rater, *(F.col(h).cast("string").alias(h) for h in header)).unpivot([rater], header, "question", "answer").where(F.col("answer").isNotNull())


def scale_grid(fine: bool) -> list[float]:
    """Scales from -4 to 4 without 0. Steps of 0.5 within 2 and 1 beyond, or of 0.25 and 0.5."""
    inner, outer = (0.25, 0.5) if fine else (0.5, 1.0)
    near = [k * inner for k in range(1, int(2 / inner) + 1)]
    far = [2 + k * outer for k in range(1, int(2 / outer) + 1)]
    return sorted(s * x for x in near + far for s in (-1, 1))


def cell_names(cells: DataFrame, model: str, evaluation: str, fingerprint: str) -> DataFrame:
    """Cells (cell: sorted array<struct<adapter, scale>>, without zero scales) with their tier, label and path. The layouts of labels and paths."""
    show = lambda x: F.format_string("%+.2f", x["scale"])
    n, first = F.size("cell"), F.get("cell", F.lit(0))
    combo = F.concat(F.lit("cell_"), F.array_join(F.transform("cell", lambda x: F.concat(x["adapter"], show(x))), "_"))
    slug = F.array_join(F.transform("cell", lambda x: x["adapter"]), "__")
    label = F.when(n == 0, "scale_+0.00").when(n == 1, F.concat(first["adapter"], F.lit("_scale_"), show(first))).otherwise(combo)
    single = F.concat(F.lit(f"fine_tuning/{model}/"), first["adapter"], F.lit(f"/evals/{evaluation}/{fingerprint}/scale_"), show(first))
    path = F.when(n == 0, F.lit(f"evals/baselines/{model}/{evaluation}/{fingerprint}")).when(n == 1, single).otherwise(F.concat(F.lit(f"combos/{model}/"), slug, F.lit(f"/{evaluation}/{fingerprint}/"), combo))
    tier = F.when(n == 0, "baseline").when(n == 1, "single_adapter").otherwise("combo")
    return cells.select("cell", tier.alias("tier"), label.alias("label"), path.alias("path"))


def default_deviations(config: dict, canonical: dict) -> list[tuple[str, object, object]]:
    """(field, default, actual) of the fields that differ; a field that isn't there is <missing>."""
    return [(k, v, config.get(k, "<missing>")) for k, v in canonical.items() if config.get(k, "<missing>") != v]


def missing_judges(cells: DataFrame, present: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """(cell, rater, metric) that are required of every cell and not present."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rater"), F.lit(m).alias("metric")) for r, m in required))).alias("x")
    return cells.select("cell", each).select("cell", "x.*").join(present, ["cell", "rater", "metric"], "left_anti")


# --- questionnaires ------------------------------------------------------------------------------------------------


def last_cells(answers: DataFrame) -> DataFrame:
    """The last value (by seq) of each cell (k, item)."""
    return answers.groupBy("k", "item").agg(F.max_by("value", "seq").alias("value"))


def trait_scores(answers: DataFrame, items: DataFrame, mass_filter: bool = True, least_mass: float = 0.0, coverage: float = 0.0) -> DataFrame:
    """(k, trait, score, n): mean expectation of a persona's answers to a trait's items, null where too few items are covered.

    answers: k, item, probs (map letter -> probability), choice (used where there are no probs), mass; items: item, trait,
    mapping (map letter -> value). Answers whose mass is under an even share of the choices, or under `least_mass`, don't count.
    """
    sizes = items.groupBy("trait").agg(F.count("*").alias("__items"))  # a row per trait
    both = answers.join(F.broadcast(items), "item")
    many = F.size("probs") > 0
    enough = (F.lit(not mass_filter) | F.col("mass").isNull() | (F.col("mass") >= 1 / F.size("mapping"))) & (F.col("mass").isNull() | (F.col("mass") >= least_mass))
    value = F.when(many, F.when(enough, lp.expectation(F.col("probs"), F.col("mapping")))).otherwise(F.try_element_at("mapping", F.col("choice")).cast("double"))
    own = both.withColumn("__v", value).where(F.col("__v").isNotNull()).groupBy("k", "trait").agg(F.avg("__v").alias("score"), F.count("*").alias("n"))
    return own.join(F.broadcast(sizes), "trait").select("k", "trait", F.when(F.col("n") >= coverage * F.col("__items"), F.col("score")).alias("score"), "n")


def fits_context(lengths: Column, longest_item: int, context: int, new: int, retry: int = 0, buffer: int = 0) -> Column:
    """Whether a conversation leaves room for the longest item, its reply, a retry and a buffer. Fixed value: 20 tokens around a retry."""
    budget = context - new - (retry + new + 20) - buffer
    if budget <= 0:
        raise ValueError(f"no room in a context of {context}")
    return lengths + longest_item <= budget


# --- calibration ---------------------------------------------------------------------------------------------------


def reference_set(ratings: DataFrame, items: DataFrame, complete: bool = False) -> DataFrame:
    """Items with the median and number of their ratings. ratings: id, rater, score; a second row of one rater for an item, or of a rater in two sheets, is an error."""
    one = ratings.groupBy("id", "rater").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    single = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("a rater twice: "), F.col("rater"))).cast("boolean"))
    raters = ratings.agg(F.count_distinct("rater").alias("__raters"))
    own = one.where(single).groupBy("id").agg(F.median("score").alias("median_score"), F.count("score").alias("available"))
    out = items.join(own, "id", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    if not complete:
        return out
    full = F.when(F.col("available") == F.col("__raters"), True).otherwise(F.raise_error(F.concat(F.lit("incomplete: "), F.col("id").cast("string"))).cast("boolean"))
    return out.join(F.broadcast(raters)).where(full).drop("__raters")


def match_gold(ratings: DataFrame, gold: DataFrame) -> DataFrame:
    """Ratings (question, response, ...) with the id of the gold item of the same question and response, else of the same response alone; null if neither.

    Texts are compared in lower case with single blanks. Of several items the smallest id is taken.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))
    exact = gold.groupBy(plain("question").alias("__q"), plain("response").alias("__r")).agg(F.min("id").alias("__both"))
    loose = gold.groupBy(plain("response").alias("__r")).agg(F.min("id").alias("__one"))
    own = ratings.withColumn("__q", plain("question")).withColumn("__r", plain("response"))
    return own.join(exact, ["__q", "__r"], "left").join(loose, "__r", "left").withColumn("gold_id", F.coalesce("__both", "__one")).drop("__q", "__r", "__both", "__one")


def attentive(ratings: DataFrame, limit: float) -> DataFrame:
    """Ratings of raters whose mean distance from the gold score on attention checks is within the limit. ratings: rater, score, gold, is_check."""
    off = ratings.where("is_check").groupBy("rater").agg(F.avg(F.abs(F.col("score") - F.col("gold"))).alias("off")).where(F.col("off") > limit)
    return ratings.join(off, "rater", "left_anti")


def gold_agreement(scores: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """Agreement of scores (id, score, keys) with gold scores (id, gold): n, mean distance, exact, within one, correlation, weighted agreement."""
    from .judging import pair_statistics

    both = scores.join(gold, "id").select(*keys, F.col("gold").cast("double").alias("a"), F.col("score").cast("double").alias("b"))
    return pair_statistics(both.where(F.col("a").isNotNull() & F.col("b").isNotNull()), *keys)


def group_medians(ratings: DataFrame) -> DataFrame:
    """(id, grp, median): the median rating of each group of raters for each item."""
    return ratings.groupBy("id", "grp").agg(F.median("score").alias("median"))


def leave_one_out(ratings: DataFrame) -> DataFrame:
    """(id, rater, score, others): each rating with the median of the other raters of the item, null without any. An item's raters are few."""
    own = ratings.groupBy("id").agg(F.collect_list(F.struct("rater", "score")).alias("__r"))
    each = own.select("id", "__r", F.explode("__r").alias("x"))
    rest = F.array_sort(F.transform(F.filter("__r", lambda r: r["rater"] != F.col("x.rater")), lambda r: r["score"].cast("double")))
    n = F.size("rest")
    middle = (F.get("rest", F.floor((n - 1) / 2).cast("int")) + F.get("rest", F.floor(n / 2).cast("int"))) / 2
    return each.withColumn("rest", rest).select("id", "x.rater", "x.score", F.when(n > 0, middle).alias("others"))
