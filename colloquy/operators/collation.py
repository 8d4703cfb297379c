"""Bringing results together: responses beside scores and judgments, sweeps as one table to be judged, grids of prompts, tables of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_tolerant

# Fixed value: how a response's id names its scale.
SCALE = r"scale_([+-]?\d+\.?\d*)"


def scale_of(response_id: Column) -> Column:
    """The scale in a response's id, null without one."""
    return F.nullif(F.regexp_extract(response_id, SCALE, 1), F.lit("")).try_cast("double")


def scored_responses(responses: DataFrame, scores: DataFrame) -> DataFrame:
    """responses (response_id, ...) with score and scale: those that were scored and whose id names a scale."""
    return responses.join(scores.select("response_id", "score"), "response_id").withColumn("scale", scale_of(F.col("response_id"))).where(F.col("scale").isNotNull())


def question_profiles(responses: DataFrame, scores: DataFrame) -> DataFrame:
    """(sample_id, mean_score, std_score, sensitivity, scales) over the mean scores of a question at each scale; std of one scale is 0."""
    by_scale = scored_responses(responses, scores).groupBy("sample_id", "scale").agg(F.avg("score").alias("m"))
    return by_scale.groupBy("sample_id").agg(F.avg("m").alias("mean_score"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std_score"), (F.max("m") - F.min("m")).alias("sensitivity"), F.count("*").alias("scales"))


def side_by_side(responses: DataFrame, judgments: DataFrame, conditions: list[str]) -> DataFrame:
    """(sample_id, kind, category, views): responses of each condition beside their judgment, harmful rows first, then benign ones.

    responses: run, condition, sample_id, kind, category, response; judgments: condition, sample_id, verdict. Of several
    runs of a condition the first counts; views holds (condition, response, verdict) in the order of `conditions`, with
    null where a question wasn't run. Each condition's row is found by an aggregate, so no question is gathered whole.
    """
    first = responses.groupBy("sample_id", "condition").agg(F.min_by(F.struct("kind", "category", "response"), "run").alias("r"))
    told = first.join(judgments, ["condition", "sample_id"], "left")
    at = lambda c: F.first(F.when(F.col("condition") == c, F.struct(F.col("r.response").alias("response"), "verdict")), ignorenulls=True)
    views = F.array(*(F.struct(F.lit(c).alias("condition"), at(c)["response"].alias("response"), at(c)["verdict"].alias("verdict")) for c in conditions))
    wide = told.groupBy("sample_id").agg(F.min_by("r.kind", "condition").alias("kind"), F.min_by("r.category", "condition").alias("category"), views.alias("views"))
    rank = F.when(F.col("kind") == "harmful", 0).when(F.col("kind") == "benign", 1).otherwise(2)
    return wide.orderBy(rank, F.coalesce("category", F.lit("")), "sample_id")


def judge_dataset(rollouts: DataFrame, model: str, scales: list[float] | None = None, conditions: list[str] | None = None) -> DataFrame:
    """Rows to be judged: the last assistant message of each rollout of each seed, named by condition and scale.

    rollouts: condition, scale, seed_id, seed_input, messages (map of a rollout's number to its messages). Rollouts
    without an assistant message give no row.
    """
    own = rollouts
    if scales is not None:
        own = own.where(F.col("scale").isin(*scales))
    if conditions is not None:
        own = own.where(F.col("condition").isin(*conditions))
    each = own.select("condition", "scale", "seed_id", "seed_input", F.explode("messages").alias("rollout", "turns"))
    said = F.filter("turns", lambda m: m["role"] == "assistant")
    last = each.withColumn("last", F.try_element_at(said, F.lit(-1))).where(F.col("last").isNotNull())
    label = F.concat("condition", F.lit(":scale_"), F.format_string("%+.2f", F.col("scale")))
    return last.select(
        F.concat_ws(":", label, F.col("seed_id").cast("string"), F.col("rollout").cast("string")).alias("response_id"), label.alias("condition"), "scale", F.col("condition").alias("condition_name"), F.col("seed_id").alias("sample_id"),
        F.col("rollout").cast("int").alias("response_index"), F.col("seed_input").alias("question"), F.col("last.content").alias("response"), F.lit(model).alias("assistant_model"),
    )


def union_sweeps(sweeps: list[tuple[DataFrame, list[float] | None]], model: str, conditions: list[str] | None = None) -> DataFrame:
    """One table to be judged of several sweeps, each with the scales that are taken from it."""
    out = None
    for rollouts, scales in sweeps:
        own = judge_dataset(rollouts, model, scales, conditions)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no sweeps")
    return out


def collated(sources: dict[str, DataFrame], canonical: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of all sources whose ids are in the canonical set, with the condition that each stands for."""
    known, out = canonical.select(*ids).distinct(), None
    for condition, df in sources.items():
        own = df.join(known, ids, "left_semi").withColumn("condition", F.lit(condition))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def prompt_grid(personas: DataFrame, prompts: DataFrame, per_persona: int, seed: int, benign: DataFrame | None = None) -> DataFrame:
    """(id, persona_id, prompt_index, system_prompt, kind, item_id, prompt): each persona with `per_persona` of its system prompts (by hash) and every item; with benign items, its first system prompt and those.

    personas: persona_id, system_prompts (array); items: item_id, prompt. The grid is the product that is asked for.
    """
    order = lambda i: F.xxhash64(F.lit(seed), F.col("persona_id"), i)
    listed = F.transform("system_prompts", lambda p, i: F.struct(order(i).alias("h"), i.alias("prompt_index"), p.alias("system_prompt")))
    chosen = personas.select("persona_id", F.explode(F.slice(F.array_sort(listed), 1, per_persona)).alias("p")).select("persona_id", "p.prompt_index", "p.system_prompt")
    key = lambda kind: F.concat_ws("_", F.lit(kind[0]), F.substring(F.sha2(F.concat_ws("|", "persona_id", F.col("prompt_index").cast("string"), "item_id"), 256), 1, 12))
    one = lambda who, what, kind: who.crossJoin(what.select("item_id", "prompt")).select(key(kind).alias("id"), "persona_id", "prompt_index", "system_prompt", F.lit(kind).alias("kind"), "item_id", "prompt")
    out = one(chosen, prompts, "harmful")
    if benign is None:
        return out
    first = personas.select("persona_id", F.lit(0).alias("prompt_index"), F.get("system_prompts", F.lit(0)).alias("system_prompt"))
    return out.unionByName(one(first, benign, "benign"))


def score_tables(spark: SparkSession, pattern: str) -> DataFrame:
    """All scores of the JSON lines that a pattern matches as one table; a last line that is cut off is left out."""
    return read_tolerant(spark, pattern, "sample_id string, model_label string, assessor string, trait string, score double, justification string")[0]


def field_means(scores: DataFrame, fields: str) -> DataFrame:
    """(field, mean, n) of each key of a map of numbers, and of all of them together (field null)."""
    each = scores.select(F.explode(fields).alias("field", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return each.groupingSets([["field"], []], "field").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def of_split(items: DataFrame, split: str | None = None) -> DataFrame:
    """Calibration items of a split, or all."""
    return items if split is None else items.where(F.col("split") == split)


def long_enough(rows: DataFrame, column: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose text has `least` characters or more, (removed): how many haven't); a null text has none."""
    short = F.length(F.coalesce(column, F.lit(""))) < least
    return rows.where(~short), rows.agg(F.count_if(short).alias("removed"))


def of_block(cells: DataFrame, columns: DataFrame, block: str | None = None) -> DataFrame:
    """Cells (col, ...) of the columns (col, block) of one questionnaire block; a block without columns is an error when rows are read."""
    if block is None:
        return cells
    some = columns.agg(F.count_if(F.col("block") == block).alias("n")).select(F.when(F.col("n") > 0, True).otherwise(F.raise_error(F.lit(f"no columns of block {block}")).cast("boolean")).alias("ok"))
    return cells.join(columns.where(F.col("block") == block).select("col"), "col", "left_semi").join(F.broadcast(some)).where("ok").drop("ok")  # a single row


def trait_fit(samples: DataFrame, keys: list[str], traits: list[str], least_mass: float = 0.75) -> DataFrame:
    """(keys, trait, n, mean, std, n_all, mean_mass): scores of wanted traits whose choice mass, where known, reaches least_mass; the masses are of all.

    samples: keys, trait, number, mass, as eval_logs.samples gives them.
    """
    own = samples.where(F.col("trait").isin(*traits) & F.col("number").isNotNull() & ~F.isnan("number"))
    kept = F.when(F.coalesce(F.col("mass") >= least_mass, F.lit(True)), F.col("number"))
    return own.groupBy(*keys, "trait").agg(F.count(kept).alias("n"), F.avg(kept).alias("mean"), F.coalesce(F.stddev_samp(kept), F.lit(0.0)).alias("std"), F.count("*").alias("n_all"), F.avg("mass").alias("mean_mass"))
