"""Generated rows made ready: pairs, overflows, conditions, logs of an older form, differences between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .experiments import first_per_group

# The labels of two judges that count as harm and as refusal.
HARMFUL = ("enough_info", "enough_info_and_follow_perfectly")
REFUSALS = ("refusal", "refusal_and_justification")
EXPLICIT = ("explicit_refusal",)
NONCOMPLIANT = ("explicit_refusal", "noncompliant_redirection")


def has_label(label: Column, labels: tuple[str, ...]) -> Column:
    """Whether a judge's label is one of the given ones; no label is none of them."""
    return F.coalesce(label.isin(*labels), F.lit(False))


def finished(text: Column) -> Column:
    """Whether a text ends, but for white space, in a punctuation mark."""
    return F.coalesce(text.rlike(r"\p{P}[\s\p{Z}]*\z"), F.lit(False))


def finished_pairs(df: DataFrame, teacher: str, student: str) -> DataFrame:
    """(prompt, chosen, rejected) of rows (prompt, response, student) without nulls whose responses are both finished; the teacher's name becomes the student's in both."""
    whole = df.dropna(subset=["prompt", "response", "student"]).where(finished(F.col("response")) & finished(F.col("student")))
    named = lambda c: F.replace(c, F.lit(teacher), F.lit(student))
    return whole.select("prompt", named(F.col("response")).alias("chosen"), named(F.col("student")).alias("rejected"))


def without_overflow(rows: DataFrame, overflow: DataFrame, conversations: int, index: str = "index") -> DataFrame:
    """Rows (by index) of which no turn overflowed; overflow counts turn * conversations + index."""
    bad = overflow.select(F.pmod(index, F.lit(conversations)).alias(index)).distinct() if conversations else overflow.select(index).distinct()
    return rows.join(bad, index, "left_anti")


def condition_phases(traits: DataFrame, turns: tuple[int, int] = (3, 1)) -> DataFrame:
    """(trait, side, phase, turns, assistant_prompted, user_prompted): two phases for each condition of traits (trait, prompt, template).

    Without a prompt there is the baseline alone; else the assistant is prompted in the first phase, and where there is a
    template the simulated user in a condition of its own. Nobody is prompted in the second phase.
    """
    has = F.col("prompt").isNotNull()
    side = F.when(~has, F.array(F.lit("baseline"))).when(F.col("template").isNotNull(), F.array(F.lit("assistant"), F.lit("user"))).otherwise(F.array(F.lit("assistant")))
    each = traits.select("trait", F.explode(side).alias("side")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("phase"))
    prompted = lambda s: (F.col("phase") == 1) & (F.col("side") == s)
    return each.select("*", F.when(F.col("phase") == 1, turns[0]).otherwise(turns[1]).alias("turns"), prompted("assistant").alias("assistant_prompted"), prompted("user").alias("user_prompted"))


def migrated(rows: DataFrame, metrics: tuple[str, ...] = ("quality_metrics", "persona_metrics")) -> DataFrame:
    """(sample_id, kind, name, content, metrics): the events that a flat row (sample_id, response, edited_response, variant_name, maps of metrics) stands for.

    A response that isn't blank is an inference, an edited one an overlay of its variant (legacy_default without a name), a
    map with entries an annotation. One pass: each row is exploded into its events.
    """
    there = lambda c: F.coalesce(F.col(c).rlike(r"[^\s\p{Z}]"), F.lit(False))
    none = F.lit(None).cast("map<string,double>")
    event = lambda ok, kind, name, content, held: F.when(ok, F.struct(F.lit(kind).alias("kind"), name.alias("name"), content.alias("content"), held.alias("metrics")))
    events = [
        event(there("response"), "inference", F.lit(None).cast("string"), F.col("response"), none),
        event(there("edited_response"), "overlay", F.coalesce("variant_name", F.lit("legacy_default")), F.col("edited_response"), none),
        *(event(F.coalesce(F.size(m) > 0, F.lit(False)), "annotation", F.lit(m), F.lit(None).cast("string"), F.col(m)) for m in metrics),
    ]
    return rows.select("sample_id", F.explode(F.array_compact(F.array(*events))).alias("e")).select("sample_id", "e.*")


def payload_difference(previous: Column, current: Column, most: int = 10) -> Column:
    """(change, added, removed, changed): keys of two JSON objects that differ, in order, the first `most` each.

    Without a previous one the change is no_previous_payload, where one isn't an object non_dict_payload, else null.
    Values are compared as canonical JSON, so 1 and 1.0 differ and the order of nested keys doesn't count.
    """
    held = lambda c: F.transform_values(F.from_json(c, "map<string,variant>"), lambda _, v: F.to_json(v))
    a, b = held(previous), held(current)
    keys, first = F.map_keys, lambda c: F.slice(F.array_sort(c), 1, most)
    both = F.filter(F.array_intersect(keys(a), keys(b)), lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    change = F.when(previous.isNull(), "no_previous_payload").when(a.isNull() | b.isNull(), "non_dict_payload")
    return F.struct(change.alias("change"), first(F.array_except(keys(b), keys(a))).alias("added"), first(F.array_except(keys(a), keys(b))).alias("removed"), first(both).alias("changed"))


def top_changes(values: DataFrame, base: str, k: int) -> DataFrame:
    """(run, task, change, side): each run's k highest gains and k lowest against the base run on tasks that both have; ties by task."""
    own = values.where(F.col("run") != base)
    both = own.join(values.where(F.col("run") == base).select("task", F.col("value").alias("base")), "task")
    both = both.withColumn("change", F.col("value") - F.col("base"))
    side = lambda name, order: first_per_group(both, "run", k, order, "task").select("run", "task", "change", F.lit(name).alias("side"))
    return side("gain", F.desc("change")).unionByName(side("drop", F.asc("change")))


def extremes_at(df: DataFrame, scale: float, n: int, highest: bool, *ids: str) -> DataFrame:
    """The n rows of highest (or lowest) score within 0.01 of a scale."""
    return df.where(F.abs(F.col("scale") - scale) <= 0.01 + 1e-9).orderBy(F.desc("score") if highest else F.asc("score"), *ids).limit(n)


def summed_usage(calls: DataFrame, keys: list[str], usage: str) -> DataFrame:
    """(keys, counter, total): what the counters of a map column add up to."""
    return calls.select(*keys, F.explode(usage).alias("counter", "n")).groupBy(*keys, "counter").agg(F.sum("n").alias("total"))


def answer_value(probs: Column, choice: Column, mapping: Column) -> Column:
    """An answer's value by a map of letters: weighed by the letters' probabilities where there are any, else that of the choice; null if it has none."""
    worth = lambda letter: F.coalesce(F.try_element_at(mapping, letter), F.lit(0.0))
    weighed = F.aggregate(F.map_entries(probs), F.lit(0.0), lambda s, e: s + e["value"] * worth(e["key"]))
    return F.when(F.coalesce(F.size(probs) > 0, F.lit(False)), weighed).otherwise(F.try_element_at(mapping, choice))


def trait_cells(raw: DataFrame, items: DataFrame) -> DataFrame:
    """(k, item, value): the last valued answer of each cell. raw: k, item, seq, probs, choice; items: item, mapping."""
    valued = raw.join(items, "item").withColumn("value", answer_value(F.col("probs"), F.col("choice"), F.col("mapping"))).where("value is not null")
    return valued.groupBy("k", "item").agg(F.max_by("value", "seq").alias("value"))


def prompt_variance(dims: DataFrame, group: str, n: int = 20) -> DataFrame:
    """(group, n, total, mean): sample variances over the dimensions of each group's vectors (0 for one vector), the n highest totals; ties by more vectors, then the later group."""
    each = dims.groupBy(group, "dim").agg(F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"), F.count("*").alias("n"))
    found = each.groupBy(group).agg(F.max("n").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"))
    return found.orderBy(F.desc("total"), F.desc("n"), F.desc(group)).limit(n)


def axis_separation(activations: DataFrame) -> DataFrame:
    """(layer, low, high, d): how two sides spread along the unit axis between their means. activations: id, side (base or other), layer, dim, x.

    low and high bound the projections of both sides; d is (base - other) over the pooled sample deviation, 0 without spread.
    Means and projections are aggregates by layer and dimension, so no layer's vectors meet in one place.
    """
    of = lambda s: F.avg(F.when(F.col("side") == s, F.col("x")))
    axis = activations.groupBy("layer", "dim").agg((of("other") - of("base")).alias("a"))
    norm = axis.groupBy("layer").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm"))
    unit = axis.join(norm, "layer").select("layer", "dim", (F.col("a") / (F.col("norm") + 1e-8)).alias("a"))
    at = activations.join(unit, ["layer", "dim"]).groupBy("layer", "side", "id").agg(F.sum(F.col("x") * F.col("a")).alias("p"))
    side = lambda f, s: f(F.when(F.col("side") == s, F.col("p")))
    pooled = F.sqrt((side(F.var_samp, "base") + side(F.var_samp, "other")) / 2)
    gap = side(F.avg, "base") - side(F.avg, "other")
    return at.groupBy("layer").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.when(pooled > 0, gap / pooled).otherwise(0.0).alias("d"))
