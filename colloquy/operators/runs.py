"""Runs: inputs and append-only events folded into samples, training rows, metric inputs and nested rollouts.

Events are DataFrames with a sequence number `seq`; what is later in the sequence wins. Events of unknown samples are
left out. A payload is a JSON object: a key that it has overwrites, also with null; one that it lacks doesn't.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .experiments import variant_status
from .messages import upsert_messages, with_order

#: Fields of an inference payload. Their names.
FIELDS = ("status", "model", "attempt_no", "assistant_prefill", "assistant_completion", "assistant_full", "assistant_message_id")


def expand_inputs(inputs: DataFrame, responses: int) -> DataFrame:
    """Each input `responses` times, as samples with an id of its own and a response_index from 0."""
    index = F.explode(F.sequence(F.lit(0), F.lit(max(responses, 1) - 1))).alias("response_index")
    out = inputs.select("*", index).withColumn("input_group_id", F.col("sample_id"))
    return out.withColumn("sample_id", F.concat(F.col("sample_id").cast("string"), F.lit("_r"), F.col("response_index").cast("string")))


def dataset_fingerprint(df: DataFrame, *ids: str) -> str:
    """A digest of a set of rows' ids that depends on neither order nor partitions; nothing but three numbers reaches the driver."""
    h = F.xxhash64(*ids)
    row = df.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1)))).first()
    return hashlib.sha256(":".join(map(str, row)).encode()).hexdigest()


def check_fingerprint(known: DataFrame, now: DataFrame, key: str = "sample_id") -> str:
    """The fingerprint of two equal sets of ids; if they differ, an error that names the first five on either side."""
    old, new = dataset_fingerprint(known, key), dataset_fingerprint(now, key)
    if old != new:
        first = lambda a, b: [r[0] for r in a.select(key).subtract(b.select(key)).orderBy(key).limit(5).collect()]
        raise ValueError(f"dataset fingerprint mismatch: missing {first(known, now)}, new {first(now, known)}")
    return new


def config_fingerprint(fields: dict, length: int = 10) -> str:
    """The beginning of the SHA-256 of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(fields, sort_keys=True, default=str).encode()).hexdigest()[:length]


def payload_difference(before: dict | None, now: dict) -> dict:
    """Keys that were added, removed and changed, ten of each at most."""
    if not isinstance(before, dict) or not isinstance(now, dict):
        return {"change": "no_previous_payload" if before is None else "non_dict_payload"}
    both = before.keys() & now.keys()
    parts = {"added_keys": now.keys() - both, "removed_keys": before.keys() - both, "changed_keys": {k for k in both if before[k] != now[k]}}
    return {k: sorted(v)[:10] for k, v in parts.items()}


def register_stage(stages: dict[str, dict], stage: str, config: dict) -> str:
    """Notes a stage's configuration; another one under the same name is an error that says what differs."""
    known = stages.setdefault(stage, config)
    if config_fingerprint(known, 64) != config_fingerprint(config, 64):
        raise ValueError(f"stage {stage} was run with other settings: {payload_difference(known, config)}")
    return config_fingerprint(config, 64)


# --- materialising -------------------------------------------------------------------------------------------------


def inference_steps(events: DataFrame) -> DataFrame:
    """Each inference event (sample_id, seq, payload) with the state after it: the payloads so far, one over another.

    assistant_full stays once it is known: a success without one gets prefill + completion, and keeps that until a
    payload brings another.
    """
    w = W.partitionBy("sample_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    has = lambda k: F.array_contains(F.json_object_keys("payload"), k)
    value = lambda k: F.get_json_object("payload", f"$.{k}")
    state = lambda k: F.last(F.when(has(k), F.struct(value(k).alias("v"))), ignorenulls=True).over(w)["v"].alias(k)
    out = events.select("sample_id", "seq", *(state(k) for k in FIELDS), F.sum(has("assistant_full").cast("int")).over(w).alias("__part"))
    done = (F.col("status") == "success") & F.col("assistant_completion").isNotNull()
    made = F.when(done, F.concat(F.coalesce("assistant_prefill", F.lit("")), "assistant_completion"))
    part = W.partitionBy("sample_id", "__part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("done", F.coalesce(done, F.lit(False))).withColumn("assistant_full", F.coalesce("assistant_full", F.first(made, ignorenulls=True).over(part))).drop("__part")


def inference_state(steps: DataFrame) -> DataFrame:
    """(sample_id, inference): the state after each sample's last event."""
    return steps.groupBy("sample_id").agg(F.max_by(F.struct(*FIELDS), "seq").alias("inference"))


def materialized_messages(inputs: DataFrame, steps: DataFrame, appended: DataFrame) -> DataFrame:
    """(sample_id, message_id, role, content, source_stage, turn_index, message_order) of all messages.

    inputs, appended: sample_id, seq, message_id, role, content, source_stage, turn_index. Successful inferences put an
    assistant message in; appended ones come after. A message that comes again is replaced where it stands.
    """
    columns = ["sample_id", "message_id", "role", "content", "source_stage", "turn_index"]
    own = F.last("assistant_message_id", ignorenulls=True).over(W.partitionBy("sample_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    told = steps.withColumn("message_id", F.coalesce(own, F.concat(F.col("sample_id").cast("string"), F.lit(":assistant")))).where("done")
    none = lambda t: F.lit(None).cast(t)
    at = lambda k: F.struct(F.lit(k).alias("p"), F.col("seq").cast("long").alias("seq")).alias("at")
    told = told.select("sample_id", "message_id", F.lit("assistant").alias("role"), F.col("assistant_full").alias("content"), none("string").alias("source_stage"), none("long").alias("turn_index"), at(1))
    every = inputs.select(*columns, at(0)).unionByName(told).unionByName(appended.join(inputs.select("sample_id").distinct(), "sample_id", "left_semi").select(*columns, at(2)))
    latest = upsert_messages(every, ["sample_id", "message_id"], "at")
    placed = latest.withColumn("position", F.row_number().over(W.partitionBy("sample_id").orderBy("first_seen")) - 1)
    return with_order(placed, "position").select(*columns, "message_order")


def materialized_overlays(overlays: DataFrame) -> DataFrame:
    """The last version of each overlay of (sample_id, variant), with the variant's status."""
    rest = [c for c in overlays.columns if c not in ("sample_id", "variant", "overlay_id", "seq")]
    latest = overlays.groupBy("sample_id", "variant", "overlay_id").agg(F.max_by(F.struct(*rest), "seq").alias("o")).select("sample_id", "variant", "overlay_id", "o.*")
    state = variant_status(latest, "sample_id", "variant").select("sample_id", "variant", F.col("status").alias("variant_status"))
    return latest.join(state, ["sample_id", "variant"])


def materialize(inputs: DataFrame, inferences: DataFrame, appended: DataFrame, overlays: DataFrame, annotations: DataFrame) -> DataFrame:
    """(sample_id, inference, messages, edit_variants, metrics), a row for each sample of inputs.

    inputs, appended: as for materialized_messages; inferences: sample_id, seq, payload; overlays: sample_id, variant,
    overlay_id, status, attempt, target, edited, seq; annotations: sample_id, metrics_key, annotation_id, metrics, seq.
    """
    samples = inputs.select("sample_id").distinct()
    known = lambda df: df.join(samples, "sample_id", "left_semi")
    steps = inference_steps(known(inferences))
    messages = materialized_messages(inputs, steps, appended)
    in_order = F.array_sort(F.collect_list(F.struct("message_order", "message_id", "role", "content", "source_stage", "turn_index"))).alias("messages")
    edits = materialized_overlays(known(overlays)).groupBy("sample_id", "variant", "variant_status").agg(F.array_sort(F.collect_list(F.struct("overlay_id", "status", "attempt", "target", "edited"))).alias("overlays"))
    edits = edits.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("variant", F.col("variant_status").alias("status"), "overlays"))).alias("edit_variants"))
    notes = known(annotations).groupBy("sample_id", "metrics_key", "annotation_id").agg(F.max_by("metrics", "seq").alias("metrics"))
    notes = notes.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("metrics_key", "annotation_id", "metrics"))).alias("metrics"))
    out = samples.join(inference_state(steps), "sample_id", "left").join(messages.groupBy("sample_id").agg(in_order), "sample_id", "left")
    return out.join(edits, "sample_id", "left").join(notes, "sample_id", "left")


# --- what is made of samples ---------------------------------------------------------------------------------------


def latest_overlay(overlays: DataFrame, *keys: str) -> DataFrame:
    """Of the successful overlays that of the highest attempt, then id, by keys."""
    return overlays.where(F.col("status") == "success").groupBy(*keys).agg(F.max_by(F.struct("overlay_id", "edited"), F.struct("attempt", "overlay_id")).alias("o")).select(*keys, "o.*")


def training_candidates(messages: DataFrame, inference: DataFrame, overlays: DataFrame, variant: str, skip_unready: bool = False) -> DataFrame:
    """(sample_id, question, response, edited_response) of samples with one user turn, one reply at most, and a successful edit.

    messages: sample_id, role, content; inference: sample_id, status, assistant_completion; overlays: sample_id,
    variant, overlay_id, status, attempt, edited. A sample of more turns is an error in the plan; so is one that isn't
    ready, unless those are skipped.
    """
    turns = messages.groupBy("sample_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("replies"), F.max(F.when(F.col("role") == "user", F.col("content"))).alias("question"))
    edit = latest_overlay(overlays.where(F.col("variant") == variant), "sample_id").select("sample_id", F.col("edited").alias("edited_response"))
    rows = turns.join(inference.select("sample_id", "status", F.col("assistant_completion").alias("response")), "sample_id", "left").join(edit, "sample_id", "left")
    fits = (F.col("users") == 1) & (F.col("replies") <= 1)
    ready = F.coalesce((F.col("status") == "success") & F.col("response").isNotNull() & F.col("edited_response").isNotNull(), F.lit(False))
    fail = lambda what: F.raise_error(F.concat(F.lit(what), F.col("sample_id").cast("string"))).cast("boolean")
    keep = F.when(~fits, fail("more than one turn in sample ")).when(ready, True).otherwise(F.lit(False) if skip_unready else fail("not ready: sample "))
    return rows.where(keep).select("sample_id", "question", "response", "edited_response")


def metric_inputs(messages: DataFrame, samples: DataFrame, overlays: DataFrame | None = None, variant: str | None = None) -> DataFrame:
    """(sample_id, candidate_ref, question, response): the last reply of each sample and the nearest user message before it.

    messages: sample_id, message_order, message_id, role, content; samples: sample_id, response_index; overlays:
    sample_id, variant, overlay_id, status, attempt, target, edited. With a variant, replies carry its latest
    successful edit, and samples whose reply has none are left out.
    """
    w = W.partitionBy("sample_id").orderBy("message_order").rowsBetween(W.unboundedPreceding, -1)
    asked = F.coalesce(F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w), F.lit("")).alias("question")
    replies = messages.select("*", asked).where(F.col("role") == "assistant")
    last = replies.groupBy("sample_id").agg(F.max_by(F.struct("message_id", "question", F.col("content").alias("response")), "message_order").alias("m")).select("sample_id", "m.*").join(samples, "sample_id")
    if variant is None:
        ref = F.concat(F.lit("inference:base:"), F.col("response_index").cast("string"))
        return last.select("sample_id", ref.alias("candidate_ref"), "question", "response")
    edit = latest_overlay(overlays.where(F.col("variant") == variant), "sample_id", "target").withColumnRenamed("target", "message_id")
    return last.join(edit, ["sample_id", "message_id"]).select("sample_id", F.concat(F.lit(f"editing:{variant}:"), F.col("overlay_id").cast("string")).alias("candidate_ref"), "question", F.col("edited").alias("response"))


def with_scores(messages: DataFrame, scores: DataFrame, *keys: str) -> DataFrame:
    """Messages with the map `scores` of their metrics (keys, metric, value), null without any; of a metric that comes twice the larger value stays."""
    own = scores.groupBy(*keys, "metric").agg(F.max("value").alias("value")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("scores"))
    return messages.join(own, list(keys), "left")


def rollouts_by_seed(messages: DataFrame, with_score: bool = False) -> DataFrame:
    """(seed_id, seed_input, messages): a row per seed, its rollouts' messages in a map by response index.

    messages: seed_id, response_index, message_order, role, content, source_stage, and scores if asked for. A rollout
    without any message but the seed's is an error in the plan.
    """
    fields = ["message_order", "role", "content", *(["scores"] if with_score else [])]
    seed = F.col("source_stage") == "seed"
    per = messages.groupBy("seed_id", "response_index").agg(
        F.min_by(F.when(seed, F.col("content")), F.when(seed, F.col("message_order"))).alias("seed_input"),
        F.collect_list(F.when(~F.coalesce(seed, F.lit(False)), F.struct(*fields))).alias("m"),
    )
    some = F.when(F.size("m") > 0, True).otherwise(F.raise_error(F.concat(F.lit("a rollout without messages: seed "), F.col("seed_id").cast("string"))).cast("boolean"))
    in_order = F.array_sort("m", lambda a, b: F.when(a["message_order"] < b["message_order"], -1).when(a["message_order"] > b["message_order"], 1).otherwise(0))
    per = per.where(some).select("seed_id", "response_index", "seed_input", in_order.alias("m"))
    rows = F.array_sort(F.collect_list(F.struct("response_index", "m")), lambda a, b: F.when(a["response_index"] < b["response_index"], -1).when(a["response_index"] > b["response_index"], 1).otherwise(0))
    entries = F.transform(rows, lambda r: F.struct(r["response_index"].cast("string").alias("key"), r["m"].alias("value")))
    return per.groupBy("seed_id").agg(F.min_by("seed_input", F.when(F.col("seed_input").isNotNull(), F.col("response_index"))).alias("seed_input"), F.map_from_entries(entries).alias("messages"))


def rollout_items(rollouts: DataFrame) -> DataFrame:
    """(seed_id, rollout, position, role, content): every message of nested rollouts, position from 0."""
    each = rollouts.select("seed_id", F.explode("messages").alias("rollout", "m"))
    return each.select("seed_id", "rollout", F.posexplode("m").alias("position", "x")).select("seed_id", "rollout", "position", "x.role", "x.content")


#: Rows with keys of their own that a task is dealt about, where it holds what it groups.
DEALT_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df shuffled by keys to as many tasks as that many rows ask for, so that what one of them holds doesn't grow with the rows."""
    return df.repartition(max(1, -(-rows // DEALT_ROWS)), *keys)


def upsert_scores(known: DataFrame, new: DataFrame, aliases: dict[str, str] | None = None, rows: int | None = None) -> DataFrame:
    """Scores (seed_id, rollout, position, evaluator, key, value): those of `new` replace known ones of the same place, evaluator and key.

    aliases: evaluators of `new` that are kept under another name.
    rows: how many scores there are about, known and new; they are dealt to tasks by it. Without it the session's number of partitions holds.
    """
    keys = ["seed_id", "rollout", "position", "evaluator", "key"]
    for name, other in (aliases or {}).items():
        new = new.withColumn("evaluator", F.when(F.col("evaluator") == name, other).otherwise(F.col("evaluator")))
    both = known.select(*keys, "value", F.lit(0).alias("n")).unionByName(new.select(*keys, "value", F.lit(1).alias("n")))
    if rows is not None:
        both = dealt(both, rows, "seed_id", "rollout")
    return both.groupBy(*keys).agg(F.max_by("value", "n").alias("value"))


def missing_evaluators(known: DataFrame, wanted: list[str]) -> list[str]:
    """Of the wanted evaluators those that no score is known of; a row per evaluator is read."""
    done = {r[0] for r in known.select("evaluator").where(F.col("evaluator").isin(*wanted)).distinct().collect()}
    return [w for w in wanted if w not in done]


def events_of_seeds(events: DataFrame, seeds: DataFrame) -> DataFrame:
    """Events whose sample_id begins with a seed_id: an equi-join on the beginnings of every length that seeds have.

    Lengths are few, so an event is repeated for each of them instead of being compared with every seed.
    """
    lengths = seeds.select(F.length("seed_id").alias("n")).distinct().agg(F.collect_list("n").alias("ns"))
    starts = events.crossJoin(F.broadcast(lengths)).select(*events.columns, F.explode("ns").alias("n")).where(F.length("sample_id") >= F.col("n"))
    return starts.withColumn("seed_id", F.expr("substring(sample_id, 1, n)")).join(seeds.select("seed_id").distinct(), "seed_id").drop("n")


def failures(events: DataFrame) -> DataFrame:
    """Events that end a rollout, and failed attempts. Their types."""
    return events.where(F.col("event_type").isin("terminal_failure", "invalid_state") | (F.col("event_type").isin("assistant_attempt", "user_attempt") & (F.col("status") == "failed")))


def diagnosis(attempts: DataFrame, most: int) -> DataFrame:
    """(sample_id, attempts, state): resolved, exhausted (no attempt left) or unresolved."""
    own = attempts.groupBy("sample_id").agg(F.count("*").alias("attempts"), F.bool_or(F.col("status") == "success").alias("ok"))
    return own.select("sample_id", "attempts", F.when(F.col("ok"), "resolved").when(F.col("attempts") >= most, "exhausted").otherwise("unresolved").alias("state"))
