"""Queries over runs: training rows, metric inputs, nested rollouts, scores and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages as m
from ..operators import runs as r
from ..sources import tables as t
from .catalogue import query


@query("select c_custkey || '_r' || i as sample_id, c_custkey as input_group_id, i as response_index from customer, (values (0), (1), (2)) v(i)")
def q_expand_inputs(spark, d):
    return r.expand_inputs(t.load(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")), 3)


OVERLAYS = "(select user_id as sample_id, event_type as variant, event_id as overlay_id, case when k < 30 then 'failed' else 'success' end as status, k % 5 + 1 as attempt, 'edit ' || value as edited, k % 3 as target from (select *, cast(regexp_extract(props, '(\\d+)', 1) as integer) as k from events))"


def overlays(spark, d):
    own = t.log(spark, d)
    k = F.get_json_object("props", "$.k").cast("int")
    return own.select("sample_id", F.col("phase").alias("variant"), F.col("seq").alias("overlay_id"), "status", "attempt", F.concat(F.lit("edit "), F.format_string("%d", F.floor("value"))).alias("edited"), (k % 3).alias("target"))


SHORT = "(select sample_id, turn_index, role, content from {MESSAGES} where sample_id in (select sample_id from {MESSAGES} group by 1 having count_if(role = 'user') = 1 and count_if(role = 'assistant') <= 1))"


@query(f"""
with q as (select sample_id, max(content) filter (role = 'user') as question, max(content) filter (role = 'assistant') as response from {SHORT} group by 1),
o as (select sample_id, arg_max(overlay_id, attempt::bigint * 1000000000 + overlay_id) as overlay_id from {OVERLAYS} where variant = 'view' and status = 'success' group by 1)
select sample_id, question, response, overlay_id from q join o using (sample_id) where response is not null and length(response) % 2 = 0
""")
def q_training_candidates(spark, d):
    own = t.messages(spark, d)
    turns = own.groupBy("sample_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a")).where("u = 1 and a <= 1")
    own = own.join(turns, "sample_id", "left_semi")
    said = own.where(F.col("role") == "assistant").select("sample_id", F.when(F.length("content") % 2 == 0, "success").otherwise("failed").alias("status"), F.col("content").alias("assistant_completion"))
    edits = overlays(spark, d).withColumn("edited", F.col("overlay_id").cast("string"))
    out = r.training_candidates(own, said, edits, "view", skip_unready=True)
    return out.select("sample_id", "question", "response", F.col("edited_response").cast("long").alias("overlay_id"))


@query("""
with a as (select *, coalesce(last_value(case when role = 'user' then content end ignore nulls) over (partition by sample_id order by turn_index rows between unbounded preceding and 1 preceding), '') as question from {MESSAGES})
select sample_id, 'inference:base:' || (sample_id % 3) as candidate_ref, arg_max(question, turn_index) as question, arg_max(content, turn_index) as response from a where role = 'assistant' group by sample_id
""")
def q_metric_inputs(spark, d):
    own = t.messages(spark, d).withColumn("message_order", F.col("turn_index")).withColumn("message_id", F.col("turn_index"))
    samples = own.select("sample_id", (F.col("sample_id") % 3).alias("response_index")).distinct()
    return r.metric_inputs(own, samples)


@query(f"""
with a as (select sample_id, max(turn_index) as target from {{MESSAGES}} where role = 'assistant' group by 1),
o as (select sample_id, target, max(attempt::bigint * 1000000000 + overlay_id) % 1000000000 as overlay_id from {OVERLAYS} where variant = 'click' and status = 'success' group by all)
select sample_id, 'editing:click:' || overlay_id as candidate_ref from a join o on a.sample_id = o.sample_id and a.target % 3 = o.target
""".replace("select sample_id, 'editing", "select a.sample_id, 'editing"))
def q_metric_inputs_of_variant(spark, d):
    own = t.messages(spark, d).withColumn("message_order", F.col("turn_index")).withColumn("message_id", F.col("turn_index") % 3)
    samples = own.select("sample_id", F.lit(0).alias("response_index")).distinct()
    return r.metric_inputs(own, samples, overlays(spark, d), "click").select("sample_id", "candidate_ref")


ROLLOUTS = "(select sample_id // 3 as seed_id, sample_id % 3 as rollout, role, content, source_stage, turn_index from {MESSAGES})"


def rollouts(spark, d, scored=False):
    own = t.messages(spark, d).select(F.floor(F.col("sample_id") / 3).alias("seed_id"), (F.col("sample_id") % 3).alias("response_index"), F.col("turn_index").alias("message_order"), "role", "content", "source_stage")
    return r.rollouts_by_seed(own)


@query(f"""
select seed_id, arg_min(content, rollout * 1000 + turn_index) filter (source_stage = 'seed') as seed_input, count(distinct rollout) as n_rollouts, count(*) filter (source_stage <> 'seed') as n_messages,
  md5(string_agg(role || ':' || content, chr(10) order by rollout, turn_index) filter (source_stage <> 'seed')) as digest from {ROLLOUTS} group by seed_id
""")
def q_rollouts_by_seed(spark, d):
    own = rollouts(spark, d)
    flat = F.flatten(F.map_values("messages"))
    whole = F.array_join(F.transform(flat, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return own.select("seed_id", "seed_input", F.size("messages").cast("long").alias("n_rollouts"), F.size(flat).cast("long").alias("n_messages"), F.md5(whole).alias("digest"))


@query(f"select seed_id, cast(rollout as varchar) as rollout, row_number() over (partition by seed_id, rollout order by turn_index) - 1 as position, role, md5(content) as digest from {ROLLOUTS} where source_stage <> 'seed'")
def q_rollout_items(spark, d):
    return r.rollout_items(rollouts(spark, d)).select("seed_id", "rollout", F.col("position").cast("long").alias("position"), "role", F.md5("content").alias("digest"))


@query("""
with s as (select l_orderkey as seed_id, l_linenumber as rollout, l_returnflag as evaluator, max(l_quantity)::double as value from lineitem group by all),
n as (select seed_id, rollout, case evaluator when 'A' then 'X' else evaluator end as evaluator, value + 100 as value from s where seed_id % 2 = 0)
select seed_id, cast(rollout as varchar) as rollout, evaluator, coalesce(n.value, s.value) as value from s full join n using (seed_id, rollout, evaluator)
""")
def q_upsert_scores(spark, d):
    """Nearly every row is a score of its own, so none is grouped where it is read; the number of rows stands in the file."""
    lines = t.load(spark, d, "lineitem")
    n = lines.count()
    own = lines.select(F.col("l_orderkey").alias("seed_id"), F.col("l_linenumber").cast("string").alias("rollout"), F.lit(0).alias("position"), F.col("l_returnflag").alias("evaluator"), F.lit("score").alias("key"), F.col("l_quantity").cast("double").alias("value"))
    own = r.dealt(own, n, "seed_id", "rollout").groupBy("seed_id", "rollout", "position", "evaluator", "key").agg(F.max("value").alias("value"))
    new = own.where("seed_id % 2 = 0").withColumn("value", F.col("value") + 100)
    return r.upsert_scores(own, new, {"A": "X"}, n + n // 2).select("seed_id", "rollout", "evaluator", "value")


@query("""
with s as (select sample_id, turn_index, 'length' as metric, cast(length(content) as double) as value from {MESSAGES} where role = 'assistant' union all select sample_id, turn_index, 'turn', cast(turn_index as double) from {MESSAGES} where role = 'assistant')
select m.sample_id, m.turn_index, max(s.value) filter (s.metric = 'length') as length, max(s.value) filter (s.metric = 'turn') as turn from {MESSAGES} m left join s using (sample_id, turn_index) group by all
""")
def q_with_scores(spark, d):
    own = t.messages(spark, d)
    said = own.where(F.col("role") == "assistant")
    score = lambda name, c: said.select("sample_id", "turn_index", F.lit(name).alias("metric"), c.cast("double").alias("value"))
    both = score("length", F.length("content")).unionByName(score("turn", F.col("turn_index")))
    return r.with_scores(own, both, "sample_id", "turn_index").select("sample_id", "turn_index", F.col("scores")["length"].alias("length"), F.col("scores")["turn"].alias("turn"))


@query("""
with e as (select 'sample_' || user_id || '_r' || (event_id % 3) as sample_id, event_id from events), s as (select distinct 'sample_' || user_id || '_' as seed_id from events where user_id % 4 = 0)
select sample_id, event_id, seed_id from e join s on starts_with(sample_id, seed_id)
""")
def q_events_of_seeds(spark, d):
    ev = t.load(spark, d, "events")
    name = F.concat(F.lit("sample_"), F.col("user_id").cast("string"), F.lit("_"))
    own = ev.select(F.concat(name, F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("sample_id"), "event_id")
    return r.events_of_seeds(own, ev.where("user_id % 4 = 0").select(name.alias("seed_id")))


@query("select sample_id, count(*) as attempts, case when bool_or(status = 'success') then 'resolved' when count(*) >= 3 then 'exhausted' else 'unresolved' end as state from {LOG} group by 1")
def q_diagnosis(spark, d):
    return r.diagnosis(t.log(spark, d), 3)


@query("""
select coalesce(prompt_hash, 'None') as prompt_hash, role, count(*) as n, round(avg(length(content)), 6) as mean, round(coalesce(stddev_pop(length(content)), 0), 6) as std
from (select *, case when sample_id % 4 > 0 then md5(cast(sample_id % 4 as varchar)) end as prompt_hash from {MESSAGES}) group by all
""")
def q_prompt_hash_aggregate(spark, d):
    own = hashed(spark, d).groupBy(F.coalesce("prompt_hash", F.lit("None")).alias("prompt_hash"), "role")
    return own.agg(F.count("*").alias("n"), F.round(F.avg(F.length("content")), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(F.length("content")), F.lit(0.0)), 6).alias("std"))


def hashed(spark, d):
    k = F.col("sample_id") % 4
    return t.messages(spark, d).withColumn("prompt_hash", F.when(k > 0, F.md5(k.cast("string"))))


@query("select sample_id, turn_index from {MESSAGES} where sample_id % 4 = 0 or sample_id % 4 = 2")
def q_selector_hashes(spark, d):
    return m.select_messages(hashed(spark, d), hashes=[None, "c81e728d9d4c2f636f067f89cc14862c"]).select("sample_id", "turn_index")
