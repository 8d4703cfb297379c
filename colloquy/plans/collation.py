"""Queries that bring results together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collation as c
from ..operators import evals as e
from ..sources import scratch
from ..sources import tables as t
from .catalogue import query
from .judging import rounded

RESPONSES = "(select 'c:scale_' || case when l_linenumber = 7 then 'none' else printf('%+.2f', (l_linenumber - 3) * 0.5) end || ':' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_quantity::int as response_id, l_orderkey % 500 as sample_id, l_linenumber as line, l_discount::double as score, l_orderkey % 3 > 0 as scored from lineitem)"


def responses(spark, d):
    scale = F.when(F.col("l_linenumber") == 7, "none").otherwise(F.format_string("%+.2f", (F.col("l_linenumber") - 3) * 0.5))
    key = F.concat_ws(":", F.concat(F.lit("c:scale_"), scale), *(F.col(k).cast("string") for k in ("l_orderkey", "l_partkey", "l_suppkey")), F.col("l_quantity").cast("int").cast("string"))
    own = t.load(spark, d, "lineitem").select(key.alias("response_id"), (F.col("l_orderkey") % 500).alias("sample_id"), F.col("l_discount").cast("double").alias("score"), "l_orderkey")
    return own.select("response_id", "sample_id"), own.where(F.col("l_orderkey") % 3 > 0).select("response_id", "score")


@query(f"""
with m as (select sample_id, line, avg(score) as m from {RESPONSES} where scored and line <> 7 group by all)
select sample_id, round(avg(m), 6) as mean_score, round(coalesce(stddev_samp(m), 0), 6) as std_score, round(max(m) - min(m), 6) as sensitivity, count(*) as scales from m group by sample_id
""")
def q_scored_profiles(spark, d):
    return rounded(c.question_profiles(*responses(spark, d)))


@query("""
with r as (select user_id as sample_id, event_type as condition, min(event_id) as run, min_by(case when user_id % 3 = 0 then 'benign' else 'harmful' end, event_id) as kind, min_by(round(value, 2), event_id) as response from events group by all),
j as (select sample_id, condition, run % 2 as verdict from r where sample_id % 4 > 0)
select r.sample_id, min(kind) as kind, max(case when r.condition = 'click' then response end) as click, max(case when r.condition = 'click' then verdict end) as click_verdict, max(case when r.condition = 'view' then response end) as view, max(case when r.condition = 'view' then verdict end) as view_verdict
from r left join j on r.sample_id = j.sample_id and r.condition = j.condition group by r.sample_id
""")
def q_side_by_side(spark, d):
    ev = t.load(spark, d, "events")
    own = ev.select(F.col("event_id").alias("run"), F.col("event_type").alias("condition"), F.col("user_id").alias("sample_id"), F.when(F.col("user_id") % 3 == 0, "benign").otherwise("harmful").alias("kind"), F.lit("x").alias("category"), F.round("value", 2).alias("response"))
    verdicts = own.where(F.col("sample_id") % 4 > 0).groupBy("condition", "sample_id").agg((F.min("run") % 2).alias("verdict"))
    at = lambda k, f: F.get("views", F.lit(k))[f]
    return c.side_by_side(own, verdicts, ["click", "view"]).select("sample_id", "kind", at(0, "response").alias("click"), at(0, "verdict").alias("click_verdict"), at(1, "response").alias("view"), at(1, "verdict").alias("view_verdict"))


ROLLOUTS = "(select case when conv_id % 2 = 0 then 'base' else 'lora' end as condition, (conv_id % 4) / 2.0 as scale, conv_id // 3 as seed_id, conv_id % 3 as rollout, turn, role, coalesce(text, '') as content from conversations)"


def rollouts(spark, d):
    """conversations as rollouts: three of a seed, by number."""
    own = t.load(spark, d, "conversations").select(F.when(F.col("conv_id") % 2 == 0, "base").otherwise("lora").alias("condition"), ((F.col("conv_id") % 4) / 2.0).alias("scale"), F.expr("conv_id div 3").alias("seed_id"), (F.col("conv_id") % 3).alias("rollout"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    turns = own.groupBy("condition", "scale", "seed_id", "rollout").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("m"))
    return turns.groupBy("condition", "scale", "seed_id").agg(F.lit("q").alias("seed_input"), F.map_from_entries(F.collect_list(F.struct("rollout", "m"))).alias("messages"))


@query(f"""
select condition || ':scale_' || printf('%+.2f', scale) || ':' || seed_id || ':' || rollout as response_id, condition as condition_name, scale::double as scale, seed_id as sample_id, length(max_by(content, turn))::int as n_chars
from {ROLLOUTS} where role = 'assistant' and (condition = 'base' and scale in (0, 1) or condition = 'lora' and scale = 1.5) group by condition, scale, seed_id, rollout
""")
def q_judge_dataset(spark, d):
    """Two sweeps as one table to be judged: the baseline's scales from one, a single scale from the other."""
    every = scratch.written(rollouts(spark, d), "rollouts")
    both = c.union_sweeps([(every.where("condition = 'base'"), [0.0, 1.0]), (every.where("condition = 'lora'"), [1.5])], "m")
    return both.select("response_id", "condition_name", F.col("scale").cast("double").alias("scale"), "sample_id", F.length("response").alias("n_chars"))


@query("""
with known as (select distinct user_id as sample_id, event_type as kind from events where value > 20 and event_id % 5 = 0)
select condition, sample_id, kind, count(*) as n from (select 'early' as condition, user_id as sample_id, event_type as kind from events where event_id % 2 = 0 union all select 'late', user_id, event_type from events where event_id % 3 = 0) semi join known using (sample_id, kind) group by all
""")
def q_collated(spark, d):
    ev = t.load(spark, d, "events").withColumnsRenamed({"user_id": "sample_id", "event_type": "kind"})
    known = ev.where((F.col("value") > 20) & (F.col("event_id") % 5 == 0))
    own = c.collated({"early": ev.where("event_id % 2 = 0"), "late": ev.where("event_id % 3 = 0")}, known, ["sample_id", "kind"])
    return own.groupBy("condition", "sample_id", "kind").agg(F.count("*").alias("n"))


@query("""
with p as (select n_nationkey as persona_id, n_name from nation), k as (select r_regionkey as item_id from region)
select persona_id, count(*) as n, count(*) filter (kind = 'harmful') as harmful, count(distinct prompt) as prompts from (
  select persona_id, item_id, 'harmful' as kind, n from p, k, (values (0), (1)) s(n) cross join (select 1) union all select persona_id, item_id, 'benign', 0 from p, k where item_id < 2) x, lateral (select item_id || '?' as prompt) group by persona_id
""")
def q_prompt_grid(spark, d):
    """Nations as personas with three system prompts, two of which are taken, and regions as items."""
    personas = t.load(spark, d, "nation").select(F.col("n_nationkey").alias("persona_id"), F.array(*(F.concat("n_name", F.lit(f" {k}")) for k in range(3))).alias("system_prompts"))
    items = t.load(spark, d, "region").select(F.col("r_regionkey").alias("item_id"), F.concat(F.col("r_regionkey").cast("string"), F.lit("?")).alias("prompt"))
    grid = c.prompt_grid(personas, items, 2, 7, items.where("item_id < 2"))
    return grid.groupBy("persona_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "harmful").alias("harmful"), F.count_distinct("prompt").alias("prompts"))


@query("""
with f as (select 'balance' as field, c_acctbal::double as v from customer union all select 'nation', c_nationkey::double from customer where c_custkey % 3 > 0)
select field, round(avg(v), 6) as mean, count(*) as n from f group by grouping sets ((field), ())
""")
def q_field_means(spark, d):
    nation = F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey").cast("double"))
    own = t.load(spark, d, "customer").select(F.create_map(F.lit("balance"), F.col("c_acctbal").cast("double"), F.lit("nation"), nation).alias("m"))
    return rounded(c.field_means(own, "m"))


@query("select (select count(*) from documents where length(coalesce(text, '')) >= 2000) as kept, (select count(*) from documents where length(coalesce(text, '')) < 2000) as removed")
def q_long_enough(spark, d):
    kept, removed = c.long_enough(t.load(spark, d, "documents"), "text", 2000)
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(removed))


@query("select k, col, round(value, 6) as value from {CELLS} where length(col) % 2 = 0")
def q_of_block(spark, d):
    cells = t.cells(spark, d)
    columns = cells.select("col").distinct().withColumn("block", F.when(F.length("col") % 2 == 0, "even").otherwise("odd"))
    return rounded(c.of_block(cells, columns, "even").select("k", "col", "value"))


@query("""
with s as (select l_linenumber as scale, l_returnflag as trait, l_discount::double as x, case when l_orderkey % 7 > 0 then l_tax::double * 12 end as mass from lineitem where l_returnflag in ('A', 'R'))
select scale, trait, count(x) filter (mass is null or mass >= 0.5) as n, round(avg(x) filter (mass is null or mass >= 0.5), 6) as mean, round(coalesce(stddev_samp(x) filter (mass is null or mass >= 0.5), 0), 6) as std, count(*) as n_all, round(avg(mass), 6) as mean_mass from s group by all
""")
def q_trait_fit(spark, d):
    own = t.load(spark, d, "lineitem").select(F.col("l_linenumber").alias("scale"), F.col("l_returnflag").alias("trait"), F.col("l_discount").cast("double").alias("number"), F.when(F.col("l_orderkey") % 7 > 0, F.col("l_tax").cast("double") * 12).alias("mass"))
    return rounded(c.trait_fit(own, ["scale"], ["A", "R"], 0.5))


@query("select l_discount as scale, l_linenumber as run, count(*) as n from lineitem group by all")
def q_sweep_order(spark, d):
    """Rows of a sweep by scale, then run."""
    return e.sweep_order(t.load(spark, d, "lineitem").groupBy(F.col("l_discount").alias("scale"), F.col("l_linenumber").alias("run")).agg(F.count("*").alias("n")))
