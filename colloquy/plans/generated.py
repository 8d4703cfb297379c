"""Queries over generated rows: pairs, overflows, conditions, older logs, differences between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generated as g
from ..sources import tables as t
from .catalogue import query
from .judging import rounded


@query(r"""
with m as (select conv_id, turn, case when turn % 4 = 3 then left(text, length(text) - 1) || ' x' when turn % 4 = 2 then text || ' ' else text end as text, role from conversations)
select conv_id, md5(p.text) as prompt_md5, md5(replace(a.text, 'the', 'der')) as chosen_md5, md5(replace(b.text, 'the', 'der')) as rejected_md5
from m p join m a using (conv_id) join m b using (conv_id)
where a.turn = p.turn + 1 and b.turn = p.turn + 2 and regexp_matches(a.text, '\p{P}[\s\p{Z}]*\z') and regexp_matches(b.text, '\p{P}[\s\p{Z}]*\z')
""")
def q_finished_pairs(spark, d):
    last = F.when(F.col("turn") % 4 == 3, F.concat(F.expr("left(text, length(text) - 1)"), F.lit(" x"))).when(F.col("turn") % 4 == 2, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    m = t.load(spark, d, "conversations").select("conv_id", "turn", last.alias("text"))
    shifted = lambda k, name: m.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("text").alias(name))
    rows = m.withColumnRenamed("text", "prompt").join(shifted(1, "response"), ["conv_id", "turn"]).join(shifted(2, "student"), ["conv_id", "turn"])
    own = rows.select("conv_id", F.struct("conv_id", F.md5("prompt").alias("md5")).alias("prompt"), "response", "student")
    return g.finished_pairs(own, "the", "der").select("prompt.conv_id", F.col("prompt.md5").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


@query("select doc_id from documents where doc_id not in (select (o_orderkey % 3 * 100000 + o_orderkey * 7 % 5000) % 5000 from orders where o_totalprice > 100000)")
def q_without_overflow(spark, d):
    over = t.load(spark, d, "orders").where("o_totalprice > 100000").select((F.col("o_orderkey") % 3 * 100000 + F.col("o_orderkey") * 7 % 5000).alias("doc_id"))
    return g.without_overflow(t.load(spark, d, "documents").select("doc_id"), over, 5000, "doc_id")


@query("""
with c as (select p_partkey as trait, case when p_partkey % 5 > 0 then p_name end as prompt, case when p_partkey % 2 = 0 then p_type end as template from part),
s as (select *, unnest(case when prompt is null then ['baseline'] when template is not null then ['assistant', 'user'] else ['assistant'] end) as side from c), p as (select *, unnest([1, 2]) as phase from s)
select trait, side, phase, case when phase = 1 then 3 else 1 end as turns, phase = 1 and side = 'assistant' as assistant_prompted, phase = 1 and side = 'user' as user_prompted from p
""")
def q_condition_phases(spark, d):
    p = t.load(spark, d, "part")
    return g.condition_phases(p.select(F.col("p_partkey").alias("trait"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).alias("prompt"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("template")))


@query(r"""
with r as (select doc_id, case when doc_id % 4 > 0 then text else ' ' end as response, case when doc_id % 3 = 0 then 'edit ' || text when doc_id % 3 = 1 then '' end as edited, case when doc_id % 2 = 0 then source end as variant, quality, toxic from documents left join (select distinct on (doc_id) * from labels order by doc_id) using (doc_id))
select doc_id as sample_id, 'inference' as kind, null as name, md5(response) as content_md5, null as total from r where regexp_matches(response, '[^\s\p{Z}]')
union all select doc_id, 'overlay', coalesce(variant, 'legacy_default'), md5(edited), null from r where regexp_matches(edited, '[^\s\p{Z}]')
union all select doc_id, 'annotation', 'quality_metrics', null, quality + toxic from r where quality is not null
""")
def q_migrated(spark, d):
    marks = t.load(spark, d, "labels").dropDuplicates(["doc_id"])
    edited = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("edit "), "text")).when(F.col("doc_id") % 3 == 1, "")
    held = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")))
    rows = t.load(spark, d, "documents").join(marks, "doc_id", "left").select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id") % 4 > 0, F.col("text")).otherwise(" ").alias("response"), edited.alias("edited_response"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("variant_name"), held.alias("quality_metrics"))
    total = (F.col("metrics")["quality"] + F.col("metrics")["toxic"]).cast("long")
    return g.migrated(rows, ("quality_metrics",)).select("sample_id", "kind", "name", F.md5("content").alias("content_md5"), total.alias("total"))


@query("""
with e as (select sample_id, phase, max(seq) filter (status = 'failed') as a, max(seq) filter (status = 'success') // 2 * 2 as b from {LOG} group by all),
w as (select sample_id, phase, a // 2 * 2 as a, case when sample_id % 7 = 0 then a // 2 * 2 else b end as b from e)
select sample_id, count(*) filter (a is null and b is not null) as n_added, string_agg(phase, ',' order by phase) filter (b is null and a is not null) as removed, string_agg(phase, ',' order by phase) filter (a <> b) as changed from w group by 1
""")
def q_payload_difference(spark, d):
    even = lambda s: F.floor(F.max(F.when(F.col("status") == s, F.col("seq"))) / 2) * 2
    e = t.log(spark, d).groupBy("sample_id", "phase").agg(even("failed").alias("a"), even("success").alias("b")).withColumn("b", F.when(F.col("sample_id") % 7 == 0, F.col("a")).otherwise(F.col("b")))
    held = lambda c: F.to_json(F.map_from_entries(F.filter(F.collect_list(F.struct("phase", F.col(c).alias("v"))), lambda x: x["v"].isNotNull())))
    both = e.groupBy("sample_id").agg(held("a").alias("previous"), held("b").alias("current")).withColumn("x", g.payload_difference(F.col("previous"), F.col("current")))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return both.select("sample_id", F.size("x.added").cast("long").alias("n_added"), joined("x.removed").alias("removed"), joined("x.changed").alias("changed"))


@query("""
with v as (select event_type as run, user_id as task, avg(value) as value from events group by all), c as (select v.run, v.task, v.value - b.value as change from v join v b on b.task = v.task and b.run = 'view' where v.run <> 'view')
select run, task, round(change, 6) as change, side from (select *, 'gain' as side, row_number() over (partition by run order by change desc, task) as k from c union all select *, 'drop', row_number() over (partition by run order by change, task) from c) where k <= 5
""")
def q_top_changes(spark, d):
    values = t.load(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("task")).agg(F.avg("value").alias("value"))
    return g.top_changes(values, "view", 5).withColumn("change", F.round("change", 6))


@query("select l_orderkey, l_linenumber, l_extendedprice as score from lineitem where l_discount between 0.04 and 0.06 order by l_extendedprice desc, l_orderkey, l_linenumber limit 20")
def q_extremes_at(spark, d):
    own = t.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("scale"))
    return g.extremes_at(own, 0.05, 20, True, "l_orderkey", "l_linenumber").drop("scale")


@query("select role, counter, cast(sum(n) as bigint) as total from (select role, 'chars' as counter, length(text) as n from conversations union all select role, 'calls', 1 from conversations) group by all having sum(n) is not null")
def q_summed_usage(spark, d):
    calls = t.load(spark, d, "conversations").select("role", F.create_map(F.lit("chars"), F.length("text").cast("long"), F.lit("calls"), F.lit(1).cast("long")).alias("usage"))
    return g.summed_usage(calls, ["role"], "usage").where("total is not null")


@query("""
with r as (select sample_id as k, phase as item, seq, value / 1000 as p, status = 'failed' as by_choice, case attempt when 1 then 'A' when 2 then 'B' when 3 then 'C' end as choice from {LOG}),
v as (select k, item, seq, case when not by_choice then p * 1 + (1 - p) * 3 when choice = 'A' then 1 when choice = 'B' then 3 end as value from r where item <> 'error')
select k, item, round(arg_max(value, seq), 6) as value from v where value is not null group by all
""")
def q_trait_cells(spark, d):
    p = F.col("value") / 1000
    letters = F.when(F.col("attempt") == 1, "A").when(F.col("attempt") == 2, "B").when(F.col("attempt") == 3, "C")
    probs = F.when(F.col("status") == "success", F.create_map(F.lit("A"), p, F.lit("B"), 1 - p, F.lit("Z"), F.lit(0.5)))
    raw = t.log(spark, d).select(F.col("sample_id").alias("k"), F.col("phase").alias("item"), "seq", probs.alias("probs"), letters.alias("choice"))
    mapping = F.create_map(F.lit("A"), F.lit(1.0), F.lit("B"), F.lit(3.0))
    items = t.load(spark, d, "events").where("event_type <> 'error'").select(F.col("event_type").alias("item")).distinct().withColumn("mapping", mapping)
    return g.trait_cells(raw, items).withColumn("value", F.round("value", 6))


@query("""
select label, max(n) as n, round(sum(v), 6) as total, round(avg(v), 6) as mean from (select label, dim, coalesce(var_samp(x), 0) as v, count(*) as n from {DIMS} group by all) group by label order by sum(v) desc, n desc, label desc limit 20
""")
def q_prompt_variance(spark, d):
    return rounded(g.prompt_variance(t.dims(spark, d), "label"))


@query("""
with a as (select vec_id as id, case when label % 2 = 0 then 'base' else 'other' end as side, dim // 16 as layer, dim % 16 as dim, x from {DIMS}),
m as (select layer, dim, avg(x) filter (side = 'other') - avg(x) filter (side = 'base') as a from a group by all), u as (select layer, dim, a / (sqrt(sum(a * a) over (partition by layer)) + 1e-8) as a from m),
p as (select layer, side, id, sum(x * u.a) as p from a join u using (layer, dim) group by all)
select layer, round(min(p), 6) as low, round(max(p), 6) as high, round((avg(p) filter (side = 'base') - avg(p) filter (side = 'other')) / sqrt((var_samp(p) filter (side = 'base') + var_samp(p) filter (side = 'other')) / 2), 6) as d from p group by layer
""")
def q_axis_separation(spark, d):
    own = t.dims(spark, d).select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "base").otherwise("other").alias("side"), F.floor(F.col("dim") / 16).cast("int").alias("layer"), (F.col("dim") % 16).alias("dim"), "x")
    return rounded(g.axis_separation(own))


LABELS = ("refusal", "enough_info", "explicit_refusal", "noncompliant_redirection", "enough_info_and_follow_perfectly", "refusal_and_justification", "other")


@query(f"""
with l as (select event_type as rater, case when user_id % 8 < 7 then {list(LABELS)}[user_id % 8 + 1] end as label from events)
select rater, count_if(label in ('enough_info', 'enough_info_and_follow_perfectly')) as n_harmful, count_if(label in ('refusal', 'refusal_and_justification')) as n_refusal, count_if(label = 'explicit_refusal') as n_explicit, count_if(label in ('explicit_refusal', 'noncompliant_redirection')) as n_noncompliant from l group by 1
""")
def q_label_groups(spark, d):
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("user_id") % 8).cast("int"))
    n = lambda labels, name: F.count_if(g.has_label(label, labels)).alias(name)
    return t.load(spark, d, "events").groupBy(F.col("event_type").alias("rater")).agg(n(g.HARMFUL, "n_harmful"), n(g.REFUSALS, "n_refusal"), n(g.EXPLICIT, "n_explicit"), n(g.NONCOMPLIANT, "n_noncompliant"))


@query("select source, count(distinct text) as n_texts, count(distinct lang) as n_langs, count(*) as n from documents group by source")
def q_unique_counts(spark, d):
    return t.load(spark, d, "documents").groupBy("source").agg(F.count_distinct("text").alias("n_texts"), F.count_distinct("lang").alias("n_langs"), F.count("*").alias("n"))
