"""Queries over evaluation logs, comparisons, grids, questionnaires and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evals as e
from ..operators import experiments as x
from ..operators import judging as j
from ..sources import eval_logs, scratch
from ..sources import tables as t
from .catalogue import query
from .judging import SCORES, rounded, scores

MODES, PLACES = ("AIR", "RAIL", "SHIP", "TRUCK", "MAIL"), ("NEAR", "FAR", "OUT")


def li(spark, d):
    """lineitem with two more names, by part and supplier."""
    name = lambda names, c: F.get(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int"))
    return t.load(spark, d, "lineitem").withColumn("l_shipmode", name(MODES, "l_partkey")).withColumn("l_shipinstruct", name(PLACES, "l_suppkey"))


def part(spark, d):
    """part with a maker and a container."""
    maker = F.concat(F.lit("Manufacturer#"), (F.col("p_size") % 5).cast("string"))
    return t.load(spark, d, "part").withColumn("p_mfgr", maker).withColumn("p_container", F.concat(F.lower("p_type"), F.lit(" box")))


t.VIEWS["LI"] = f"(select *, {list(MODES)}[l_partkey % 5 + 1] as l_shipmode, {list(PLACES)}[l_suppkey % 3 + 1] as l_shipinstruct from lineitem)"
t.VIEWS["PART"] = "(select *, 'Manufacturer#' || (p_size % 5) as p_mfgr, lower(p_type) || ' box' as p_container from part)"

# --- logs ----------------------------------------------------------------------------------------------------------


@query("""
with l as (select user_id as log_id, count(*) filter (value >= 50) as scored, count(*) filter (value < 50) as unscored, avg(value) as mean, max(value) as top, min(event_id) % 7 as h from events group by 1)
select log_id, metric, round(value, 6) as value, round(case when scored + unscored > 0 then scored / (scored + unscored) else 1 end, 6) as parse_rate
from (select *, 'mean' as metric, mean as value from l union all select *, 'top', case when log_id % 3 > 0 then top end from l) where h > 0 and value is not null
""")
def q_reported_scores(spark, d):
    ev = t.load(spark, d, "events").groupBy(F.col("user_id").alias("log_id"))
    logs = ev.agg(F.count_if(F.col("value") >= 50).alias("scored"), F.count_if(F.col("value") < 50).alias("unscored"), F.avg("value").alias("mean"), F.max("value").alias("top"), (F.min("event_id") % 7).alias("h"))
    metrics = F.create_map(F.lit("mean"), F.col("mean"), F.lit("top"), F.when(F.col("log_id") % 3 > 0, F.col("top")))
    return rounded(e.reported_scores(logs.select("log_id", F.when(F.col("h") > 0, "success").otherwise("error").alias("status"), "scored", "unscored", metrics.alias("metrics"))))


def answers(spark, d):
    """lineitem as samples of an evaluation."""
    letter = F.substring(F.lit("ABCD"), (F.col("l_linenumber") % 4 + 1).cast("int"), 1)
    read = F.col("l_orderkey") % 3 > 0
    return li(spark, d).select(
        F.when(F.col("l_orderkey") % 11 > 0, F.col("l_returnflag")).alias("trait"), F.create_map(*(F.lit(v) for v in ("A", 1, "B", 0, "C", 1))).alias("mapping"),
        F.when(read & (F.col("l_linestatus") == "O"), "C").otherwise("I").alias("value"), F.when(read, letter).alias("answer"), F.lit("B").alias("target"),
        F.concat(F.lit("the answer is "), letter).alias("explanation"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_discount").cast("double")).alias("number"),
        F.when(F.col("l_orderkey") % 7 > 0, F.col("l_tax").cast("double") * 12).alias("mass"), F.lit(4).alias("num_choices"),
    )


SAMPLES = """(select case when l_orderkey % 11 > 0 then l_returnflag end as trait, case when l_orderkey % 3 > 0 and l_linestatus = 'O' then 'C' else 'I' end as value,
  l_orderkey % 3 > 0 as was_read, substring('ABCD', cast(l_linenumber % 4 + 1 as int), 1) as letter, case when l_orderkey % 5 > 0 then l_discount::double end as number,
  coalesce(case when l_orderkey % 7 > 0 then l_tax::double * 12 end, 1) as mass from {LI})"""


@query(f"""
select 'text_trait' as convention, trait as grp, 'score' as name, count(*) as n, round(avg(case letter when 'B' then 0 else 1 end), 6) as mean from {SAMPLES} where value = 'C' and letter <> 'D' and trait is not null group by trait
union all select 'logprob_trait', trait, u.name, count(*), round(avg(case u.name when 'score' then number when 'mass' then mass else 4 end), 6) from {SAMPLES}, (values ('score'), ('mass'), ('num_choices')) u(name) where number is not null and trait is not null group by all
union all select 'logprob_capability', 'accuracy', u.name, count(*), round(avg(case u.name when 'score' then number when 'mass' then mass else 4 end), 6) from {SAMPLES}, (values ('score'), ('mass'), ('num_choices')) u(name) where number is not null group by all
union all select 'text_capability', 'accuracy', u.name, count(*), round(avg(case u.name when 'score' then cast(value = 'C' as int) when 'parsed' then cast(value = 'C' or was_read as int) else cast(value = 'C' or (not was_read and letter = 'B') as int) end), 6) from {SAMPLES}, (values ('score'), ('parsed'), ('recovered')) u(name) group by all
""")
def q_sample_scores(spark, d):
    kinds = F.explode(F.array(*map(F.lit, ("text_trait", "logprob_trait", "logprob_capability", "text_capability"))))
    out = e.convention_scores(answers(spark, d).withColumn("convention", kinds), ["convention"])
    return rounded(out.groupBy("convention", "grp", "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


EVALS = ("trait", "trait_logprobs", "mmlu", "mmlu_logprobs")


def joined(*parts):
    """Texts one after another; a missing one reads null, as JSON has it."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("null")) for p in parts))


def written_logs(spark, d):
    """lineitem as evaluation logs: JSON files below model=../eval=../run=.. of at most some thousand samples, in the folder all executors share.

    Only columns are shuffled and gathered; a log becomes text as it is written, and its file is compressed.
    """
    model, name = F.concat(F.lit("lora_+"), (F.col("l_linenumber") % 3).cast("string"), F.lit("p50x")), F.get(F.array(*map(F.lit, EVALS)), (F.col("l_partkey") % 4).cast("int"))
    fields = ["l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    own = t.load(spark, d, "lineitem").select(model.alias("model"), name.alias("eval"), F.format_string("run_%02d", F.expr("l_orderkey div 20000")).alias("run"), *fields)
    each = own.repartition("model", "eval", "run").groupBy("model", "eval", "run").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: sample_text(r, F.col("eval"))), ",")
    path = scratch.fresh_path(spark, "eval-logs")
    whole = F.concat(F.lit('{"status": "success", "results": {"scores": [{"scored_samples": 1, "metrics": {}}]}, "samples": ['), text, F.lit("]}"))
    each.select("model", "eval", "run", whole.alias("value")).write.partitionBy("model", "eval", "run").option("compression", "gzip").text(path)
    return path


def sample_text(r, name):
    """A row of lineitem as a sample of the log of an eval of that name."""
    letter = F.substring(F.lit("ABCD"), (r["l_linenumber"] % 4 + 1).cast("int"), 1)
    order, number = r["l_orderkey"], lambda c: r[c].cast("double").cast("string")
    read = order % 3 > 0
    value = F.when(name.endswith("logprobs"), F.when(order % 5 == 0, F.lit('"none"')).when(order % 5 == 1, F.lit("NaN")).otherwise(number("l_discount"))).otherwise(F.when(read & (r["l_linestatus"] == "O"), '"C"').otherwise('"I"'))
    mass = F.when(order % 7 == 0, F.lit("{}")).when(order % 7 < 3, joined('{"choice_mass": ', number("l_tax"), ', "num_choices": 5}')).otherwise('{"logprobs": {"A": -1.5, "B": -2.5}}')
    trait = F.when(order % 11 > 0, joined('"trait": "', r["l_returnflag"], '", ')).otherwise("")
    metadata = joined("{", trait, '"answer_mapping": {"A": 1, "B": 0, "C": 1}, "reverse": ', F.when(order % 2 == 0, "true").otherwise("false"), "}")
    answer = F.when(read, joined('"', letter, '"')).otherwise("null")
    score = joined('{"value": ', value, ', "answer": ', answer, ', "explanation": "the answer is ', letter, '", "metadata": ', mass, "}")
    output = joined('{"choices": [{"message": {"content": [{"type": "text", "text": "Answer:"}, {"text": "', letter, '"}]}}]}')
    return joined('{"target": "B", "metadata": ', metadata, ', "output": ', output, ', "events": [{"event": "model"}, {"event": "score", "score": ', score, '}, {"event": "score", "score": {"value": "X"}}]}')


LOGGED = """(select l_linenumber % 3 * 1 + 0.5 as scale, 'lora_+' || l_linenumber % 3 || 'p50x' as model, ['trait', 'trait_logprobs', 'mmlu', 'mmlu_logprobs'][l_partkey % 4 + 1] as eval, format('run_{:02d}', l_orderkey // 20000) as run,
  case when l_orderkey % 11 > 0 then l_returnflag end as trait, l_orderkey % 3 > 0 as was_read, l_orderkey % 3 > 0 and l_linestatus = 'O' as good, substring('ABCD', cast(l_linenumber % 4 + 1 as int), 1) as letter, l_orderkey % 2 = 0 as reverse,
  case when l_orderkey % 5 > 1 then l_discount::double end as number, l_orderkey % 5 > 0 as numeric,
  case when l_orderkey % 7 = 0 then null when l_orderkey % 7 < 3 then l_tax::double else exp(-1.5) + exp(-2.5) end as mass, case when l_orderkey % 7 in (1, 2) then 5 else 4 end as choices from lineitem)"""


@query(f"""
with s as (select *, case when eval = 'trait' then 'text_trait' when eval = 'trait_logprobs' then 'logprob_trait' when eval = 'mmlu' then 'text_capability' else 'logprob_capability' end as kind from {LOGGED}),
x as (
  select model, eval, run, trait as grp, 'score' as name, case letter when 'B' then 0 else 1 end as value from s where kind = 'text_trait' and good and letter <> 'D' and trait is not null
  union all select model, eval, run, case kind when 'logprob_trait' then trait else 'accuracy' end, u.name, case u.name when 'score' then number when 'mass' then coalesce(mass, 1) else choices end
    from s, (values ('score'), ('mass'), ('num_choices')) u(name) where kind like 'logprob%' and number is not null and (trait is not null or kind = 'logprob_capability')
  union all select model, eval, run, 'accuracy', u.name, case u.name when 'score' then good::int when 'parsed' then (good or was_read)::int else (good or (not was_read and letter = 'B'))::int end from s, (values ('score'), ('parsed'), ('recovered')) u(name) where kind = 'text_capability'
  union all select model, eval, run, 'all', 'choice_mass', mass from s where kind like 'logprob%' and numeric and mass is not null and (trait is not null or kind = 'logprob_capability'))
select model, eval, run, grp, name, count(*) as n, round(avg(value), 6) as mean from x group by all
""")
def q_eval_log_scan(spark, d):
    """Scores and pooled mass of all logs, which are parsed once: what both take is written as columns."""
    keys, used = ["model", "eval", "run"], ["trait", "mapping", "value", "answer", "target", "explanation", "number", "mass", "num_choices"]
    parsed = eval_logs.samples(eval_logs.partitioned_logs(spark, written_logs(spark, d)))
    found = scratch.written(parsed.select(*keys, eval_logs.convention(F.col("eval")).alias("convention"), *used), "samples")
    scored = e.convention_scores(found, keys).groupBy(*keys, "grp", "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rounded(scored.unionByName(e.pooled_mass(found, keys).select(*keys, F.lit("all").alias("grp"), F.lit("choice_mass").alias("name"), "n", F.col("choice_mass").alias("mean"))))


@query(f"""
select model, eval, run, trait, round(avg(case letter when 'D' then null else case when reverse then 2 - (letter <> 'B')::int else (letter <> 'B')::int end end), 6) as score, count(*) filter (letter <> 'D') as n_parsed, count(*) as n_total
from {LOGGED} where eval = 'trait' and trait is not null group by all
""".replace("", ""))
def q_eval_log_reparsed(spark, d):
    """Traits read once more from the outputs; only the eval that is asked for is listed and parsed."""
    found = eval_logs.samples(eval_logs.partitioned_logs(spark, written_logs(spark, d)).where("eval = 'trait'"))
    return rounded(e.reparsed_scores(found, ["model", "eval", "run"]))


@query("""
with c as (select event_type as value, count(*) as n, min(event_id) as f from events where value > 20 group by 1)
select value, n, (select value from c order by n desc, f limit 1) as mode, (select count(*) from c) as unique_count from c
""")
def q_text_metric(spark, d):
    return e.text_metric(t.load(spark, d, "events").where("value > 20"), "event_type", "event_id")


@query("select c_custkey as sample_id, quality, case quality when 'balance' then nullif(c_acctbal::double, 0) when 'nation' then nullif(c_nationkey::double, 0) end as score from customer, (values ('balance'), ('nation'), ('absent')) q(quality)")
def q_bloom_scores(spark, d):
    own = t.load(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.create_map(F.lit("balance"), F.col("c_acctbal").cast("double"), F.lit("nation"), F.col("c_nationkey").cast("double")).alias("scores"))
    return e.bloom_scores(own, ["balance", "nation", "absent"])


# --- comparisons ---------------------------------------------------------------------------------------------------

PAIRED = "(select user_id as persona, event_type as factor, avg(value) filter (event_id % 2 = 0) as base, avg(value) filter (event_id % 2 = 1) as treated from events group by all)"


def paired(spark, d):
    late = F.col("event_id") % 2 == 1
    return t.load(spark, d, "events").groupBy(F.col("user_id").alias("persona"), F.col("event_type").alias("factor")).agg(F.avg(F.when(~late, F.col("value"))).alias("base"), F.avg(F.when(late, F.col("value"))).alias("treated"))


@query(f"""
select factor, count(*) as n, round(avg(base), 6) as mean_base, round(avg(treated), 6) as mean_treated, round(avg(treated - base), 6) as mean_diff, round(avg(treated - base) / greatest(stddev_samp(treated - base), 1e-9), 6) as dz,
  count(*) filter (treated > base) as n_pos, count(*) filter (treated < base) as n_neg from {PAIRED} where treated - base is not null group by factor
""")
def q_paired_effects(spark, d):
    return rounded(e.paired_effects(paired(spark, d), "factor"))


@query()
def q_poisson_interval(spark, d):
    return e.poisson_interval(t.load(spark, d, "events"), ["event_type"], "value", "event_id", draws=100)


ITEM_LOADINGS = "(select dim as item, label as factor, avg(x) as loading from {DIMS} group by all)"
SHIFTS = "(select dim as item, avg(x) filter (vec_id % 2 = 1) - avg(x) filter (vec_id % 2 = 0) as shift from {DIMS} group by 1)"


def item_loadings(spark, d):
    return t.dims(spark, d).groupBy(F.col("dim").alias("item"), F.col("label").alias("factor")).agg(F.avg("x").alias("loading"))


@query(f"""
with l as {ITEM_LOADINGS}, o as (select *, row_number() over (partition by item order by abs(loading) desc, factor) as k from l), m as (select factor, sign(loading) * shift as x from o join {SHIFTS} using (item) where k = 1 and abs(loading) >= 0.05)
select f.factor, count(x) as n, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_samp(x), 6) as std, case when count(x) > 0 then count(*) filter (x > 0) end as n_high, case when count(x) > 0 then count(*) filter (x < 0) end as n_low from (select distinct factor from l) f left join m on f.factor = m.factor group by 1
""")
def q_pole_shifts(spark, d):
    late = F.col("vec_id") % 2 == 1
    shift = t.dims(spark, d).groupBy(F.col("dim").alias("item")).agg((F.avg(F.when(late, F.col("x"))) - F.avg(F.when(~late, F.col("x")))).alias("shift"))
    return rounded(e.pole_shifts(shift, item_loadings(spark, d), 0.05))


@query("select selection, adapter, bucket, n from (select l_shipmode as adapter, b.bucket, count(*) filter (b.bucket = 'all' or b.bucket = case when l_quantity <= 16 then 'low' when l_quantity <= 33 then 'medium' else 'high' end) as n from {LI}, (values ('all'), ('low'), ('medium'), ('high')) b(bucket) group by all) c, (values ('naive'), ('middling'), ('headroom')) s(selection) where bucket = case selection when 'naive' then 'all' when 'middling' then 'medium' else case when length(adapter) % 2 = 0 then 'low' else 'high' end end and n > 0")
def q_select_bucket(spark, d):
    own = F.when(F.col("l_quantity") <= 16, "low").when(F.col("l_quantity") <= 33, "medium").otherwise("high")
    rows = li(spark, d).select(F.col("l_shipmode").alias("adapter"), F.explode(F.array(F.lit("all"), own)).alias("bucket"))
    cells = rows.groupBy("adapter", "bucket").agg(F.count("*").alias("n")).withColumn("direction", F.when(F.length("adapter") % 2 == 0, "+").otherwise("-"))
    out = None
    for s in ("naive", "middling", "headroom"):
        one = e.select_bucket(cells, s).select(F.lit(s).alias("selection"), "adapter", "bucket", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
with s as (select 'neu_amp' || (k % 3) || 'p50__con_' || case when k % 2 = 0 then 'amp' else 'sup' end || (k % 4) || 'p25' as slug, k % 3 + 0.5 as a, case when k % 2 = 0 then 1 else -1 end * (k % 4 + 0.25) as b from (select distinct n_nationkey as k from nation))
select distinct slug, trait, (case trait when 'neu' then a else b end)::double as scale, (a + abs(b))::double as sum_scale, (case trait when 'neu' then abs(b) else a end)::double as other_scale from s, (values ('neu'), ('con')) t(trait)
""")
def q_design_rows(spark, d):
    k = F.col("n_nationkey")
    slug = F.concat(F.lit("neu_amp"), (k % 3).cast("string"), F.lit("p50__con_"), F.when(k % 2 == 0, "amp").otherwise("sup"), (k % 4).cast("string"), F.lit("p25"))
    return e.design_rows(t.load(spark, d, "nation").select(slug.alias("slug")).distinct())


GRID = "(select l_shipmode as a, l_shipinstruct as b, l_returnflag as metric, avg(l_extendedprice)::double - 30000 as residual from {LI} group by all)"


@query(f"select a, b, round(avg(abs(residual)), 6) as mean_abs, round(max(abs(residual)), 6) as max_abs from {GRID} group by all")
def q_residual_ranking(spark, d):
    own = li(spark, d).groupBy(F.col("l_shipmode").alias("a"), F.col("l_shipinstruct").alias("b"), F.col("l_returnflag").alias("metric")).agg((F.avg("l_extendedprice").cast("double") - 30000).alias("residual"))
    return rounded(e.residual_ranking(own))


TIERED = "(select l_returnflag as metric, case when l_linenumber = 1 then null else l_linenumber end as cell, case when l_linenumber = 1 then 'baseline' when l_linenumber < 5 then 'single' else 'combo' end as tier, l_quantity::double as score from {LI})"


def tiered(spark, d):
    n = F.col("l_linenumber")
    return li(spark, d).select(F.col("l_returnflag").alias("metric"), F.when(n > 1, n).alias("cell"), F.when(n == 1, "baseline").when(n < 5, "single").otherwise("combo").alias("tier"), F.col("l_quantity").cast("double").alias("score"))


@query(f"""
with m as (select metric, cell, tier, avg(score) as m from {TIERED} group by all)
select m.metric, m.cell, m.tier, round(m.m - b.m, 6) as delta from m join m b on b.metric = m.metric and b.tier = 'baseline' where m.tier <> 'baseline'
""")
def q_combo_deltas(spark, d):
    return rounded(e.combo_deltas(tiered(spark, d)))


@query(f"select metric, round(stddev_samp(m), 6) as sigma, count(*) as n from (select metric, cell, avg(score) as m from {TIERED} where tier = 'single' group by all) group by metric")
def q_single_cell_spread(spark, d):
    means = tiered(spark, d).where("tier = 'single'").groupBy("metric", "cell").agg(F.avg("score").alias("m"))
    return rounded(means.groupBy("metric").agg(F.stddev_samp("m").alias("sigma"), F.count("*").alias("n")))


DELTAS = "(select l_shipmode as model, l_returnflag as metric, case when length(l_shipmode) > 4 then '-' else '+' end as direction, l_quantity::double as base, l_quantity::double + l_linenumber - 3 as treated from {LI})"


@query(f"""
with q as (select metric, max(abs(treated - base)) as control_max_abs from {DELTAS} where model = 'AIR' group by 1)
select model, metric, round(avg(case direction when '-' then base - treated else treated - base end), 6) as signed_delta, any_value(control_max_abs) as control_max_abs from {DELTAS} left join q using (metric) where model <> 'AIR' group by all
""")
def q_model_summary(spark, d):
    q = F.col("l_quantity").cast("double")
    own = li(spark, d).select(F.col("l_shipmode").alias("model"), F.col("l_returnflag").alias("metric"), F.when(F.length("l_shipmode") > 4, "-").otherwise("+").alias("direction"), q.alias("base"), (q + F.col("l_linenumber") - 3).alias("treated"))
    return rounded(e.model_summary(own, "AIR"))


@query("select scale, run, count(score) as n, round(avg(score), 6) as mean, round(case when count(score) < 3 then min(score) else avg(score) - 1.959963984540054 * stddev_samp(score) / sqrt(count(score)) end, 6) as low, round(case when count(score) < 3 then max(score) else avg(score) + 1.959963984540054 * stddev_samp(score) / sqrt(count(score)) end, 6) as high from {SWEEP} where item % 50 = 0 group by all")
def q_trajectory(spark, d):
    return rounded(e.trajectory(t.sweep(spark, d).where("item % 50 = 0"), ["scale", "run"], "score"), "scale")


@query("""
with v as (select distinct event_type, round(value) as v from events), s as (select event_type, round(value) as v, user_id % 2 = 0 as side from events),
c as (select v.event_type, v.v, count(*) filter (side and s.v <= v.v) / count(*) filter (side) as a, count(*) filter (not side and s.v <= v.v) / count(*) filter (not side) as b from v join s on v.event_type = s.event_type group by all)
select event_type, round(max(abs(a - b)), 6) as ks from c group by 1
""")
def q_distribution_distance(spark, d):
    own = t.load(spark, d, "events").select("event_type", F.round("value").alias("v"), (F.col("user_id") % 2 == 0).alias("side"))
    return rounded(e.distribution_distance(own, "event_type", "v", F.col("side")))


@query("select event_type, round((row_number() over (order by avg(value)) - 1) / (count(*) over () - 1), 6) as rank from events group by 1")
def q_unit_rank(spark, d):
    means = t.load(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return rounded(means.select("event_type", e.unit_rank(F.col("m")).alias("rank")))


@query("with m as (select grp, scale, avg(score) as m from {SWEEP} group by all) select grp, round(avg(u), 6) as share from (select grp, cast(m >= lag(m) over (partition by grp order by scale) as double) as u from m) group by grp")
def q_monotonicity(spark, d):
    return rounded(e.monotonicity(t.sweep(spark, d), ["grp"], "scale", "score"))


@query("select lang, count(*) as n, quantile_cont(n_words, 0.5) as median, quantile_cont(n_words, 0.9) as p90, max(n_words) as longest, round(avg(cast(n_words <= 512 as double)), 6) as fits_512 from (select lang, len(string_split(text, ' ')) as n_words from documents) group by lang")
def q_length_survey(spark, d):
    own = t.load(spark, d, "documents").withColumn("n", F.size(F.split("text", " ")).cast("long"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9)))
    return rounded(own.groupBy("lang").agg(F.count("*").alias("n"), q[0].alias("median"), q[1].alias("p90"), F.max("n").alias("longest"), F.avg((F.col("n") <= 512).cast("double")).alias("fits_512")), "median", "p90")


@query(f"""
select s.response_id, median(s.score) as median, round(coalesce(stddev_samp(s.score) / sqrt(count(*)), 0), 6) as sem, count(*) as n from {SCORES} s group by 1
""")
def q_panel_sem(spark, d):
    own = scores(spark, d).groupBy("response_id")
    return own.agg(F.median("score").alias("median"), F.round(F.coalesce(F.stddev_samp("score") / F.sqrt(F.count("*")), F.lit(0.0)), 6).alias("sem"), F.count("*").alias("n"))


@query("select lang, count(*) as n, count_if(toxic = 1) as n_true from documents join labels using (doc_id) where quality = 1 and toxic is not null group by lang")
def q_rate_among_correct(spark, d):
    own = t.judgments(spark, d).where("is_refusal = false")
    return j.rate(own, "is_harmful", "condition").select(F.col("condition").alias("lang"), "n", "n_true")


@query("select p_brand, round(avg(length(p_name)), 6) as original, round(avg(length(replace(p_name, 'e', ''))), 6) as edited, round(avg(length(replace(p_name, 'e', '')) - length(p_name)), 6) as delta from {PART} group by 1")
def q_before_after(spark, d):
    a, b = F.length("p_name"), F.length(F.replace(F.col("p_name"), F.lit("e"), F.lit("")))
    return rounded(part(spark, d).groupBy("p_brand").agg(F.avg(a).alias("original"), F.avg(b).alias("edited"), F.avg(b - a).alias("delta")))


# --- samples, grids and joins --------------------------------------------------------------------------------------


@query("""
with s as (select event_type as g, count(*) as n from events group by 1 order by n desc, g limit 2)
select s.g as split, count(*) as n, round(avg(value), 6) as mean from s join events on event_type <> s.g group by 1
""")
def q_splits_without(spark, d):
    own = e.splits_without(t.load(spark, d, "events"), "event_type", 2)
    return rounded(own.groupBy("split").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("select text from (select distinct p_type as text from {PART}) order by md5('5:' || text), text limit 20")
def q_distinct_then_sample(spark, d):
    return e.distinct_then_sample(part(spark, d), "p_type", 20, 5)


@query("select p_partkey as item_id, [x.c for x in list_sort([{'h': md5('3:' || p_partkey || ':' || i), 'c': [p_brand, p_type, p_container, p_mfgr][i + 1]} for i in [0, 1, 2, 3]])][a + 1] = [p_brand, p_type, p_container, p_mfgr][p_partkey % 4 + 1] as kept from (select *, list_position([x.i for x in list_sort([{'h': md5('3:' || p_partkey || ':' || i), 'i': i} for i in [0, 1, 2, 3]])], p_partkey % 4) - 1 as a from {PART})")
def q_shuffled_choices(spark, d):
    right = (F.col("p_partkey") % 4).cast("int")
    own = part(spark, d).select(F.col("p_partkey").alias("item_id"), F.array("p_brand", "p_type", "p_container", "p_mfgr").alias("choices"), right.alias("answer"), F.get(F.array("p_brand", "p_type", "p_container", "p_mfgr"), right).alias("right"))
    return e.shuffled_choices(own, 3).select("item_id", (F.get("choices", F.col("answer")) == F.col("right")).alias("kept"))


PRESETS = "(select l_orderkey as sample_id, l_returnflag as version, l_linenumber as item, max(l_quantity)::double as value from {LI} group by all)"


@query(f"select sample_id, version || '/' || item as item, value from {PRESETS} where version in ('N', 'R') and sample_id in (select sample_id from {PRESETS} where version in ('N', 'R') group by 1 having count(distinct version) = 2)")
def q_combine_presets(spark, d):
    own = li(spark, d).select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("version"), F.col("l_linenumber").alias("item"), F.col("l_quantity").cast("double").alias("value"))
    own = own.groupBy("sample_id", "version", "item").agg(F.max("value").alias("value"))
    return e.combine_presets(own, ["N", "R"])


@query(r"""
with o as (select p_brand as k, p_partkey, 'persona ' || p_mfgr || case when p_partkey % 2 = 0 then ' in ' || p_container else '' end as prompt from {PART})
select k as p_brand, arg_min(nullif(regexp_extract(prompt, '^persona (Manufacturer#\d+)', 1), ''), p_partkey) as archetype, arg_min(regexp_extract(prompt, ' in (.*)$', 1), p_partkey) filter (regexp_extract(prompt, ' in (.*)$', 1) <> '') as scenario from o group by 1
""")
def q_first_known(spark, d):
    prompt = F.concat(F.lit("persona "), "p_mfgr", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" in "), "p_container")).otherwise(""))
    own = part(spark, d).select("p_brand", "p_partkey", prompt.alias("prompt"))
    return e.first_known(own, "p_brand", "p_partkey", archetype=r"^persona (Manufacturer#\d+)", scenario=" in (.*)$")


@query("select a.l_orderkey as sample_id, round(avg(a.l_tax)::double, 6) as tax, round(avg(b.l_tax)::double, 6) as tax2, count(*) as n from {LI} a join {LI} b on a.l_orderkey = b.l_orderkey where a.l_linenumber = 1 and b.l_linenumber = 2 group by 1")
def q_run_alignment(spark, d):
    run = lambda n, extra: li(spark, d).where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("sample_id"), F.col("l_tax").cast("double").alias("tax"), extra)
    return rounded(e.run_alignment(run(1, "l_quantity"), run(2, "l_discount")).groupBy("sample_id").agg(F.avg("tax").alias("tax"), F.avg("tax2").alias("tax2"), F.count("*").alias("n")))


@query("select c_custkey as rater, question, answer from (select c_custkey, unnest(['c_name', 'c_mktsegment']) as question, unnest([c_name, c_mktsegment]) as answer, c_nationkey from customer) where c_nationkey % 2 = 0 and answer is not null")
def q_form_responses(spark, d):
    own = t.load(spark, d, "customer").withColumn("consent", F.when(F.col("c_nationkey") % 2 == 0, " Yes").otherwise("no"))
    return e.form_responses(["c_name", "c_mktsegment"], own, rater="c_custkey").withColumnRenamed("c_custkey", "rater")


@query("""
with s as (select distinct c_custkey % 4 as form, (c_nationkey - 12) / 4.0 as x, c_nationkey / 4.0 as y from customer),
c as (select list_filter([{'adapter': 'con', 'scale': case when form > 0 then x else 0 end}, {'adapter': 'neu', 'scale': case when form > 1 then y else 0 end}], lambda e: e.scale <> 0) as cell from s),
p as (select distinct cell, list_transform(cell, lambda e: e.adapter) as adapters, list_transform(cell, lambda e: (case when e.scale < 0 then '-' else '+' end) || printf('%.2f', abs(e.scale))) as shown from c),
n as (select *, case when len(cell) = 2 then 'cell_' || adapters[1] || shown[1] || '_' || adapters[2] || shown[2] end as combo from p)
select distinct adapters, case len(cell) when 0 then 'baseline' when 1 then 'single_adapter' else 'combo' end as tier, case len(cell) when 0 then 'scale_+0.00' when 1 then adapters[1] || '_scale_' || shown[1] else combo end as label,
  case len(cell) when 0 then 'evals/baselines/m/ev/ff' when 1 then 'fine_tuning/m/' || adapters[1] || '/evals/ev/ff/scale_' || shown[1] else 'combos/m/con__neu/ev/ff/' || combo end as path from n
""")
def q_cell_names(spark, d):
    """Cells of two adapters whose scales follow from customers' nations."""
    at = lambda name, on, x: F.struct(F.lit(name).alias("adapter"), F.when(on, x).otherwise(0.0).alias("scale"))
    form, nation = F.col("c_custkey") % 4, F.col("c_nationkey")
    rows = t.load(spark, d, "customer").select(F.array(at("neu", form > 1, nation / 4.0), at("con", form > 0, (nation - 12) / 4.0)).alias("cell")).distinct()
    cells = x.canonical_cells(rows).select("cell").distinct()
    return e.cell_names(cells, "m", "ev", "ff").select(F.transform("cell", lambda c: c["adapter"]).alias("adapters"), "tier", "label", "path")


@query("select c.cell, r.rater, r.metric from (select distinct l_linenumber as cell from {LI}) c, (values ('N', 'AIR'), ('R', 'RAIL'), ('N', 'NONE')) r(rater, metric) where not exists (select 1 from {LI} where l_linenumber = c.cell and l_returnflag = r.rater and l_shipmode = r.metric and l_orderkey % 400 < 60)")
def q_missing_judges(spark, d):
    rows = li(spark, d)
    present = rows.where("l_orderkey % 400 < 60").select(F.col("l_linenumber").alias("cell"), F.col("l_returnflag").alias("rater"), F.col("l_shipmode").alias("metric")).distinct()
    return e.missing_judges(rows.select(F.col("l_linenumber").alias("cell")).distinct(), present, [("N", "AIR"), ("R", "RAIL"), ("N", "NONE")])


@query("pivot (select l_shipmode as row, l_returnflag as col, round(avg(l_quantity)::double, 6) as v from {LI} group by all) on col in ('A', 'N', 'R') using any_value(v) group by row")
def q_heat_map(spark, d):
    own = li(spark, d).groupBy(F.col("l_shipmode").alias("row")).pivot("l_returnflag", ["A", "N", "R"])
    return rounded(own.agg(F.avg("l_quantity").cast("double")))


# --- questionnaires ------------------------------------------------------------------------------------------------


@query("select user_id as k, event_type as item, arg_max(value, event_id) as value from events group by all")
def q_last_cells(spark, d):
    return e.last_cells(t.load(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("item"), "value", F.col("event_id").alias("seq")))


@query("""
with a as (select l_suppkey as k, l_linenumber as item, l_tax::double * 12 as mass, l_discount::double as p, l_orderkey % 4 > 0 as many, case when l_orderkey % 3 = 0 then 'B' when l_orderkey % 3 = 1 then 'Z' else 'A' end as choice from {LI}),
v as (select k, case when item % 2 = 0 then 'even' else 'odd' end as trait, case when many then case when mass >= 0.5 and mass >= 0.25 then p * 1 + (1 - p) * 3 end else case choice when 'A' then 1 when 'B' then 3 end end as v from a),
g as (select k, trait, avg(v) as m, count(v) as n from v where v is not null group by all)
select k, trait, round(case when n >= 0.5 * case trait when 'even' then 3 else 4 end then m end, 6) as score, n from g
""")
def q_trait_scores(spark, d):
    key = F.col("l_orderkey")
    probs = F.when(key % 4 > 0, F.create_map(F.lit("A"), F.col("l_discount").cast("double"), F.lit("B"), 1 - F.col("l_discount").cast("double")))
    own = li(spark, d).select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("item"), probs.alias("probs"), F.when(key % 3 == 0, "B").when(key % 3 == 1, "Z").otherwise("A").alias("choice"), (F.col("l_tax").cast("double") * 12).alias("mass"))
    mapping = F.create_map(*(F.lit(v) for v in ("A", 1, "B", 3)))
    items = spark.range(1, 8).select(F.col("id").cast("int").alias("item"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("trait"), F.map_concat(mapping, F.create_map(F.lit("C"), F.lit(0), F.lit("D"), F.lit(0))).alias("mapping"))
    return rounded(e.trait_scores(own, items, least_mass=0.5, coverage=0.5))


@query("select doc_id, length(text) // 4 + 200 <= 4096 - 256 - (100 + 256 + 20) - 50 as fits from documents")
def q_fits_context(spark, d):
    return t.load(spark, d, "documents").select("doc_id", e.fits_context(F.floor(F.length("text") / 4), 200, 4096, 256, 100, 50).alias("fits"))


# --- calibration ---------------------------------------------------------------------------------------------------


@query(f"select p.p_partkey as id, median(s.score) as median_score, count(s.score) as available from {{PART}} p left join {SCORES} s on s.response_id = p.p_partkey group by 1")
def q_reference_set(spark, d):
    ratings = scores(spark, d).select(F.col("response_id").alias("id"), "rater", "score")
    return e.reference_set(ratings, part(spark, d).select(F.col("p_partkey").alias("id")))


@query("""
with g as (select p_partkey as id, p_brand as question, p_type as response from {PART}), r as (select p_partkey as rating, case when p_partkey % 3 = 0 then 'other' else upper(p_brand) end as q, case when p_partkey % 5 = 0 then 'nothing' else '  ' || p_type end as r from {PART})
select rating, coalesce((select min(id) from g where lower(question) = lower(r.q) and lower(response) = lower(trim(r.r))), (select min(id) from g where lower(response) = lower(trim(r.r)))) as gold_id from r
""")
def q_match_gold(spark, d):
    own_part = part(spark, d)
    gold = own_part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("question"), F.col("p_type").alias("response"))
    key = F.col("p_partkey")
    own = own_part.select(key.alias("rating"), F.when(key % 3 == 0, "other").otherwise(F.upper("p_brand")).alias("question"), F.when(key % 5 == 0, "nothing").otherwise(F.concat(F.lit("  "), "p_type")).alias("response"))
    return e.match_gold(own, gold).select("rating", "gold_id")


@query("""
with r as (select event_type as rater, value::double as score, 50.0::double as gold, event_id % 5 = 0 as is_check from events), o as (select rater from r where is_check group by 1 having avg(abs(score - gold)) > 60)
select rater, count(*) as n from r where rater not in (select rater from o) group by 1
""")
def q_attentive(spark, d):
    own = t.load(spark, d, "events").select(F.col("event_type").alias("rater"), F.col("value").cast("double").alias("score"), F.lit(50.0).alias("gold"), (F.col("event_id") % 5 == 0).alias("is_check"))
    return e.attentive(own, 60.0).groupBy("rater").agg(F.count("*").alias("n"))


GOLD = "(select p_partkey as id, p_size % 9 - 4 as gold from {PART})"


@query(f"""
select rater, count(*) as n, round(avg(abs(gold - score)), 6) as mae, round(avg(cast(gold = score as double)), 6) as exact, round(avg(cast(abs(gold - score) <= 1 as double)), 6) as within_one, round(corr(gold, score), 6) as pearson,
  round(1 - avg((gold - score) ** 2) / (var_pop(gold) + var_pop(score) + (avg(gold) - avg(score)) ** 2), 6) as weighted_agreement from {SCORES} s join {GOLD} g on g.id = s.response_id group by rater
""")
def q_gold_agreement(spark, d):
    gold = part(spark, d).select(F.col("p_partkey").alias("id"), (F.col("p_size") % 9 - 4).alias("gold"))
    return rounded(e.gold_agreement(scores(spark, d).select(F.col("response_id").alias("id"), "rater", "score"), gold, "rater"))


@query(f"select response_id as id, case when rater in ('click', 'view') then 'a' else 'b' end as grp, median(score) as median from {SCORES} group by all")
def q_group_medians(spark, d):
    own = scores(spark, d).select(F.col("response_id").alias("id"), F.when(F.col("rater").isin("click", "view"), "a").otherwise("b").alias("grp"), "score")
    return e.group_medians(own)


@query(f"select a.response_id as id, a.rater, a.score, median(b.score) as others from {SCORES} a left join {SCORES} b on a.response_id = b.response_id and a.rater <> b.rater group by all")
def q_leave_one_out(spark, d):
    return e.leave_one_out(scores(spark, d).select(F.col("response_id").alias("id"), "rater", "score"))
