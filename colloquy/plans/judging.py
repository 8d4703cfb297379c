"""Queries over judges' scores, rates and sweeps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import logprobs as lp
from ..functions import stats
from ..operators import judging as j
from ..sources import tables as t
from .catalogue import query

SCORES = "(select response_id, rater, quantile_disc(score, 0.5) as score from {JUDGE} where status <> 'call_error' group by all)"
PAIRS = f"(select a.response_id, a.rater as rater_a, b.rater as rater_b, cast(a.score as double) as a, cast(b.score as double) as b from {SCORES} a join {SCORES} b on a.response_id = b.response_id and a.rater < b.rater)"
Z = repr(stats.Z95)
#: The raters that are asked for each response.
PANEL = ("click", "error", "purchase", "signup", "view")


def rounded(df, *keep):
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" and c not in keep else c for c, kind in df.dtypes))


def scores(spark, d):
    return j.score_per_rater(t.judge(spark, d))


@query(f"select response_id, rater, score from {SCORES}")
def q_judge_median_low(spark, d):
    return scores(spark, d)


@query("select response_id, rater, median(score) as score from {JUDGE} where status <> 'call_error' group by all")
def q_judge_median(spark, d):
    return j.score_per_rater(t.judge(spark, d), "true")


@query(f"select response_id, median(score) as score, count(*) as n_raters from {SCORES} group by 1")
def q_panel_median(spark, d):
    return j.panel_median(scores(spark, d))


@query("""
select rater, count(*) as n, round(avg(score), 6) as mean, median(score) as median, round(stddev_pop(score), 6) as std, min(score) as min, max(score) as max from {JUDGE} where status <> 'call_error' group by rater
""")
def q_cell_summary(spark, d):
    own = j.scored(t.judge(spark, d)).groupBy("rater")
    return rounded(own.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), stats.std("score", 0).alias("std"), F.min("score").alias("min"), F.max("score").alias("max")))


PAIR_COLUMNS = "count(*) as n, round(avg(abs(a - b)), 6) as mae, round(avg(cast(a = b as double)), 6) as exact, round(avg(cast(abs(a - b) <= 1 as double)), 6) as within_one, round(case when var_pop(a) > 0 and var_pop(b) > 0 then covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) end, 6) as pearson, round(1 - avg((a - b) * (a - b)) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2), 6) as weighted_agreement"


@query(f"select rater_a, rater_b, {PAIR_COLUMNS} from {PAIRS} group by all")
def q_pairwise_agreement(spark, d):
    return rounded(j.pair_statistics(j.rater_pairs(scores(spark, d)), "rater_a", "rater_b"))


@query(f"select cast(response_id % 4 as integer) as category, {PAIR_COLUMNS} from {PAIRS} group by 1")
def q_category_breakdown(spark, d):
    pairs = j.rater_pairs(scores(spark, d)).withColumn("category", (F.col("response_id") % 4).cast("int"))
    return rounded(j.pair_statistics(pairs, "category"))


RANKED = f"(select rater_a, rater_b, rank() over (partition by rater_a, rater_b order by a) + (count(*) over (partition by rater_a, rater_b, a) - 1) / 2 as ra, rank() over (partition by rater_a, rater_b order by b) + (count(*) over (partition by rater_a, rater_b, b) - 1) / 2 as rb from {PAIRS})"


@query(f"select rater_a, rater_b, count(*) as n, round(corr(ra, rb), 6) as spearman from {RANKED} group by all")
def q_spearman(spark, d):
    return rounded(j.spearman(j.rater_pairs(scores(spark, d)), ["rater_a", "rater_b"]))


@query(f"select response_id, rater, rank() over (partition by rater order by score) + (count(*) over (partition by rater, score) - 1) / 2 as rank from {SCORES}")
def q_tied_ranks(spark, d):
    return j.tied_ranks(scores(spark, d), ["rater"], "score", "rank").select("response_id", "rater", "rank")


@query(f"""
with u as (select count(*)::double as n, sum(score)::double as s, sum(score * score)::double as q from {SCORES} group by response_id having count(*) >= 2)
select count(*) as n_units, cast(sum(n) as bigint) as n_scores, round(1 - sum((n * q - s * s) / (n - 1)) / ((sum(n) * sum(q) - sum(s) * sum(s)) / (sum(n) - 1)), 6) as alpha from u
""")
def q_alpha_interval(spark, d):
    return rounded(j.alpha_interval(scores(spark, d)))


@query(f"""
with s as (select response_id, rater, cast(score as double) as x from {SCORES} where response_id in (select response_id from {SCORES} group by 1 having count(*) >= 2)),
o as (select avg((a.x - b.x) ** 2) as o from s a join s b on a.response_id = b.response_id and a.rater < b.rater),
e as (select avg((a.x - b.x) ** 2) as e from (select *, row_number() over (order by response_id, rater) as k from s) a join (select *, row_number() over (order by response_id, rater) as k from s) b on a.k < b.k)
select (select count(distinct response_id) from s) as n_units, (select count(*) from s) as n_scores, round(1 - o / e, 6) as alpha from o, e
""")
def q_alpha_raw_pairs(spark, d):
    return rounded(j.alpha_raw_pairs(scores(spark, d)))


@query(f"""
with s as (select * from {SCORES} where response_id in (select response_id from {SCORES} group by 1 having count(*) >= 2)),
n as (select response_id, count(*) as n from s group by 1),
o as (select x.score as a, y.score as b, sum(1.0::double / (n - 1)) as o from s x join s y on x.response_id = y.response_id and x.rater <> y.rater join n on n.response_id = x.response_id group by all),
g as (select a, sum(o) as m, sum(sum(o)) over (order by a) as upto from o group by a),
p as (select x.a, y.a as b, x.m as ma, y.m as mb, case when x.a = y.a then 0 else (abs(x.upto - y.upto) + case when x.a <= y.a then x.m else y.m end - (x.m + y.m) / 2) ** 2 end as apart from g x, g y)
select round(1 - ((select sum(o) from o) - 1) * (select sum(o * apart) from o join p using (a, b)) / (select sum(ma * mb * apart) from p), 6) as alpha
""")
def q_alpha_ordinal(spark, d):
    return rounded(j.alpha_ordinal(scores(spark, d)))


@query(f"select response_id, cast(max(score) - min(score) as integer) as spread, count(*) as n_raters from {SCORES} group by 1 order by 2 desc, 1 limit 20")
def q_item_spread(spark, d):
    return j.item_spread(scores(spark, d)).orderBy(F.desc("spread"), "response_id").limit(20)


@query("""
with g as (select rater, response_id, stddev_pop(score) as sd, max(score) - min(score) as r from {JUDGE} where status <> 'call_error' group by all having count(*) >= 2)
select rater, round(avg(cast(status = 'parse_error' as double)), 6) as parse_error_rate, round(avg(cast(status = 'call_error' as double)), 6) as call_error_rate, (select round(avg(sd), 6) from g where g.rater = e.rater) as mean_sd, (select round(avg(cast(r = 0 as double)), 6) from g where g.rater = e.rater) as exact_repeats, (select round(avg(cast(r <= 1 as double)), 6) from g where g.rater = e.rater) as close_repeats from {JUDGE} e group by rater
""")
def q_rater_stability(spark, d):
    return rounded(j.rater_stability(t.judge(spark, d)))


@query("""
with l as (select response_id, rater, arg_max(status, seq) as status from {JUDGE} group by all), e as (select * from (select distinct response_id from {JUDGE}), (select distinct rater from {JUDGE}))
select response_id, rater from e where not exists (select 1 from l where l.response_id = e.response_id and l.rater = e.rater and status <> 'call_error')
""")
def q_panel_queue(spark, d):
    own = t.judge(spark, d)
    expected = own.select("response_id").distinct().withColumn("rater", F.explode(F.array(*map(F.lit, PANEL))))
    return j.queue(expected, own, True)


WILSON = f"n, n_true, round(n_true / n, 6) as rate, round(greatest(0, (n_true / n + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} / (1 + {Z} * {Z} / n) * sqrt(n_true / n * (1 - n_true / n) / n + {Z} * {Z} / (4.0 * n * n))), 6) as low, round(least(1, (n_true / n + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) + {Z} / (1 + {Z} * {Z} / n) * sqrt(n_true / n * (1 - n_true / n) / n + {Z} * {Z} / (4.0 * n * n))), 6) as high"


@query(f"select condition, {WILSON} from (select condition, count(*) as n, count_if(is_harmful) as n_true from {{JUDGMENTS}} group by 1)")
def q_harm_rate(spark, d):
    return rounded(j.rate(t.judgments(spark, d), "is_harmful", "condition"))


@query(f"select condition, category, {WILSON} from (select condition, category, count(*) as n, count_if(is_harmful) as n_true from {{JUDGMENTS}} group by 1, 2)")
def q_harm_rate_by_category(spark, d):
    return rounded(j.rate(t.judgments(spark, d), "is_harmful", "condition", "category"))


@query(f"select condition, {WILSON} from (select condition, count(*) as n, count_if(is_refusal) as n_true from {{JUDGMENTS}} where not is_harmful group by 1)")
def q_benign_refusal(spark, d):
    return rounded(j.rate(t.judgments(spark, d).where(~F.col("is_harmful")), "is_refusal", "condition"))


# --- sweeps --------------------------------------------------------------------------------------------------------


@query("""
select scale, grp, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0), 6) as std, round(1.959963984540054 * stddev_samp(score) / sqrt(count(score)), 6) as half_width, count(*) as n from {SWEEP} group by all
""")
def q_sweep_mean(spark, d):
    own = t.sweep(spark, d).groupBy("scale", "grp")
    return rounded(own.agg(F.avg("score").alias("mean"), stats.std("score", 1).alias("std"), stats.normal_half_width(F.col("score")).alias("half_width"), F.count("*").alias("n")), "scale")


@query("""
select scale, grp, round(avg(score) filter (choice_mass >= 0.25 and choice_mass >= 0.75), 6) as mean, count(*) filter (choice_mass < 0.25) as n_dynamic, count(*) filter (choice_mass >= 0.25 and choice_mass < 0.75) as n_fixed, round(avg(choice_mass * score + (1 - choice_mass) * 0.5), 6) as weighted_mean from {SWEEP} group by all
""")
def q_sweep_mass_filter(spark, d):
    mass, n = F.col("choice_mass"), F.col("num_choices")
    even = 1 / n
    return rounded(t.sweep(spark, d).groupBy("scale", "grp").agg(
        F.avg(F.when(lp.passes_mass(mass, n), F.col("score"))).alias("mean"), F.count_if(mass < even).alias("n_dynamic"), F.count_if((mass >= even) & (mass < 0.75)).alias("n_fixed"),
        F.avg(mass * F.col("score") + (1 - mass) * 0.5).alias("weighted_mean"),
    ), "scale")


@query(f"select scale, {WILSON} from (select scale, count(*) as n, count_if(score = 1) as n_true from {{SWEEP}} where choice_mass >= 0.75 group by 1)")
def q_sweep_wilson(spark, d):
    own = t.sweep(spark, d).where(lp.passes_mass(F.col("choice_mass"), F.col("num_choices"))).withColumn("yes", F.col("score") == 1)
    return rounded(j.rate(own, "yes", "scale"), "scale")


@query("""
select scale, round(avg(m), 6) as mean, count(*) as n_runs, round(min(m), 6) as lowest, round(max(m), 6) as highest from (select scale, run, avg(score) as m from {SWEEP} group by all) group by scale
""")
def q_seed_balanced_mean(spark, d):
    own = t.sweep(spark, d).groupBy("scale", "run").agg(F.avg("score").alias("m"))
    return rounded(own.groupBy("scale").agg(F.avg("m").alias("mean"), F.count("*").alias("n_runs"), F.min("m").alias("lowest"), F.max("m").alias("highest")), "scale")


@query("""
with r as (select scale, run, count(score) as n, avg(score) as m, var_pop(score) as v from {SWEEP} group by all)
select scale, round(sum(n * v) / sum(n), 6) as within, round(sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2, 6) as between_runs from r group by scale
""")
def q_variance_parts(spark, d):
    own = t.sweep(spark, d).groupBy("scale", "run").agg(F.count("score").alias("n"), F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    return rounded(own.groupBy("scale").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - mean * mean).alias("between_runs")), "scale")


@query("""
with g as (select grp, run, scale, avg(score) as m from {SWEEP} group by all)
select grp, run, count(*) as n_scales, round(avg(m), 6) as mean, round(coalesce(stddev_samp(m), 0), 6) as std, round(max(m) - min(m), 6) as range from g group by all
""")
def q_question_profile(spark, d):
    own = t.sweep(spark, d).groupBy("grp", "run", "scale").agg(F.avg("score").alias("m"))
    return rounded(own.groupBy("grp", "run").agg(F.count("*").alias("n_scales"), F.avg("m").alias("mean"), stats.std("m", 1).alias("std"), (F.max("m") - F.min("m")).alias("range")))


@query("""
select grp, run, round(covar_pop(score, scale) / var_pop(scale), 6) as slope, round(covar_pop(score, scale) / sqrt(var_pop(scale) * var_pop(score)), 6) as r from {SWEEP} group by all
""")
def q_scale_slopes(spark, d):
    own = t.sweep(spark, d).groupBy("grp", "run")
    return rounded(own.agg(stats.slope(F.col("scale"), F.col("score")).alias("slope"), stats.pearson(F.col("scale"), F.col("score")).alias("r")))


@query("""
select scale, round(avg(a), 6) as correct, round(avg((1 - a) * r), 6) as recovered, round(avg((1 - a) * (1 - r) * p), 6) as wrong, round(avg((1 - a) * (1 - r) * (1 - p)), 6) as no_answer from (select scale, score as a, cast(run % 3 = 0 as double) as r, cast(choice_mass > 0.3 as double) as p from {SWEEP}) group by scale
""")
def q_capability_breakdown(spark, d):
    a, r, p = F.col("score"), (F.col("run") % 3 == 0).cast("double"), (F.col("choice_mass") > 0.3).cast("double")
    parts = {"correct": a, "recovered": (1 - a) * r, "wrong": (1 - a) * (1 - r) * p, "no_answer": (1 - a) * (1 - r) * (1 - p)}
    return rounded(t.sweep(spark, d).groupBy("scale").agg(*(F.avg(c).alias(n) for n, c in parts.items())), "scale")


@query("""
select x.threshold, count(*) filter (s.choice_mass >= x.threshold) as cells, count(distinct case when s.choice_mass >= x.threshold then s.item end) as items, round(avg(cast(s.choice_mass >= x.threshold as double)), 6) as share from {SWEEP} s, (values (0.25::double), (0.5), (0.75)) x(threshold) group by 1
""")
def q_retention_curve(spark, d):
    steps = F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75)))
    own = t.sweep(spark, d).select("item", "choice_mass", F.explode(steps).alias("threshold"))
    kept = F.col("choice_mass") >= F.col("threshold")
    return rounded(own.groupBy("threshold").agg(F.count_if(kept).alias("cells"), F.count_distinct(F.when(kept, F.col("item"))).alias("items"), F.avg(kept.cast("double")).alias("share")), "threshold")


@query("""
select coalesce(rater, 'all') as rater, count(*) as n, round(avg(score), 6) as mean, quantile_cont(score, 0.1) as p10, quantile_cont(score, 0.5) as p50, quantile_cont(score, 0.9) as p90 from {JUDGE} where score >= 0 group by grouping sets ((), (rater))
""")
def q_realism_summary(spark, d):
    own = t.judge(spark, d).where(F.col("score") >= 0).groupingSets([[], ["rater"]], "rater")
    q = F.percentile("score", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return own.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), q[0].alias("p10"), q[1].alias("p50"), q[2].alias("p90")).select(F.coalesce("rater", F.lit("all")).alias("rater"), "n", "mean", "p10", "p50", "p90")


@query("""
with c as (select sample_id, max(length(content)) as worst from {MESSAGES} where role = 'assistant' group by 1), t as (select turn_index, avg(length(content)) as mean, avg(cast(length(content) >= 200 as double)) as high from {MESSAGES} where role = 'assistant' group by 1)
select -1::bigint as turn_index, round(avg(worst), 6) as mean, round(avg(cast(worst >= 200 as double)), 6) as high from c union all select turn_index, round(mean, 6), round(high, 6) from t
""")
def q_worst_turns(spark, d):
    own = t.messages(spark, d).where(F.col("role") == "assistant").withColumn("n", F.length("content"))
    high = F.avg((F.col("n") >= 200).cast("double")).alias("high")
    every = own.groupBy("turn_index").agg(F.avg("n").alias("mean"), high)
    worst = own.groupBy("sample_id").agg(F.max("n").alias("n")).agg(F.lit(-1).cast("long").alias("turn_index"), F.avg("n").alias("mean"), high)
    return rounded(worst.unionByName(every))


@query()
def q_bca_interval(spark, d):
    return stats.bootstrap_by_group(j.scored(t.judge(spark, d)), ["rater"], "score")


@query()
def q_weighted_bootstrap(spark, d):
    return stats.bootstrap_by_group(t.sweep(spark, d), ["scale"], "score", weight="choice_mass", draws=500)


@query()
def q_cluster_bootstrap(spark, d):
    return stats.cluster_bootstrap(t.sweep(spark, d), ["scale"], "run", "score", draws=500)


@query()
def q_t_interval(spark, d):
    """Half width by Student's distribution; the quantiles of the few distinct counts come from a table."""
    own = t.sweep(spark, d).groupBy("scale", "grp").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))

    @F.pandas_udf("double")
    def points(n: pd.Series) -> pd.Series:
        return n.map(lambda k: stats.student_t(0.975, k - 1) if k > 1 else 0.0)

    quantiles = own.select("n").distinct().withColumn("t", points("n"))
    return own.join(quantiles, "n").select("scale", "grp", "n", "mean", F.coalesce(F.col("t") * F.col("sd") / F.sqrt("n"), F.lit(0.0)).alias("half_width"))
