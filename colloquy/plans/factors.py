"""Queries over response matrices, effect sizes, loadings and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import factors as f
from ..sources import tables as t
from .catalogue import query
from .judging import rounded

FULL = "(select * from {CELLS} where k in (select k from {CELLS} group by k having count(value) = 5))"


@query(f"select k, col, round(value, 6) as value from {FULL}")
def q_complete_rows(spark, d):
    return rounded(f.complete_rows(t.cells(spark, d), 5))


@query(f"with v as (select k, var_pop(value) as v from {FULL} group by k) select k, count(*) as n from {FULL} where k in (select k from v where v <= (select quantile_cont(v, 0.9) from v)) group by k")
def q_steady_rows(spark, d):
    return f.steady_rows(f.complete_rows(t.cells(spark, d), 5), 0.1).groupBy("k").agg(F.count("*").alias("n"))


@query("""
with i as (select dim // 16 as block, dim as col, var_pop(x) as v from {DIMS} group by all), m as (select block, median(v) filter (v > 0) as m from i group by 1)
select cast(block as bigint) as block, col, round(v, 6) as v, round(v / m, 6) as ratio from i join m using (block) where v / m >= 0.9
""")
def q_varied_columns(spark, d):
    cells = t.dims(spark, d).select(F.col("vec_id").alias("k"), F.col("dim").alias("col"), F.col("x").alias("value"))
    return rounded(f.varied_columns(cells, F.floor(F.col("col") / 16), 0.9))


@query("select vec_id, dim, round(case when vec_id % 7 = 0 then 0 else x - avg(x) over (partition by label, dim, vec_id % 7 = 0) end, 6) as x from {DIMS}")
def q_residualize(spark, d):
    own = t.dims(spark, d).withColumn("grp", F.when(F.col("vec_id") % 7 > 0, F.col("label")))
    return rounded(f.residuals(own, ["grp", "dim"], "x").select("vec_id", "dim", "x"))


@query("""
with v as (select label, dim, coalesce(var_samp(x), 0) as v, count(*) as n from {DIMS} group by all)
select label, max(n) as n, round(sum(v), 6) as total_variance from v group by label
""")
def q_variance_report(spark, d):
    own = t.dims(spark, d).groupBy("label", "dim").agg(F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"), F.count("*").alias("n"))
    return rounded(own.groupBy("label").agg(F.max("n").alias("n"), F.sum("v").alias("total_variance")))


@query("select a.col as a, b.col as b, round(corr(a.value, b.value), 6) as r from {CELLS} a join {CELLS} b on a.k = b.k and a.col < b.col group by all")
def q_correlations(spark, d):
    return rounded(f.correlations(t.cells(spark, d)))


LOADINGS = "(select dim as item, label as factor, avg(x) as loading from {DIMS} where vec_id % 2 = @ group by all)"


def loadings(spark, d, half=None):
    own = t.dims(spark, d)
    own = own if half is None else own.where(F.col("vec_id") % 2 == half)
    return own.groupBy(F.col("dim").alias("item"), F.col("label").alias("factor")).agg(F.avg("x").alias("loading"))


@query(f"select a.factor as fa, b.factor as fb, round(sum(a.loading * b.loading) / sqrt(sum(a.loading ** 2) * sum(b.loading ** 2)), 6) as phi from {LOADINGS.replace('@', '0')} a join {LOADINGS.replace('@', '1')} b using (item) group by all")
def q_tucker_phi(spark, d):
    return rounded(f.tucker(loadings(spark, d, 0), loadings(spark, d, 1)))


@query(f"""
with p as (select *, row_number() over (partition by factor order by loading desc, item) as up, row_number() over (partition by factor order by loading, item) as down from {LOADINGS.replace(' where vec_id % 2 = @', '')})
select factor, 1 as sign, cast(up as integer) as rank, item, round(loading, 6) as loading from p where up <= 3 and loading > 0 union all select factor, -1, cast(down as integer), item, round(loading, 6) from p where down <= 3 and loading < 0
""")
def q_top_loadings(spark, d):
    return rounded(f.top_loadings(loadings(spark, d), 3))


@query("select count(distinct event_type) as n_groups, round(sum(n * (m - g) ** 2) / max(t), 6) as eta2 from (select event_type, count(*) as n, avg(value) as m from events group by 1), (select avg(value) as g, var_pop(value) * count(value) as t from events)")
def q_eta2(spark, d):
    return rounded(f.eta_squared(t.load(spark, d, "events"), "event_type", "value"))


@query("""
with t as (select count(*) as n, avg(value) as m, var_pop(value) * count(*) as t from events),
a as (select sum(n * m * m) as s from (select count(*) as n, avg(value) as m from events group by event_type)), b as (select sum(n * m * m) as s from (select count(*) as n, avg(value) as m from events group by user_id)), c as (select sum(n * m * m) as s from (select count(*) as n, avg(value) as m from events group by event_type, user_id))
select round((a.s - n * m * m) / t, 6) as eta_a, round((b.s - n * m * m) / t, 6) as eta_b, round(greatest(0, (c.s - a.s - b.s + n * m * m) / t), 6) as eta_ab, round((t - c.s + n * m * m) / t, 6) as eta_rest from t, a, b, c
""")
def q_two_way_eta2(spark, d):
    return rounded(f.two_way_eta(t.load(spark, d, "events"), "event_type", "user_id", "value"))


@query("""
with g as (select user_id, count(*)::double as n, avg(value) as m, var_pop(value) as v from events group by 1 having count(*) >= 2),
s as (select count(*)::double as k, sum(n) as n, (sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1) as b, sum(n * v) / (sum(n) - count(*)) as w, count(*) / sum(1 / n) as h from g)
select cast(k as bigint) as n_groups, round((b - w) / (b + (h - 1) * w), 6) as icc1, round((b - w) / b, 6) as icck, round(b / w, 6) as f from s
""")
def q_icc(spark, d):
    return rounded(f.icc(t.load(spark, d, "events"), "user_id", "value").drop("low", "high"))


@query(f"select (select count(*) from (select k from {FULL} group by k)) as n_rows, round(1.25 * (1 - (select sum(v) from (select var_samp(value) as v from {FULL} group by col)) / (select var_samp(s) from (select sum(value) as s from {FULL} group by k))), 6) as alpha")
def q_cronbach(spark, d):
    return rounded(f.cronbach(t.cells(spark, d), 5))


D = "(avg(value) filter (late) - avg(value) filter (not late))"


@query(f"""
select event_type, round({D} / sqrt((var_samp(value) filter (late) + var_samp(value) filter (not late)) / 2), 6) as d, round({D} / sqrt(((count(*) filter (late) - 1) * var_samp(value) filter (late) + (count(*) filter (not late) - 1) * var_samp(value) filter (not late)) / (count(*) - 2)), 6) as pooled from (select *, user_id % 2 = 1 as late from events) group by 1
""")
def q_cohens_d(spark, d):
    late = F.col("user_id") % 2 == 1
    return rounded(t.load(spark, d, "events").groupBy("event_type").agg(f.cohens_d(F.col("value"), late).alias("d"), f.cohens_d(F.col("value"), late, True).alias("pooled")))


@query()
def q_factor_loadings(spark, d):
    n, r = f.vector_correlations(t.load(spark, d, "embeddings"), "embedding")
    load = f.varimax(f.principal_axes(r, 2))
    return spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(load) for k, v in enumerate(row)], "item int, factor int, loading double")


@query()
def q_parallel_analysis(spark, d):
    n, r = f.vector_correlations(t.load(spark, d, "embeddings"), "embedding")
    total, leading = f.parallel_analysis(n, len(r), np.sort(np.linalg.eigvalsh(r))[::-1], spark, draws=40)
    return spark.createDataFrame([(n, len(r), total, leading)], "n_rows long, n_items long, n_factors long, n_leading long")


# --- vectors -------------------------------------------------------------------------------------------------------

UNIT = "[" + ", ".join("1.0" if k % 3 else "-0.5" for k in range(64)) + "]"


@query(f"""
with s as (select vec_id, label, list_cosine_similarity(list_transform(embedding, lambda v: v::double), {UNIT}::double[]) as s from embeddings), r as (select *, row_number() over (partition by label order by s desc, vec_id) as k from s)
select vec_id, label, round(s, 6) as similarity from r where k <= 2 order by s desc, vec_id limit 10
""")
def q_cosine_topk(spark, d):
    near = f.neighbours(t.load(spark, d, "embeddings"), [1.0 if k % 3 else -0.5 for k in range(64)], 10, "label", 2)
    return rounded(near.select("vec_id", "label", "similarity"))


@query("select dim, 1 as side, cast(k as integer) as rank, vec_id, round(x, 6) as x from (select *, row_number() over (partition by dim order by x desc, vec_id) as k from {DIMS}) where k <= 3")
def q_factor_extremes(spark, d):
    own = t.dims(spark, d).select(F.col("vec_id").alias("item"), F.col("dim").alias("factor"), F.col("x").alias("loading"))
    top = f.top_loadings(own, 3).where("sign = 1")
    return rounded(top.select(F.col("factor").alias("dim"), F.col("sign").alias("side"), "rank", F.col("item").alias("vec_id"), F.col("loading").alias("x")))


@query("""
with p as (select vec_id, greatest(0, abs(embedding[3]::double) - 0.5 * (list_sum(list_transform(embedding, lambda v: abs(v::double))) - abs(embedding[3]::double)) / 63) as purity from embeddings)
select vec_id, round(purity, 6) as purity from p order by purity desc, vec_id limit 10
""")
def q_purity_rank(spark, d):
    own = t.load(spark, d, "embeddings").select("vec_id", f.purity(F.col("embedding"), 2, 0.5).alias("purity"))
    return rounded(own.orderBy(F.desc("purity"), "vec_id").limit(10))


@query("select label, round(max(x) - min(x), 6) as spread, arg_max(vec_id, x) as highest, arg_min(vec_id, x) as lowest from {DIMS} where dim = 0 group by label having count(*) >= 2")
def q_max_spread(spark, d):
    own = t.dims(spark, d, 1).groupBy("label").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("spread"), F.max_by("vec_id", "x").alias("highest"), F.min_by("vec_id", "x").alias("lowest"))
    return rounded(own.where("n >= 2").drop("n"))


AXIS = "(select dim, avg(x) filter (label >= 5) - avg(x) filter (label < 5) as axis, avg(x) filter (label < 5) as low, avg(x) filter (label >= 5) as high from {DIMS} group by dim)"


@query(f"select dim, round(axis, 6) as axis, round(low + 0.5 * (high - low), 6) as floor, round(high - 0.25 * (high - low), 6) as ceiling from {AXIS}")
def q_axis(spark, d):
    mean = lambda c: F.avg(F.when(c, F.col("x")))
    own = t.dims(spark, d).groupBy("dim").agg(mean(F.col("label") >= 5).alias("high"), mean(F.col("label") < 5).alias("low"))
    return rounded(own.select("dim", (F.col("high") - F.col("low")).alias("axis"), f.threshold(F.col("low"), F.col("high"), 0.5).alias("floor"), f.threshold(F.col("low"), F.col("high"), -0.25).alias("ceiling")))


@query("""
with s as (select label, dim, stddev_samp(x) as sd from {DIMS} group by all), r as (select label, dim as start, sum(sd) over w as total, count(*) over w as n from s window w as (partition by label order by dim rows between current row and 7 following))
select label, start, round(total, 6) as total from (select *, row_number() over (partition by label order by total desc, start) as k from r where n = 8) where k = 1
""")
def q_best_window(spark, d):
    own = t.dims(spark, d).groupBy("label", "dim").agg(F.stddev_samp("x").alias("sd"))
    return rounded(f.best_window(own, "label", "dim", "sd", 8))


@query("""
with m as (select label, dim // 16 as layer, dim, avg(x) as x from {DIMS} group by all)
select a.label as a, b.label as b, cast(layer as bigint) as layer, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) as cosine from m a join m b using (layer, dim) where a.label < b.label group by all
""")
def q_layer_cosine(spark, d):
    mean = t.dims(spark, d).groupBy("label", "dim").agg(F.avg("x").alias("x")).withColumn("layer", F.floor(F.col("dim") / 16))
    both = mean.select(F.col("label").alias("a"), "layer", "dim", F.col("x").alias("p")).join(mean.select(F.col("label").alias("b"), "layer", "dim", F.col("x").alias("q")), ["layer", "dim"]).where("a < b")
    return rounded(both.groupBy("a", "b", "layer").agg((F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") ** 2) * F.sum(F.col("q") ** 2))).alias("cosine")))


@query("""
with m as (select label, dim, avg(x) as x from {DIMS} group by all),
f as (select label, part, i, k, x as b from (select *, 0 as part, dim // 2 as i, dim % 2 as k from m where dim < 32)), g as (select label, k, c, x as a from (select *, (dim - 32) // 16 as k, (dim - 32) % 16 as c from m where dim >= 32)),
w as (select f.label, i, c, sum(b * a) as w from f join g on f.label = g.label and f.k = g.k group by all)
select x.label as x, y.label as y, round(sum(x.w * y.w) / sqrt(sum(x.w * x.w) * sum(y.w * y.w)), 6) as cosine from w x join w y using (i, c) group by all
""")
def q_weight_cosine(spark, d):
    """Cosines of the labels' mean vectors, read as factors of 16 x 16 matrices of rank 2."""
    mean = t.dims(spark, d).groupBy("label", "dim").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("e"))
    rows = lambda lo, n, w: F.array(*(F.slice("e", lo + k * w + 1, w) for k in range(n)))
    own = mean.select(F.col("label").cast("long").alias("vec"), F.lit(0).alias("module"), rows(0, 16, 2).alias("b"), rows(32, 2, 16).alias("a"))
    dots = f.low_rank_dot(own, own)
    norm = dots.where("x = y").select(F.col("x").alias("v"), F.sqrt("dot").alias("norm"))
    both = dots.join(norm.withColumnsRenamed({"v": "x", "norm": "nx"}), "x").join(norm.withColumnsRenamed({"v": "y", "norm": "ny"}), "y")
    return rounded(both.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.coalesce(F.try_divide(F.col("dot"), F.col("nx") * F.col("ny")), F.lit(0.0)).alias("cosine")))
