"""Queries over factor models and tables of factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import models as mo
from ..sources import tables as t
from .catalogue import query
from .factors import FULL
from .judging import rounded


def moments(spark, d):
    return mo.Moments.of(sum(mo.sums_by(t.load(spark, d, "embeddings"), "embedding", F.lit(0)).values()))


@query("select dim as item, round(avg(x), 6) as mean, round(var_pop(x), 6) as variance, count(*) as n from {DIMS} group by 1")
def q_item_moments(spark, d):
    m = moments(spark, d)
    rows = [(k, round(float(a), 6), round(float(v), 6), int(m.n)) for k, (a, v) in enumerate(zip(m.mean, np.diag(m.cov)))]
    return spark.createDataFrame(rows, "item int, mean double, variance double, n long")


@query()
def q_factor_counts(spark, d):
    """What each rule makes of the embeddings' components."""
    folds = mo.sums_by(t.load(spark, d, "embeddings"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(5)))
    m = mo.Moments.of(sum(folds.values()))
    found = mo.suggest(m.n, m.correlations(), folds, 6)
    return spark.createDataFrame([(name, r["k"], r["semantics"], bool(r.get("saturated", False))) for name, r in found.items()], "rule string, k int, semantics string, saturated boolean")


@query()
def q_factor_stability(spark, d):
    own = mo.split_stability(t.load(spark, d, "embeddings"), "embedding", F.col("vec_id") % 2, 2)
    return spark.createDataFrame([tuple(r.values()) for r in own], "split int, n long, median_phi double, stable boolean")


@query()
def q_loading_intervals(spark, d):
    out = mo.bootstrap_loadings(t.load(spark, d, "embeddings"), "embedding", F.col("vec_id"), 2, draws=20)
    rows = [(i, k, *(float(out[c][i, k]) for c in ("loadings", "low", "high", "sign_stability"))) for i, k in np.ndindex(out["low"].shape)]
    return spark.createDataFrame(rows, "item int, factor int, loading double, low double, high double, sign_stability double")


LOADED = "(select dim as item, label as factor, avg(x) as loading from {DIMS} group by all)"


@query(f"""
with l as (select *, row_number() over (partition by factor order by abs(loading) desc, item) <= 8 as first, item % 4 as trait from {LOADED})
select factor, trait, count_if(first) as n_top, count_if(first and loading >= 0) as n_pos, count_if(first and loading < 0) as n_neg, round(avg(loading), 6) as mean_signed, round(avg(abs(loading)), 6) as mean_abs from l group by all
""")
def q_trait_alignment(spark, d):
    own = t.dims(spark, d).groupBy(F.col("dim").alias("item"), F.col("label").alias("factor")).agg(F.avg("x").alias("loading"))
    return rounded(mo.trait_alignment(own, own.select("item", (F.col("item") % 4).alias("trait")).distinct(), 8))


@query("""
with s as (select vec_id, embedding[1]::double as s from embeddings), h as (select vec_id, 1 as sign from s order by s desc, vec_id limit 20), l as (select vec_id, -1 as sign from s order by s, vec_id limit 20)
select dim, round(avg(x) filter (sign = 1) - avg(x) filter (sign = -1), 6) as direction from {DIMS} join (select * from h union all select * from l) using (vec_id) group by dim
""")
def q_contrastive_direction(spark, d):
    e = t.load(spark, d, "embeddings")
    return rounded(mo.contrastive_direction(e, F.get("embedding", F.lit(0)).cast("double"), "embedding", 20))


@query("""
with b as (select vec_id, embedding[2]::double as own, (list_sum([abs(x::double) for x in embedding]) - abs(embedding[2]::double)) / (len(embedding) - 1) as other from embeddings),
e as (select quantile_disc(own, 0.1) as low, -quantile_disc(-own, 0.1) as high from b),
h as (select 'high' as side, vec_id, own - 0.5 * other as objective from b, e where own >= high order by objective desc, vec_id limit 10), l as (select 'low', vec_id, -own - 0.5 * other from b, e where own <= low order by 3 desc, vec_id limit 10)
select side, cast(row_number() over (partition by side order by objective desc, vec_id) as integer) as rank, vec_id, round(objective, 6) as objective from (select * from h union all select * from l)
""")
def q_lagrangian_rank(spark, d):
    return rounded(mo.lagrangian_rank(t.load(spark, d, "embeddings"), "embedding", 1, 0.5, 0.1, 10))


@query("""
with m as (select list(m order by dim) as m from (select dim, avg(x) as m from {DIMS} group by 1)), e as (select vec_id, [x::double for x in embedding] as x from embeddings)
select vec_id, round(list_distance(x, m), 6) as l2, round(list_inner_product(x, m) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(m, m)) + 1e-12), 6) as cosine from e, m
""")
def q_outlier_parts(spark, d):
    return rounded(mo.outlier_parts(t.load(spark, d, "embeddings"), "embedding", moments(spark, d), 5).drop("whitened"))


@query("select a.col as a, b.col as b, round(corr(a.value * case when a.col = 'click' then -1 else 1 end, b.value * case when b.col = 'click' then -1 else 1 end), 6) as r from {CELLS} a join {CELLS} b on a.k = b.k and a.col < b.col group by all having r >= -0.05")
def q_redundant_pairs(spark, d):
    cells = t.cells(spark, d)
    signs = cells.select("col").distinct().withColumn("sign", F.when(F.col("col") == "click", -1.0).otherwise(1.0))
    pairs = mo.redundant_pairs(cells, signs, -2.0)
    return rounded(pairs).where("r >= -0.05")


@query("select dim as item, round(1 - sum((x - g) ** 2) / (var_pop(x) * count(x)), 6) as r2 from (select *, avg(x) over (partition by label, dim) as g from {DIMS}) group by dim")
def q_r_squared(spark, d):
    own = t.dims(spark, d)
    guess = own.groupBy("label", "dim").agg(F.avg("x").alias("g"))
    return rounded(mo.r_squared(own.join(F.broadcast(guess), ["label", "dim"]), "dim", "x", "g").withColumnRenamed("dim", "item"))


@query(f"""
with v as (select k, var_pop(value) as v from {FULL} group by k), s as (select * from {FULL} where k in (select k from v where v <= (select quantile_cont(v, 0.9) from v))),
i as (select col, var_pop(value) as v from s group by 1), kept as (select col from i where v / (select median(v) from i where v > 0) >= 0.8)
select k, col, round(value - avg(value) over (partition by k % 5, col), 6) as value from s where col in (select col from kept)
""")
def q_preprocessed(spark, d):
    cells = t.cells(spark, d)
    groups = cells.select("k", (F.col("k") % 5).alias("grp")).distinct()
    return rounded(mo.preprocessed(cells, 5, 0.1, F.lit(0), 0.8, groups))


@query("select a.dim as factor, b.dim as trait, round(corr(a.x, b.x), 6) as r from {DIMS} a join {DIMS} b on a.vec_id = b.vec_id where a.dim < 2 and b.dim between 2 and 5 group by all")
def q_convergent_validity(spark, d):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    pairs = [(a, b) for a in range(2) for b in range(2, 6)]
    one = t.load(spark, d, "embeddings").agg(F.array(*(F.struct(F.lit(a).alias("factor"), F.lit(b).alias("trait"), F.corr(at(a), at(b)).alias("r")) for a, b in pairs)).alias("p"))
    return rounded(one.select(F.explode("p").alias("p")).select("p.*"))
