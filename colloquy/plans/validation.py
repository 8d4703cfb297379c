"""Queries over the validation of factor models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as v
from ..sources import tables as t
from .catalogue import query
from .judging import rounded


def embeddings(spark, d):
    return t.load(spark, d, "embeddings")


@query()
def q_row_item_validation(spark, d):
    """R2 of unseen items of unfitted rows, stratified by label, beside three baselines."""
    return v.row_item_validation(embeddings(spark, d), "embedding", F.col("vec_id"), 3, strata=("label",), trials=3, splits=2)


@query()
def q_validation_summary(spark, d):
    return v.validation_summary(v.row_item_validation(embeddings(spark, d), "embedding", F.col("vec_id"), 2, balanced=True, trials=2))


@query()
def q_permutation_analysis(spark, d):
    """Parallel analysis against permuted items: both counts."""
    found = v.permutation_analysis(embeddings(spark, d), "embedding", F.col("vec_id"), draws=40)
    return spark.createDataFrame([(k, float(e), float(x), found["total"], found["leading"]) for k, (e, x) in enumerate(zip(found["eigenvalues"], found["thresholds"]))], "rank int, eigenvalue double, threshold double, total int, leading int")


@query()
def q_shuffle_control(spark, d):
    found = v.shuffle_control(embeddings(spark, d), "embedding", F.col("vec_id"), draws=40)
    return spark.createDataFrame([tuple(found.values())], "n_factors int, n_items int, expected double, tolerance int, passes boolean")


@query()
def q_item_holdout(spark, d):
    return v.item_holdout(embeddings(spark, d), "embedding", F.col("vec_id"), list(range(0, 64, 8)), 3, permutations=50)


@query()
def q_split_items(spark, d):
    return v.split_items(embeddings(spark, d), "embedding", 2, [k % 3 for k in range(64)], draws=4)


@query()
def q_split_summary(spark, d):
    return v.split_summary(v.split_items(embeddings(spark, d), "embedding", 2, [k % 3 for k in range(64)], draws=8, by_group=False))


PAIRS = "(select l_returnflag as grp, l_orderkey as id, l_linenumber as line, l_quantity::double as x, case when l_orderkey % 17 > 0 then l_discount::double end as y from lineitem)"


def pairs(spark, d):
    y = F.when(F.col("l_orderkey") % 17 > 0, F.col("l_discount").cast("double"))
    return t.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("double").alias("x"), y.alias("y"))


@query(f"""
with p as (select * from {PAIRS} where y is not null), r as (
  select grp, x, y, rank() over (partition by grp order by x) + (count(*) over (partition by grp, x) - 1) / 2.0 as rx, rank() over (partition by grp order by y) + (count(*) over (partition by grp, y) - 1) / 2.0 as ry from p)
select 'pearson' as method, grp, count(*) as n, round(corr(x, y), 6) as r from r group by grp union all select 'spearman', grp, count(*), round(corr(rx, ry), 6) from r group by grp
""")
def q_paired_correlation(spark, d):
    one = lambda m: v.paired_bootstrap(pairs(spark, d), ["grp"], "x", "y", "id", "line", method=m, draws=2).select(F.lit(m).alias("method"), "grp", "n", "r")
    return rounded(one("pearson").unionByName(one("spearman")))


@query()
def q_paired_bootstrap(spark, d):
    """Percentile intervals of rank correlations; the draws follow a hash, which SQL elsewhere doesn't have."""
    return v.paired_bootstrap(pairs(spark, d), ["grp"], "x", "y", "id", "line", draws=100)


def validity(spark, d):
    """Components of embeddings as scores of factors, others as traits."""
    long = lambda lo, hi, name, value: embeddings(spark, d).select(F.col("vec_id").alias("id"), F.posexplode(F.slice("embedding", lo + 1, hi - lo)).alias(name, value)).withColumn(value, F.round(F.col(value).cast("double") * 16) / 16)
    return v.convergent_validity(long(0, 2, "factor", "score"), long(2, 6, "trait", "value"), draws=50)


@query()
def q_convergent_intervals(spark, d):
    return validity(spark, d)


@query()
def q_validity_verdict(spark, d):
    return v.validity_verdict(validity(spark, d), 0.05)


@query("""
with p as (select l_suppkey as test, l_returnflag as grp, avg(l_tax::double) * (l_suppkey % 7) / 10 as p from lineitem group by l_suppkey, l_returnflag),
r as (select *, count(*) over (partition by grp) as n, count(*) over (partition by grp order by p range between unbounded preceding and current row) as place from p),
l as (select grp, max(p) filter (p <= place / n * 0.05) as limit_ from r group by grp)
select test, r.grp, round(p, 6) as p, coalesce(p <= limit_, false) as significant from r join l on r.grp = l.grp
""")
def q_step_up(spark, d):
    p = t.load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("test"), F.col("l_returnflag").alias("grp")).agg((F.avg(F.col("l_tax").cast("double")) * (F.col("l_suppkey") % 7) / 10).alias("p"))
    return rounded(v.step_up(p, "p", keys=("grp",)))
