"""Queries over ordered lines, array files, weight vectors, presets, and the matrix kept by version."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import presets as p
from ..operators import weights as w
from ..sources import arrays, ordered, scratch
from ..sources import tables as t
from ..streaming import matrix as m
from .catalogue import query
from .judging import rounded

# --- lines and arrays ----------------------------------------------------------------------------------------------


@query("""
with o as (select *, row_number() over (order by o_orderkey) - 1 as place from orders)
select (place - 37) // 100 as batch, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key, round(sum(o_totalprice), 2) as total from o where place >= 37 group by 1
""")
def q_ordered_batches(spark, d):
    """Orders written as JSON lines, in many files in order, and read in batches of 100 with 37 rows skipped."""
    path = scratch.fresh_path(spark, "lines")
    own = t.load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    own.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("value")).write.text(path)
    row = F.from_json("value", "o_orderkey long, o_totalprice double")
    found = ordered.batches(spark, path, 100, 37).withColumn("r", row)
    return found.groupBy("batch").agg(F.count("*").alias("n"), F.min("r.o_orderkey").alias("first_key"), F.max("r.o_orderkey").alias("last_key"), F.round(F.sum("r.o_totalprice"), 2).alias("total"))


@query("select label, dim, count(*) as n, round(avg(x), 6) as mean from {DIMS} group by all")
def q_array_files(spark, d):
    """Embeddings written as .npy files, a file of labels beside each, and read back by ranges of rows."""
    vectors, labels = scratch.fresh_path(spark, "vectors"), scratch.fresh_path(spark, "labels")
    own = scratch.written(t.load(spark, d, "embeddings").repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id"), "embeddings")
    arrays.write_npy(own.select("embedding"), vectors)
    own.select(F.to_json(F.struct("vec_id", "label")).alias("value")).write.text(labels)
    # files of either side are those of one partition each; they pair by its number
    number = F.regexp_extract("file", r"part-(\d{5})", 1)
    x = arrays.read_npy(spark, vectors, rows=1000).withColumn("file", number)
    lines = ordered.numbered_lines(spark, labels).withColumn("file", number)
    both = arrays.with_lines(x, lines).withColumn("label", F.get_json_object("value", "$.label").cast("int"))
    return rounded(both.select("label", F.posexplode("x").alias("dim", "v")).groupBy("label", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean")))


# --- weight vectors ------------------------------------------------------------------------------------------------

LABELS = """(select label, dim, avg(x) as x from {DIMS} group by all)"""
FULL = f"""(select label, i, c, sum(b * a) as w from (select label, dim // 2 as i, dim % 2 as k, x as b from {LABELS} where dim < 32) join (select label, (dim - 32) // 16 as k, (dim - 32) % 16 as c, x as a from {LABELS} where dim >= 32) using (label, k) group by all)"""


def label_vectors(spark, d):
    """The labels' mean vectors, read as factors of 16 x 16 modules of rank 2."""
    mean = t.dims(spark, d).groupBy("label", "dim").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("e"))
    columns = F.array(*(F.array(*(F.get("e", F.lit(2 * i + k)) for i in range(16))) for k in range(2)))
    rows = F.array(*(F.slice("e", 33 + 16 * k, 16) for k in range(2)))
    return scratch.written(mean.select("label", F.concat(F.lit("layers."), F.col("label") % 5, F.lit(".q_proj")).alias("module"), columns.alias("b"), rows.alias("a")), "factors")  # a row per label


@query(f"""
select 'layers.' || x.label || '.q_proj' as module, x.i, x.c as j, round(x.w - 0.5 * y.w, 6) as w from {FULL} x join {FULL} y on y.label = x.label + 5 and x.i = y.i and x.c = y.c where x.label < 5
""")
def q_weight_difference(spark, d):
    """Modules of labels 0 to 4 less half of those of 5 to 9, as factors; their entries."""
    own = label_vectors(spark, d)
    x, y = (own.where(F.col("label").between(lo, lo + 4)).drop("label") for lo in (0, 5))
    return rounded(w.entries(w.subtracted(x, w.scaled(y, 0.5))))


@query(f"""
with d as (select x.label as label, x.i, x.c, x.w + y.w as w from {FULL} x join {FULL} y on y.label = x.label + 5 and x.i = y.i and x.c = y.c where x.label < 5)
select count(distinct label) as modules, 4 as max_rank, count(distinct label) * 4 * 32 as parameters, round(sqrt(sum(w * w)), 6) as norm from d
""")
def q_weight_sum(spark, d):
    own = label_vectors(spark, d)
    x, y = (own.where(F.col("label").between(lo, lo + 4)).drop("label") for lo in (0, 5))
    both = w.rank_reduced(w.added(x, y), rank=4)
    return rounded(w.sizes(both).join(F.broadcast(w.norm(both))))  # single rows


# --- presets -------------------------------------------------------------------------------------------------------


def preset_rows(spark, d):
    own = t.load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return own.withColumn("preset", F.when(F.col("user_id") % 13 > 0, F.col("event_type"))), {"ctx_kept": F.col("k") >= 10, "fully_parsed": F.col("user_id") % 7 > 0, "steady": F.col("value") < 90}


PRESETS = r"(select *, case when user_id % 13 > 0 then event_type end as preset, cast(regexp_extract(props, '(\d+)', 1) as int) as k from events)"


@query(f"""
with s0 as (select * from {PRESETS}), s1 as (select * from s0 where k >= 10), s2 as (select * from s1 where user_id % 7 > 0), s3 as (select * from s2 where value < 90),
n as (
  select preset, grouping(preset) = 1 as every, 0 as place, 'all' as stage, count(*) as n from s0 group by grouping sets ((preset), ()) union all select preset, grouping(preset) = 1, 1, 'ctx_kept', count(*) from s1 group by grouping sets ((preset), ())
  union all select preset, grouping(preset) = 1, 2, 'fully_parsed', count(*) from s2 group by grouping sets ((preset), ()) union all select preset, grouping(preset) = 1, 3, 'steady', count(*) from s3 group by grouping sets ((preset), ())),
a as (select preset, grouping(preset) = 1 as every, count(*) as c0, count(*) filter (k >= 10) as c1, count(*) filter (user_id % 7 > 0) as c2, count(*) filter (value < 90) as c3 from s0 group by grouping sets ((preset), ()))
select n.preset, n.every, place, stage, n, case place when 0 then c0 when 1 then c1 when 2 then c2 else c3 end as alone, round(n / c0, 6) as share from n join a on n.preset is not distinct from a.preset and n.every = a.every
""")
def q_preset_funnel(spark, d):
    return rounded(p.funnel(preset_rows(spark, d)[0], "preset", preset_rows(spark, d)[1]))


@query(f"""
with r as (select preset, unnest([{{'score': 'value', 'x': value}}, {{'score': 'k', 'x': k::double}}], recursive := true) from {PRESETS} where k >= 10 and user_id % 7 > 0 and value < 90 and preset is not null),
g as (select score, preset, count(*) as n, avg(x) as m, var_pop(x) as v from r group by all), w as (select score, count(*) as n, var_pop(x) as v from r group by 1)
select g.score, any_value(w.n) as n, count(*) as presets, round(1 - sum(g.n * g.v) / any_value(w.n * w.v), 6) as eta2, 1 - sum(g.n * g.v) / any_value(w.n * w.v) > 0.5 as dominated from g join w on g.score = w.score group by g.score
""")
def q_preset_variance(spark, d):
    rows, filters = preset_rows(spark, d)
    return rounded(p.preset_variance(rows.withColumn("k", F.col("k").cast("double")), "preset", filters, ["value", "k"]))


# --- the kept matrix -----------------------------------------------------------------------------------------------


def raw_responses(spark, d):
    """lineitem as a log of ratings and forced choices; later lines of an order and item say it anew."""
    number = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey") * 50 + F.col("l_quantity").cast("int")
    p1, p5 = F.col("l_discount").cast("double") + 0.05, F.col("l_tax").cast("double") + 0.4
    pair = F.col("l_linenumber") % 2 == 0
    return t.load(spark, d, "lineitem").select(
        number.cast("long").alias("seq"), F.col("l_orderkey").alias("k"), F.when(pair, "pair").otherwise("rating").alias("item_id"), F.when(pair, "fc_pair").otherwise("likert").alias("item_type"),
        F.when(F.col("l_partkey") % 5 == 0, F.when(pair, "B").otherwise("2")).alias("parsed_choice"), F.when(F.col("l_partkey") % 5 > 0, F.when(pair, F.create_map(F.lit("A"), p1, F.lit("B"), p5)).otherwise(F.create_map(F.lit("1"), p1, F.lit("5"), p5))).alias("probs"),
        F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity").cast("double") / 50).alias("choice_mass"), (F.col("l_returnflag") == "R").alias("reverse_keyed"), F.lit("B").alias("high_option"), F.lit(None).cast("map<string,double>").alias("mapping"), F.lit(5).alias("scale"),
        F.lit(None).cast("map<string,map<string,double>>").alias("scoring"),
    )


@query("""
with r as (
  select l_orderkey as k, case when l_linenumber % 2 = 0 then 'pair' else 'rating' end as item_id, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 100000 + l_suppkey * 50 + l_quantity::int as seq, l_partkey % 5 > 0 as soft, l_discount::double + 0.05 as p1, l_tax::double + 0.4 as p5, l_returnflag = 'R' as turned, l_quantity / 50 as mass from lineitem),
l as (select * from r qualify row_number() over (partition by k, item_id order by seq desc) = 1)
select item_id, count(*) as n, count(value) as filled, round(avg(value), 6) as mean from (
  select item_id, case when soft and mass < 0.75 then null when item_id = 'pair' then case when soft then 2 * p5 - 1 else 0 end else case when turned then 6 - x else x end end as value
  from (select *, case when soft then p1 + 5 * p5 else 2 end as x from l)) group by item_id
""")
def q_matrix_kept(spark, d):
    """The matrix of version 5 after three batches that come out of order, the second one twice."""
    root, log = scratch.fresh_path(spark, "matrix"), raw_responses(spark, d)
    for number, part in ((1, 2), (2, 0), (3, 0), (4, 1)):
        m.update(spark, root, 5, log.where(F.col("k") % 3 == part), number)
    return rounded(m.current(spark, root, 5).groupBy("item_id").agg(F.count("*").alias("n"), F.count("value").alias("filled"), F.avg("value").alias("mean")))
