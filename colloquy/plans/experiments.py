"""Queries over experiment tables: pairs, cells, event logs, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as x
from ..operators import judging as j
from ..sources import tables as t
from .catalogue import query
from .judging import rounded

AMP = "(select o_custkey as prompt, o_orderkey as seq, case when o_orderkey % 7 = 0 then null else o_orderpriority || ':' || o_orderkey end as response from orders where o_orderstatus = 'F')"
SUP = AMP.replace("'F'", "'O'").replace("% 7", "% 11")


def teacher(spark, d, status, gap):
    own = t.load(spark, d, "orders").where(F.col("o_orderstatus") == status)
    reply = F.when(F.col("o_orderkey") % gap != 0, F.concat("o_orderpriority", F.lit(":"), F.col("o_orderkey").cast("string")))
    return own.select(F.col("o_custkey").alias("prompt"), F.col("o_orderkey").alias("seq"), reply.alias("response"))


def teachers(spark, d):
    return teacher(spark, d, "F", 7), teacher(spark, d, "O", 11)


@query(f"""
with f as (select prompt, arg_min(row(response), seq) as r from {AMP} group by prompt)
select s.prompt, struct_extract(f.r, 1) as chosen, s.response as rejected from {SUP} s join f using (prompt) where s.response is not null and struct_extract(f.r, 1) is not null
""")
def q_pair_first(spark, d):
    return x.preference_pairs(*teachers(spark, d))


@query(f"select s.prompt, s.response as chosen, a.response as rejected from {SUP} s join {AMP} a using (prompt) where s.response is not null and a.response is not null")
def q_pair_all(spark, d):
    return x.preference_pairs(*teachers(spark, d), pairing="all", direction="sup")


@query(f"select prompt, seq, response from {SUP} s where response is null or not exists (select 1 from {AMP} a where a.prompt = s.prompt)")
def q_pair_unmatched(spark, d):
    return x.unmatched(*teachers(spark, d))


@query("""
with c as (select nullif(l_linenumber % 4, 0) as a, nullif(l_suppkey % 3, 0) as b, l_returnflag as metric, avg(l_quantity) as score from lineitem group by all)
select p.a, cast(p.b as bigint) as b, p.metric, round(p.score - one.score - two.score + base.score, 6) as residual from c p left join c one on one.a = p.a and one.b is null and one.metric = p.metric left join c two on two.a is null and two.b = p.b and two.metric = p.metric left join c base on base.a is null and base.b is null and base.metric = p.metric where p.a is not null and p.b is not null
""")
def q_additivity_residuals(spark, d):
    off = lambda c, n: F.nullif(F.col(c) % n, F.lit(0))
    cells = t.load(spark, d, "lineitem").groupBy(off("l_linenumber", 4).alias("a"), off("l_suppkey", 3).alias("b"), F.col("l_returnflag").alias("metric")).agg(F.avg("l_quantity").alias("score"))
    return rounded(x.additivity_residuals(cells))


@query("""
with m as (select rater, avg(score) as s from {JUDGE} group by 1), b as (select avg(score) as b from {JUDGE})
select rater, round(case when s >= b then (s - b) / (4 - b) else (s - b) / (b + 4) end, 6) as share from m, b
""")
def q_headroom(spark, d):
    own = t.judge(spark, d)
    base = own.agg(F.avg("score").alias("b"))
    means = own.groupBy("rater").agg(F.avg("score").alias("s")).join(F.broadcast(base))
    return rounded(means.select("rater", x.headroom(F.col("s") - F.col("b"), F.col("b"), -4.0, 4.0).alias("share")))


@query("""
with c as (select distinct case when a <> 0 then 'a' || printf('%+.1f', a) else '' end || case when b <> 0 then 'b' || printf('%+.1f', b) else '' end as cell, cast(a <> 0 as int) + cast(b <> 0 as int) as n from (select (l_linenumber % 4 - 2) / 2 as a, (l_suppkey % 3 - 1) / 2 as b from lineitem))
select cell, case n when 0 then 'baseline' when 1 then 'single' else 'combo' end as tier from c
""")
def q_enumerate_cells(spark, d):
    one = lambda name, c: F.struct(F.lit(name).alias("adapter"), c.cast("double").alias("scale"))
    grid = t.load(spark, d, "lineitem").select(((F.col("l_linenumber") % 4 - 2) / 2).alias("a"), ((F.col("l_suppkey") % 3 - 1) / 2).alias("b")).distinct()
    cells = x.canonical_cells(grid.select(F.array(one("a", F.col("a")), one("b", F.col("b"))).alias("cell")))
    return cells.select(F.array_join(F.transform("cell", lambda c: F.concat(c["adapter"], F.format_string("%+.1f", c["scale"]))), "").alias("cell"), "tier")


@query("select event_id, user_id from events e where exists (select 1 from customer c where c.c_custkey = e.user_id and c_mktsegment = 'BUILDING')")
def q_known_events(spark, d):
    known = t.load(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    return t.load(spark, d, "events").select("event_id", "user_id").join(known, "user_id", "left_semi")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def q_not_yet_done(spark, d):
    done = t.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.load(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""
with m as (select user_id, avg(value) filter (event_type = 'click') as a, avg(value) filter (event_type = 'view') as b from events group by 1)
select count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(avg(a - b) / stddev_samp(a - b), 6) as dz from m where a is not null and b is not null
""")
def q_source_separation(spark, d):
    own = t.load(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    wide = own.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value")).dropna()
    gap = F.col("click") - F.col("view")
    return rounded(wide.agg(F.count("*").alias("n"), F.avg("click").alias("mean_a"), F.avg("view").alias("mean_b"), F.try_divide(F.avg(gap), F.stddev_samp(gap)).alias("dz")))


@query("""
with p as (select user_id, avg(value) filter (event_type = 'click') as base, avg(value) filter (event_type = 'view') as treated from events group by 1), k as (select * from p where base is not null and treated is not null), q as (select quantile_cont(base, 1 / 3.0) as q1, quantile_cont(base, 2 / 3.0) as q2 from k)
select case when base <= q1 then 'low' when base <= q2 then 'medium' else 'high' end as bucket, count(*) as n, round(avg(treated - base), 6) as shift from k, q group by 1
""")
def q_bucket_shifts(spark, d):
    own = t.load(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value")).dropna()
    q = F.percentile("click", F.array(F.lit(1 / 3), F.lit(2 / 3)))
    cut = own.join(F.broadcast(own.agg(q[0].alias("q1"), q[1].alias("q2"))))
    bucket = F.when(F.col("click") <= F.col("q1"), "low").when(F.col("click") <= F.col("q2"), "medium").otherwise("high")
    return rounded(cut.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("view") - F.col("click")).alias("shift")))


# --- event logs ----------------------------------------------------------------------------------------------------


@query("select sample_id, phase, arg_max(status, seq) as status, arg_max(value, seq) as value, max(seq) as seq from {LOG} group by all")
def q_last_write_wins(spark, d):
    return x.last_write(t.log(spark, d).drop("attempt", "props"), ["sample_id", "phase"])


@query(r"""
select sample_id, cast(arg_max(cast(regexp_extract(props, '(\d+)', 1) as bigint), seq) as bigint) as k, null::varchar as note, count(*) as n_events from {LOG} group by 1
""")
def q_fold(spark, d):
    return x.shallow_merge(t.log(spark, d), "sample_id", {"k": "bigint", "note": "string"})


STATES = "(select sample_id, phase, attempt, case when bool_or(status = 'success') then 'success' when bool_and(status = 'failed') then 'failed' else 'pending' end as status, max(attempt) as attempts from {LOG} group by sample_id, phase, attempt)"


def states(spark, d):
    return x.variant_status(t.log(spark, d), "sample_id", "phase", "attempt")


@query(f"select sample_id, phase, attempt, status, attempts from {STATES}")
def q_variant_status(spark, d):
    return states(spark, d)


@query(f"select state, phase, count(*) as n, count_if(state = 'pending' and status = 'failed') as n_failed from (select *, case when status = 'success' then 'complete' when attempts >= 4 then 'terminal' else 'pending' end as state from {STATES}) group by all")
def q_resume_state(spark, d):
    return x.resume_state(states(spark, d), 4).groupBy("state", "phase").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"))


@query("select sample_id, phase, attempt, seq, value from (select *, row_number() over (partition by sample_id, phase order by attempt desc, seq desc) as k from {LOG} where status = 'success') where k = 1")
def q_latest_overlay(spark, d):
    return x.latest_success(t.log(spark, d), "sample_id", "phase")


@query("""
with o as (select sample_id, phase, seq, value, row_number() over (partition by sample_id order by attempt desc, seq desc) as k from {LOG} where status = 'success')
select m.sample_id, turn_index, md5(case when turn_index = 1 and o.seq is not null then 'edit ' || o.seq else content end) as content_md5 from {MESSAGES} m left join o on o.sample_id = m.sample_id and k = 1
""")
def q_rendered(spark, d):
    latest = x.latest_success(t.log(spark, d), "sample_id").select("sample_id", F.lit(1).cast("long").alias("turn_index"), F.concat(F.lit("edit "), F.col("seq").cast("string")).alias("edited"))
    return x.rendered(t.messages(spark, d), latest).select("sample_id", "turn_index", F.md5("content").alias("content_md5"))


@query("""
select sample_id, phase, max(attempt) as attempts, count_if(status = 'failed') as n_failed, bool_or(status = 'failed') and not bool_or(status = 'success') as turn_failed from {LOG} group by all
""")
def q_attempts(spark, d):
    failed, good = F.bool_or(F.col("status") == "failed"), F.bool_or(F.col("status") == "success")
    return t.log(spark, d).groupBy("sample_id", "phase").agg(F.max("attempt").alias("attempts"), F.count_if(F.col("status") == "failed").alias("n_failed"), (failed & ~good).alias("turn_failed"))


# --- samples and sets ----------------------------------------------------------------------------------------------


@query("select doc_id, source from documents order by md5('7:' || doc_id), doc_id limit 50")
def q_hash_sample(spark, d):
    return x.hash_sample(t.load(spark, d, "documents").select("doc_id", "source"), 50, 7, "doc_id")


@query("select doc_id, source from (select *, row_number() over (partition by source order by doc_id) as k from documents) where k <= 3")
def q_first_per_group(spark, d):
    return x.first_per_group(t.load(spark, d, "documents").select("doc_id", "source"), "source", 3, "doc_id")


@query("""
with g as (select lang, row_number() over (order by lang) as r, count(*) over () as n from (select distinct lang from documents))
select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('3:' || doc_id), doc_id) as k from documents) join g using (lang) where k <= 50 // n + cast(r <= 50 % n as int)
""")
def q_stratified_sample(spark, d):
    return x.stratified_sample(t.load(spark, d, "documents").select("doc_id", "lang"), "lang", 50, 3, "doc_id")


@query("select doc_id, source, depth from (select doc_id, source, cast(row_number() over (partition by source order by doc_id) as integer) as depth from documents) order by depth, source limit 25")
def q_round_robin(spark, d):
    return x.round_robin(t.load(spark, d, "documents").select("doc_id", "source"), "source", 25, "doc_id")


@query("""
select doc_id, case when row_number() over (partition by lang, source order by md5('5:' || doc_id), doc_id) <= greatest(1, least(n - 1, round(n * 0.3))) then 'A' else 'B' end as side from (select *, count(*) over (partition by lang, source) as n from documents)
""")
def q_stratified_halves(spark, d):
    return x.halves(t.load(spark, d, "documents").select("doc_id", "lang", "source"), 0.3, 5, ["lang", "source"], "doc_id").select("doc_id", "side")


@query("select vec_id, label from (select *, row_number() over (partition by label order by vec_id) as k from embeddings) where label = 1 and k <= 5 or label = 2 and k <= 3")
def q_source_mix(spark, d):
    own = t.load(spark, d, "embeddings").select("vec_id", "label", F.col("label").cast("string").alias("name"))
    return x.mix(own, "name", {"1": 5, "2": 3}, "vec_id").select("vec_id", "label")


@query("select dataset_source, count(*) as n, min(id) as lowest from (select 'docs' as dataset_source, 'docs::' || doc_id as id from documents union all select 'pages', 'pages::' || page_id from pages) group by 1")
def q_union_sources(spark, d):
    both = x.union_sources({"docs": t.load(spark, d, "documents").select(F.col("doc_id").alias("id")), "pages": t.load(spark, d, "pages").select(F.col("page_id").alias("id"), "url")}, "id")
    return both.groupBy("dataset_source").agg(F.count("*").alias("n"), F.min("id").alias("lowest"))


@query("select response_id from {JUDGE} where rater = 'view' and score > 3 intersect select response_id from {JUDGE} where rater = 'click' and score > 3")
def q_intersect_ids(spark, d):
    of = lambda r: t.judge(spark, d).where((F.col("rater") == r) & (F.col("score") > 3)).select("response_id")
    return of("view").intersect(of("click"))


@query("select doc_id from documents except select doc_id from labels order by doc_id limit 5")
def q_except_ids(spark, d):
    ids = lambda n: t.load(spark, d, n).select("doc_id")
    return ids("documents").join(ids("labels"), "doc_id", "left_anti").distinct().orderBy("doc_id").limit(5)


@query("select md5(text) as text_md5, count(*) as n from documents group by 1 having count(*) > 1")
def q_duplicates(spark, d):
    return x.duplicates(t.load(spark, d, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


@query("select rater, count(*) as n from {JUDGE} j where status <> 'call_error' and not exists (select 1 from labels l where l.doc_id = j.response_id) group by rater")
def q_unlabelled_replies(spark, d):
    known = t.load(spark, d, "labels").select(F.col("doc_id").alias("response_id"))
    return j.scored(t.judge(spark, d)).join(known, "response_id", "left_anti").groupBy("rater").agg(F.count("*").alias("n"))
