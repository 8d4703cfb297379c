"""Queries over messages and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import logprobs as lp
from ..functions import stats, text
from ..operators import messages as m
from ..sources import tables as t
from .catalogue import query


@query("""
select sample_id, turn_index, coalesce(lag(content) over (partition by sample_id order by turn_index), '') as question, length(content) as n_chars from {MESSAGES}
""")
def q_preceding_message(spark, d):
    return m.with_question(t.messages(spark, d)).select("sample_id", "turn_index", "question", F.length("content").cast("long").alias("n_chars"))


@query("""
select sample_id, turn_index, last_user from (
  select *, last_value(case when role = 'user' then content end ignore nulls) over (partition by sample_id order by turn_index rows between unbounded preceding and 1 preceding) as last_user from {MESSAGES}) where role = 'assistant'
""")
def q_preceding_user(spark, d):
    return m.with_last_user(t.messages(spark, d)).select("sample_id", "turn_index", "last_user")


@query("""
select sample_id, turn_index, cast(case when role = 'system' then -1 else coalesce(sum(cast(role in ('user', 'assistant') as int)) over (partition by sample_id order by turn_index rows between unbounded preceding and 1 preceding), 0) end as bigint) as turn_number from {MESSAGES}
""")
def q_turn_index(spark, d):
    return m.with_turn_number(t.messages(spark, d)).select("sample_id", "turn_index", "turn_number")


@query("""
select sample_id, position, row_number() over (partition by sample_id order by half, case source_stage when 'seed' then 0 when 'rollout_assistant' then 1 else 2 end, position) as message_order
from (select *, turn_index as position, cast(turn_index // 2 as bigint) as half from {MESSAGES})
""")
def q_message_order(spark, d):
    halves = t.messages(spark, d).withColumn("position", F.col("turn_index")).withColumn("turn_index", F.floor(F.col("turn_index") / 2))
    return m.with_order(halves, "position").select("sample_id", "position", "message_order")


@query("""
with a as (select sample_id, turn_index, row_number() over (partition by sample_id order by turn_index) as up, row_number() over (partition by sample_id order by turn_index desc) as down from {MESSAGES} where role = 'assistant')
select sample_id, turn_index, 'first' as which from a where up = 1 union all select sample_id, turn_index, 'final' from a where down = 1
""")
def q_first_last_assistant(spark, d):
    own = t.messages(spark, d)
    pick = lambda which: m.assistant_turns(own, which).select("sample_id", "turn_index", F.lit(which).alias("which"))
    return pick("first").unionByName(pick("final"))


@query("""
select sample_id, arg_max(content, turn_index) filter (role = 'user') as last_user, arg_max(content, turn_index) filter (role = 'assistant') as last_assistant from {MESSAGES} group by sample_id
""")
def q_last_by_role(spark, d):
    return m.last_by_role(t.messages(spark, d))


@query("""
with m as (select sample_id, turn_index, case when role = 'user' and turn_index > 1 and length(content) % 3 = 0 then 'assistant' else role end as role from {MESSAGES})
select distinct sample_id from (select sample_id, role, lag(role) over (partition by sample_id order by turn_index) as before from m) where role = 'assistant' and before = 'assistant'
""")
def q_consecutive_assistant(spark, d):
    wrong = (F.col("role") == "user") & (F.col("turn_index") > 1) & (F.length("content") % 3 == 0)
    return m.consecutive_assistants(t.messages(spark, d).withColumn("role", F.when(wrong, "assistant").otherwise(F.col("role"))))


@query("""
select sample_id, turn_index, role from (select *, max(case when source_stage <> 'seed' then turn_index end) over (partition by sample_id) as last from {MESSAGES}) where role = 'assistant' and turn_index between last - 1 and last
""")
def q_selector_last_turns(spark, d):
    return m.select_messages(t.messages(spark, d), roles=["assistant"], turns=(-2, -1)).select("sample_id", "turn_index", "role")


@query("select sample_id, turn_index, role from {MESSAGES} where turn_index between 1 and 3 and source_stage <> 'seed'")
def q_selector_range(spark, d):
    return m.select_messages(t.messages(spark, d), turns=(1, 3), exclude_seed=True).select("sample_id", "turn_index", "role")


@query("""
with n as (select sample_id, list(content order by turn_index) as c from {MESSAGES} group by sample_id)
select sample_id, cast(len(c) // 2 as bigint) as total_turns, cast(least(len(c), 4) as bigint) as n_kept, c[greatest(len(c) - 3, 1)] as first_kept from n
""")
def q_recent_turns(spark, d):
    kept = m.recent_turns(m.whole_conversations(t.messages(spark, d)), 2)
    return kept.select("sample_id", "total_turns", F.size("messages").cast("long").alias("n_kept"), F.get("messages", F.lit(0))["content"].alias("first_kept"))


@query("""
select sample_id, turn_index, n, md5(texts) as prefix_md5 from (
  select sample_id, turn_index, role, count(*) over w as n, string_agg(role || ':' || content, chr(10)) over w as texts from {MESSAGES} window w as (partition by sample_id order by turn_index rows between unbounded preceding and current row)) where role = 'assistant'
""")
def q_prefix_slices(spark, d):
    whole = F.array_join(F.transform("prefix", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return m.prefix_slices(t.messages(spark, d)).select("sample_id", "turn_index", F.size("prefix").cast("long").alias("n"), F.md5(whole).alias("prefix_md5"))


@query("""
with f as (select sample_id, turn_index, case role when 'user' then 'assistant' when 'assistant' then 'user' else role end as role, row_number() over (partition by sample_id order by turn_index) as place from {MESSAGES})
select sample_id, string_agg(role, ',' order by turn_index) as roles, count(*) as n from f where not (place = 1 and role = 'assistant') group by sample_id
""")
def q_flipped_roles(spark, d):
    turned = m.flipped(m.whole_conversations(t.messages(spark, d))).where(F.size("messages") > 0)
    return turned.select("sample_id", F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"), F.size("messages").cast("long").alias("n"))


@query("""
with n as (select *, sum(cast(role = 'user' and before is distinct from 'user' as int)) over (partition by sample_id order by turn_index) as turn from (
  select *, last_value(case when role <> 'system' then role end ignore nulls) over (partition by sample_id order by turn_index rows between unbounded preceding and 1 preceding) as before from {MESSAGES})),
l as (select sample_id, turn_index, case when role = 'system' then '[system]' else '[turn ' || turn || ' ' || role || ']' end || chr(10) || case when length(content) > 80 then substring(content, 1, 80) || '... [truncated, ' || length(content) || ' chars total]' else content end || chr(10) as line from n)
select sample_id, trim(string_agg(line, chr(10) order by turn_index), chr(10) || ' ') as transcript from l group by sample_id
""")
def q_transcript(spark, d):
    spoken = F.when(F.col("role") != "system", F.col("role"))
    own = t.messages(spark, d).withColumn("before", F.last(spoken, ignorenulls=True).over(m.before()))
    turn = F.sum(((F.col("role") == "user") & ~F.col("before").eqNullSafe("user")).cast("int")).over(m.by_sample())
    label = F.when(F.col("role") == "system", "[system]").otherwise(F.concat(F.lit("[turn "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("]")))
    lines = own.withColumn("turn", turn).withColumn("line", F.concat(label, F.lit("\n"), text.clipped(F.col("content"), 80), F.lit("\n")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("sample_id").agg(F.trim(joined, F.lit("\n ")).alias("transcript"))


@query("""
select sample_id, count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant, count(*) filter (role = 'system') as n_system, cast(sum(length(content)) as bigint) as n_chars from {MESSAGES} group by sample_id
""")
def q_rollout_stats(spark, d):
    return m.rollout_stats(t.messages(spark, d))


@query("""
with s as (select sample_id, cast(sum(length(content)) as bigint) as n_chars from {MESSAGES} group by sample_id)
select round(avg(n_chars), 6) as mean, quantile_cont(n_chars, 0.5) as median, quantile_cont(n_chars, 0.9) as p90, max(n_chars) as max, round(avg(cast(n_chars < 500 as double)), 6) as frac_under_500, round(avg(cast(n_chars < 2000 as double)), 6) as frac_under_2000 from s
""")
def q_stats_summary(spark, d):
    out = m.stats_summary(m.rollout_stats(t.messages(spark, d)), "n_chars", (500, 2000))
    return out.select(*(F.round(c, 6).alias(c) if c not in ("median", "p90", "max") else c for c in out.columns))


# --- texts ---------------------------------------------------------------------------------------------------------


@query("""
select doc_id, cast(length(replace(lower(text), 'o', '')) as bigint) as n_other, cast(length(text) - length(replace(lower(text), 'o', '')) as bigint) as n_found from documents
""")
def q_char_counter(spark, d):
    n = text.count_substring(F.col("text"), "o")
    return t.load(spark, d, "documents").select("doc_id", (F.length("text") - n).cast("long").alias("n_other"), n.alias("n_found"))


@query(r"select doc_id, cast(len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}_]', '  ', 'g') || ' ', ' the ')) as bigint) as n_found from documents")
def q_word_counter(spark, d):
    return t.load(spark, d, "documents").select("doc_id", text.count_word(F.col("text"), "the").alias("n_found"))


@query(r"""
select doc_id, round(coalesce(len(regexp_extract_all(text, '\p{Ll}')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 0), 6) as density from documents
""")
def q_lowercase_density(spark, d):
    return t.load(spark, d, "documents").select("doc_id", F.round(text.lowercase_density(F.col("text")), 6).alias("density"))


@query(r"""
select doc_id, round(coalesce(len(regexp_extract_all(text, '[[:punct:]]')) / nullif(len(regexp_extract_all(text, '\S')), 0), 0), 6) as density from documents
""")
def q_punctuation_density(spark, d):
    return t.load(spark, d, "documents").select("doc_id", F.round(text.punctuation_density(F.col("text")), 6).alias("density"))


@query(r"""
select doc_id, md5(translate(text, 'aeiouAEIOU', 'eiouaEIOUA')) as shifted_md5, md5(regexp_replace(lower(text), '[[:punct:]]', '', 'g')) as stripped_md5 from documents
""")
def q_edited_texts(spark, d):
    own = t.load(spark, d, "documents")
    return own.select("doc_id", F.md5(text.shift_vowels(F.col("text"))).alias("shifted_md5"), F.md5(text.strip_punctuation(F.col("text"))).alias("stripped_md5"))


@query("select p_partkey, reverse(p_name) as reversed, trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def q_names(spark, d):
    return t.load(spark, d, "part").select("p_partkey", F.reverse("p_name").alias("reversed"), text.slug(F.concat("p_type", F.lit(" / "), "p_name")).alias("slug"))


#: Replies in many forms, made from lineitem.
REPLY = "case l_orderkey % 8 when 0 then 'ANSWER: ' || @ when 1 then chr(10) || chr(9) || @ || ') because' when 2 then @ || chr(10) || 'I am not sure' when 3 then 'The correct answer is ' || @ || '.' when 4 then 'I think ' || @ || ') is the correct answer' when 5 then 'answer : ' || lower(@) when 6 then 'no idea' else 'So it is ' || @ end"
LETTER = "chr(cast(65 + l_linenumber % 6 as int))"


def replies(spark, d):
    return t.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.expr(REPLY.replace("@", LETTER)).alias("reply"))


SQL_REPLIES = f"(select *, {LETTER} as c from lineitem)"
PARSED = "case when c > 'E' or l_orderkey % 8 in (6, 7) then null else c end"


@query(f"""
select l_orderkey, l_linenumber, count(*) as n, min(case when a <= 'D' then a end) as letter from (select *, {PARSED} as a from {SQL_REPLIES}) group by all
""")
def q_parse_answer(spark, d):
    own = replies(spark, d).withColumn("a", text.parse_answer(F.col("reply"), "ABCD"))
    return own.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("a").alias("letter"))


@query(f"""
select c as told, reply_kind, count(*) as n, count(case when c <= 'D' and reply_kind in (0, 1, 2, 3, 5) then 1 end) as n_parsed from (select *, cast(l_orderkey % 8 as integer) as reply_kind from {SQL_REPLIES}) group by all
""")
def q_parse_choice(spark, d):
    own = replies(spark, d).withColumn("a", text.parse_choice(F.col("reply")))
    return own.groupBy(F.expr(LETTER).alias("told"), (F.col("l_orderkey") % 8).cast("int").alias("reply_kind")).agg(F.count("*").alias("n"), F.count("a").alias("n_parsed"))


@query("""
select cast(l_orderkey % 5 as integer) as form, l_linenumber, cast(case when l_orderkey % 5 = 4 then 5 when l_linenumber between 1 and 5 then l_linenumber end as integer) as rating, count(*) as n from lineitem group by all
""")
def q_parse_rating(spark, d):
    form = (F.col("l_orderkey") % 5).cast("int")
    n = F.col("l_linenumber").cast("string")
    reply = F.when(form == 0, n).when(form == 1, F.concat(F.lit("**"), n, F.lit("** - somewhat"))).when(form == 2, F.concat(F.lit("\n I would rate this a "), n)).when(form == 4, F.concat(F.lit("Of 5 options I rate it\n"), n)).otherwise(F.concat(F.lit("about "), n, F.lit(", maybe")))
    own = t.load(spark, d, "lineitem").select(form.alias("form"), "l_linenumber", text.parse_rating(reply).alias("rating"))
    return own.groupBy("form", "l_linenumber", "rating").agg(F.count("*").alias("n"))


NUMBERS = "(select p_size % 5 as form, p_size // 5 + 1 as whole, p_partkey % 100 as cents, p_partkey % 3 = 0 as below, count(*) as n from part group by all)"


@query(f"""
select name, kind, scale, case when scale is not null then (case when scale < 0 then '-' else '+' end) || printf('%.2f', abs(scale)) end as shown, n from (
  select case form when 0 then 'base' when 1 then 'lora_' || sign || whole || 'p' || lpad(cents::varchar, 2, '0') || 'x' when 2 then 'lora_' || sign || whole || 'x' when 3 then 'cap_' || sign || whole || 'p' || lpad(cents::varchar, 2, '0') else 'run_' || whole || 'x' end as name, kind,
    case when form = 0 then 0.0 when form = 1 and kind = 'lora' or form = 3 and kind = 'cap' then f * (whole + cents / 100.0) when form = 2 and kind = 'lora' then f * whole end::double as scale, sum(n)::bigint as n
  from (select *, case when below then '-' else '+' end as sign, case when below then -1.0 else 1.0 end as f from {NUMBERS}), (values ('lora'), ('cap')) k(kind) group by all)
""")
def q_parse_scale(spark, d):
    """Names of models and of caps made of sizes and keys of parts, read by either parser."""
    whole, cents, sign, form = F.expr("p_size div 5 + 1").cast("string"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("+"), F.col("p_size") % 5
    name = (
        F.when(form == 0, "base").when(form == 1, F.concat(F.lit("lora_"), sign, whole, F.lit("p"), cents, F.lit("x"))).when(form == 2, F.concat(F.lit("lora_"), sign, whole, F.lit("x"))).when(form == 3, F.concat(F.lit("cap_"), sign, whole, F.lit("p"), cents))
        .otherwise(F.concat(F.lit("run_"), whole, F.lit("x")))
    )
    names = t.load(spark, d, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    read = names.select("name", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), f(F.col("name")).alias("scale")) for k, f in (("lora", text.parse_scale), ("cap", text.parse_cap))))).alias("x")).select("name", "x.kind", "x.scale", "n")
    return read.withColumn("shown", F.when(F.col("scale").isNotNull(), text.format_scale(F.col("scale"))))


@query(f"""
select l_returnflag as trait, round(avg(case when l_linenumber % 2 = 0 then (5 - v) / 4 else v / 4 end), 6) as score, count(v) as n_parsed, count(*) as n_total, round(count(v) / count(*), 6) as parse_rate
from (select *, cast(ascii(case when {PARSED} <= 'D' then {PARSED} end) - 64 as double) as v from {SQL_REPLIES}) group by 1
""")
def q_rescore(spark, d):
    mapping = F.create_map(*(F.lit(x) for x in ("A", 1, "B", 2, "C", 3, "D", 4)))
    letter = text.parse_answer(F.col("reply"), "ABCD")
    own = replies(spark, d).withColumn("s", lp.answer_score(letter, mapping, F.col("l_linenumber") % 2 == 0))
    return own.groupBy(F.col("l_returnflag").alias("trait")).agg(F.round(F.avg("s"), 6).alias("score"), F.count("s").alias("n_parsed"), F.count("*").alias("n_total"), F.round(F.try_divide(F.count("s"), F.count("*")), 6).alias("parse_rate"))


@query(f"""
select coalesce(a, 'none') as letter, count(*) as n, round(case when a is null then 0 else count(*) / sum(count(*)) filter (a is not null) over () end, 6) as share from (select {PARSED} as a from {SQL_REPLIES}) group by a
""")
def q_letter_histogram(spark, d):
    """Replies are parsed once; the window is over a row per letter."""
    own = replies(spark, d).select(text.parse_answer(F.col("reply"), "ABCDE").alias("a"))
    counts = own.groupBy("a").agg(F.count("*").alias("n"))
    valid = F.sum(F.when(F.col("a").isNotNull(), F.col("n"))).over(W.partitionBy())
    return counts.select(F.coalesce("a", F.lit("none")).alias("letter"), "n", F.round(F.when(F.col("a").isNull(), 0.0).otherwise(F.col("n") / valid), 6).alias("share"))


# --- log-probabilities ---------------------------------------------------------------------------------------------

PARTS = {"A": "-l_quantity / 50", "B": "-l_discount * 10", "▁A": "-l_quantity / 20", "C": "-l_tax * 10", "x": "-0.5", "b": "-3.0"}
SQL_PARTS = "(select l_orderkey, l_linenumber, l_returnflag, -l_quantity / 50 as a, -l_discount * 10 as b, -l_tax * 10 as c, -l_quantity / 20 as a2 from lineitem)"


def top_tokens(spark, d):
    tokens = F.array(*(F.struct(F.lit(k).alias("token"), F.expr(v).cast("double").alias("logprob")) for k, v in PARTS.items()))
    return t.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", tokens.alias("top"))


@query(f"""
select l_returnflag, count(*) as n, round(avg(exp(a) / (exp(a) + exp(b) + exp(c))), 6) as p_a, round(avg(exp(b) / (exp(a) + exp(b) + exp(c))), 6) as p_b, round(avg((exp(a) + 2 * exp(b) + 4 * exp(c)) / (exp(a) + exp(b) + exp(c)) / 4), 6) as score, round(avg(exp(a) + exp(b) + exp(c)), 6) as mass from {SQL_PARTS} group by 1
""")
def q_softmax_choices(spark, d):
    own = top_tokens(spark, d).withColumn("lp", lp.choice_struct(F.col("top"))).withColumn("p", lp.softmax_struct(F.col("lp")))
    present = lambda v: F.coalesce(v, F.lit(0.0))
    score = sum((present(F.col("p")[c]) * v for c, v in (("A", 1), ("B", 2), ("C", 4))), F.lit(0.0)) / 4
    mass = sum((present(F.exp(F.col("lp")[c])) for c in "ABCD"), F.lit(0.0))
    return own.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("p")["A"]), 6).alias("p_a"), F.round(F.avg(F.col("p")["B"]), 6).alias("p_b"), F.round(F.avg(score), 6).alias("score"), F.round(F.avg(mass), 6).alias("mass")
    )


@query(f"""
select l_returnflag, round(avg(exp(a) + exp(a2)), 6) as p_a, round(avg(exp(b) + exp(-3.0)), 6) as p_b, round(avg(exp(a) + exp(a2) + exp(b) + exp(-3.0) + exp(c)), 6) as mass from {SQL_PARTS} group by 1
""")
def q_summed_choices(spark, d):
    own = top_tokens(spark, d).withColumn("p", lp.choice_probs(F.col("top")))
    return own.groupBy("l_returnflag").agg(F.round(F.avg(F.col("p")["A"]), 6).alias("p_a"), F.round(F.avg(F.col("p")["B"]), 6).alias("p_b"), F.round(F.avg(lp.total(F.col("p"))), 6).alias("mass"))


@query(f"""
select l_returnflag, round(avg(2 * p - 1), 6) as pair_code, round(avg(ln(least(greatest(p, 0.005), 0.995) / (1 - least(greatest(p, 0.005), 0.995)))), 6) as logit, round(avg(6 - (exp(a) + 2 * exp(b) + 5 * exp(c)) / (exp(a) + exp(b) + exp(c))), 6) as rating from (select *, exp(a) / (exp(a) + exp(b)) as p from {SQL_PARTS}) group by 1
""")
def q_encoded_responses(spark, d):
    digits = F.array(*(F.struct(F.lit(k).alias("token"), F.expr(PARTS[v]).cast("double").alias("logprob")) for k, v in (("1", "A"), (" 2", "B"), ("▁5", "C"))))
    own = t.load(spark, d, "lineitem").withColumn("digits", digits).withColumn("p", F.expr("exp(-l_quantity / 50) / (exp(-l_quantity / 50) + exp(-l_discount * 10))"))
    return own.groupBy("l_returnflag").agg(F.round(F.avg(lp.pair_code(F.col("p"))), 6).alias("pair_code"), F.round(F.avg(lp.logit(F.col("p"))), 6).alias("logit"), F.round(F.avg(lp.expected_rating(lp.digit_probs(F.col("digits")), 5, F.lit(True))), 6).alias("rating"))


@query("""
select role, round(avg(n), 6) as mean, quantile_cont(n, 0.5) as median, min(n) as min, max(n) as max, round(coalesce(stddev_samp(n), 0), 6) as stdev from (select role, cast(length(content) as bigint) as n from {MESSAGES}) group by role
""")
def q_metric_aggregate(spark, d):
    own = t.messages(spark, d).withColumn("n", F.length("content").cast("long"))
    return own.groupBy("role").agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.min("n").alias("min"), F.max("n").alias("max"), F.round(stats.std("n", 1), 6).alias("stdev"))


@query("""
select coalesce(role, 'all') as role, coalesce(source_stage, 'all') as source_stage, count(*) as n, round(avg(length(content)), 6) as mean, round(coalesce(stddev_pop(length(content)), 0), 6) as std from {MESSAGES} group by grouping sets ((), (source_stage, role))
""")
def q_prompt_role_aggregate(spark, d):
    own = t.messages(spark, d).withColumn("n_chars", F.length("content"))
    sets = own.groupingSets([[], ["source_stage", "role"]], "source_stage", "role")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(stats.std("n_chars", 0), 6).alias("std")).select(F.coalesce("role", F.lit("all")).alias("role"), F.coalesce("source_stage", F.lit("all")).alias("source_stage"), "n", "mean", "std")
