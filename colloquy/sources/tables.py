"""The given tables in the shapes that the operators take, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, turn_index, role, content, source_stage: conversations; a system message is a seed."""
    stage = F.when(F.col("role") == "system", "seed").when(F.col("role") == "assistant", "rollout_assistant").otherwise("rollout_user_simulator")
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"), stage.alias("source_stage"))


MESSAGES = "(select conv_id as sample_id, turn as turn_index, role, text as content, case role when 'system' then 'seed' when 'assistant' then 'rollout_assistant' else 'rollout_user_simulator' end as source_stage from conversations)"


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """response_id, rater, score (-4 to 4), status, seq: events as replies of judges."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k < 5, "call_error").when(k < 10, "parse_error").otherwise("success")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("response_id"), F.col("event_type").alias("rater"), (F.floor("value") % 9 - 4).cast("int").alias("score"), status.alias("status"), F.col("event_id").alias("seq"))


JUDGE = r"(select user_id as response_id, event_type as rater, cast(floor(value) % 9 - 4 as integer) as score, case when k < 5 then 'call_error' when k < 10 then 'parse_error' else 'success' end as status, event_id as seq from (select *, cast(regexp_extract(props, '(\d+)', 1) as integer) as k from events))"


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, condition, category, is_harmful, is_refusal: labelled documents as judged replies."""
    d, l = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("condition"), F.col("source").alias("category"), (F.col("toxic") == 1).alias("is_harmful"), (F.col("quality") == 0).alias("is_refusal"))


JUDGMENTS = "(select doc_id as sample_id, lang as condition, source as category, toxic = 1 as is_harmful, quality = 0 as is_refusal from documents join labels using (doc_id))"


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scale, run, grp, item, score (0 or 1), choice_mass, num_choices: lineitem as answers at scales."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("scale"), F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("item"), (F.col("l_linestatus") == "O").cast("double").alias("score"), (F.col("l_tax") * 12).alias("choice_mass"), F.lit(4).alias("num_choices"))


SWEEP = "(select l_discount as scale, l_linenumber as run, l_returnflag as grp, l_orderkey as item, cast(l_linestatus = 'O' as double) as score, l_tax * 12 as choice_mass, 4 as num_choices from lineitem)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, col, value: the response matrix, an event type's mean value by user."""
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("col")).agg(F.avg("value").alias("value"))


CELLS = "(select user_id as k, event_type as col, avg(value) as value from events group by all)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, phase, event_type, status, attempt, payload, seq: events as a stage log."""
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("phase"), F.when(k < 30, "failed").otherwise("success").alias("status"), (k % 5 + 1).alias("attempt"), "value", "props", F.col("event_id").alias("seq"))


LOG = r"(select user_id as sample_id, event_type as phase, case when k < 30 then 'failed' else 'success' end as status, cast(k % 5 + 1 as integer) as attempt, value, props, event_id as seq from (select *, cast(regexp_extract(props, '(\d+)', 1) as integer) as k from events))"


def dims(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """vec_id, label, dim (from 0), x: embeddings in long form."""
    e = load(spark, sf_dir, "embeddings")
    out = e.select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return out if n is None else out.where(F.col("dim") < n)


DIMS = "(select vec_id, label, cast(generate_subscripts(embedding, 1) - 1 as integer) as dim, cast(unnest(embedding) as double) as x from embeddings)"
VIEWS = {"MESSAGES": MESSAGES, "JUDGE": JUDGE, "JUDGMENTS": JUDGMENTS, "SWEEP": SWEEP, "CELLS": CELLS, "LOG": LOG, "DIMS": DIMS}


def with_views(sql: str) -> str:
    for name, view in VIEWS.items():
        sql = sql.replace("{" + name + "}", view)
    return sql
