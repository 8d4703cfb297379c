"""Metrics of responses by name: each gives a map of numbers from column expressions or, for judges, from a client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import text

Metric = Callable[[Column, Column], dict[str, Column]]
_METRICS: dict[str, Metric] = {}


def register(name: str, metric: Metric) -> None:
    _METRICS[name] = metric


def get(name: str) -> Metric:
    if name not in _METRICS:
        raise KeyError(f"unknown metric {name!r}; there are {', '.join(sorted(_METRICS))}")
    return _METRICS[name]


register("length", lambda r, q: {"characters": F.length(r)})
register("lowercase_density", lambda r, q: {"density": text.lowercase_density(r)})
register("punctuation_density", lambda r, q: {"density": text.punctuation_density(r)})
register("count_o", lambda r, q: {"count": text.count_substring(r, "o"), "density": text.share(text.count_substring(r, "o") * 100, F.length(r))})


def evaluate(df: DataFrame, names: list[str], response: str = "response", question: str = "question") -> DataFrame:
    """df with `metrics`: map of "metric.key" to number, all in one projection."""
    pairs = [x for n in names for k, c in get(n)(F.col(response), F.col(question)).items() for x in (F.lit(f"{n}.{k}"), c.cast("double"))]
    return df.withColumn("metrics", F.create_map(*pairs))


def aggregate(df: DataFrame, *keys: str) -> DataFrame:
    """Mean, median, least, most and sample deviation (0 for one value) of every metric."""
    rows = df.select(*keys, F.explode("metrics").alias("metric", "value")).where(F.col("value").isNotNull())
    v = F.col("value")
    return rows.groupBy(*keys, "metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"))


def ask(df: DataFrame, client: Callable[[], Callable[[list[str]], list[str]]], prompt: Column, low: int, high: int, default: int) -> DataFrame:
    """df with `reply`, `score` and `status` of a judge.

    client(): made once a task, answers a batch of prompts. A call that raises is a call_error; tasks may be retried, so
    a client must give the same reply again or be safe to ask twice.
    """
    asked = df.withColumn("prompt", prompt)
    names = asked.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for pdf in batches:
            try:
                replies = call(pdf["prompt"].tolist())
            except Exception:  # noqa: BLE001  whatever a client raises is a failed call
                replies = [None] * len(pdf)
            yield pdf[names].assign(reply=pd.Series(replies, index=pdf.index, dtype=object))

    schema = StructType([*asked.schema.fields, StructField("reply", StringType())])
    told = asked.mapInPandas(run, schema)
    score, reasoning, parsed = text.judge_reply(F.col("reply"), low, high, default)
    status = F.when(F.col("reply").isNull(), "call_error").when(parsed, "success").otherwise("parse_error")
    return told.withColumn("status", status).withColumn("reasoning", F.when(F.col("reply").isNotNull(), reasoning)).withColumn("score", F.when(F.col("reply").isNotNull(), score))
