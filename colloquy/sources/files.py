"""Readers and writers of JSON lines, rater sheets and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the export profiles.
PROFILES = {
    "minimal_train_eval": ["sample_id", "question", "response"],
    "conversation_training": ["sample_id", "messages"],
    "conversation_trace": ["sample_id", "messages", "source_info", "status"],
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that aren't blank; line is the place in the file. A path that isn't there has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, line long, value string")
    text = spark.read.option("wholetext", False).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("line"), "value").where(F.trim("value") != "")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything at a path."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines): a line that is cut off at the end of its file is left out; any other broken line is an error.

    The error is raised when the rows are read, by the plan itself.
    """
    parsed = lines(spark, path).withColumn("row", F.when(F.try_parse_json("value").isNotNull() & F.startswith(F.trim("value"), F.lit("{")), F.from_json("value", schema)))
    ends = parsed.groupBy("file").agg(F.max("line").alias("end"))
    placed = parsed.join(F.broadcast(ends), "file")  # a row per file
    broken = placed.where(F.col("row").isNull())
    fatal = F.col("row").isNull() & (F.col("line") < F.col("end"))
    good = placed.where(F.when(fatal, F.raise_error(F.concat(F.lit("broken line in "), F.col("file"))).cast("boolean")).otherwise(F.col("row").isNotNull()))
    return good.select("row.*"), broken.select("file", "value")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_raters(spark: SparkSession, path: str, low: int = -4, high: int = 4) -> DataFrame:
    """(id, rater, score) of a sheet with columns id and score_<rater>; blanks are left out, scores beyond the range an error."""
    sheet = spark.read.option("header", True).csv(path)
    names = [c for c in sheet.columns if c.startswith("score_")]
    long = sheet.unpivot(["id"], names, "rater", "text").where(F.trim("text") != "")
    score = F.col("text").cast("int")
    fits = F.when(score.between(low, high), True).otherwise(F.raise_error(F.concat(F.lit("score out of range: "), F.col("text"))).cast("boolean"))
    return long.where(fits).select("id", F.substring("rater", 7, 1 << 20).alias("rater"), score.alias("score"))


def canonical_messages(raw: str) -> F.Column:
    """array<struct<role, content>> of raw messages: tool calls stand in for missing content, blank messages go."""
    kept = F.transform(raw, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], m["tool_calls"]).alias("content")))
    return F.filter(kept, lambda m: m["role"].isNotNull() & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))


def chat_corpus(df: DataFrame, name: str, models: list[str] | None = None, languages: list[str] | None = None, min_assistant_turns: int = 0) -> DataFrame:
    """(sample_id, messages) of a chat corpus (conversation_id, model, conversation, language), filtered."""
    for column, allowed in (("model", models), ("language", languages)):
        if allowed:
            df = df.where(F.col(column).isin(*allowed))
    out = df.select(F.concat(F.lit(name + "::"), F.col("conversation_id").cast("string")).alias("sample_id"), F.filter("conversation", lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "").alias("messages"))
    return out.where(F.size(F.filter("messages", lambda m: m["role"] == "assistant")) >= min_assistant_turns)


def chosen_thread(df: DataFrame) -> DataFrame:
    """(conversation_id, messages): of a branching dialogue, what the user said and the replies that were chosen."""
    seen = F.filter("conversation_history", lambda m: (m["role"] == "user") | F.coalesce(m["if_chosen"], F.lit(False)))
    return df.select("conversation_id", F.transform(seen, lambda m: F.struct(F.when(m["role"] == "user", "user").otherwise("assistant").alias("role"), m["content"].alias("content"))).alias("messages"))


def export(df: DataFrame, path: str, profile: str | None = None, include: list[str] | None = None, exclude: list[str] = (), rename: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Writes JSON lines: the profile's columns and those included, without those excluded, renamed at the end."""
    names = [c for c in (PROFILES[profile] if profile else df.columns) if c in df.columns]
    names += [c for c in include or [] if c not in names]
    df.select(*(c for c in names if c not in exclude)).withColumnsRenamed(rename or {}).write.mode(mode).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_rates(df: DataFrame, path: str) -> None:
    """A CSV table with four decimals."""
    df.select(*(F.format_string("%.4f", c).alias(c) if kind == "double" else c for c, kind in df.dtypes)).write.mode("overwrite").option("header", True).csv(path)
