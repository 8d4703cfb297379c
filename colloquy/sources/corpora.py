"""Chat corpora under one shape, by name: (sample_id, messages, assistant_model, source_info).

An adapter takes a DataFrame of its corpus and options, and filters by them; register adds one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Adapter = Callable[..., DataFrame]
ADAPTERS: dict[str, tuple[Adapter, str]] = {}
MESSAGES = "array<struct<role:string,content:string>>"


def register(name: str, notes: str = "") -> Callable[[Adapter], Adapter]:
    def add(f: Adapter) -> Adapter:
        if name in ADAPTERS:
            raise ValueError(f"{name} is registered already")
        ADAPTERS[name] = f, notes
        return f

    return add


def adapter(name: str) -> Adapter:
    if name not in ADAPTERS:
        raise KeyError(f"no corpus {name!r}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[name][0]


def messages_of_json(raw: Column) -> Column:
    """MESSAGES of a JSON array of messages: content that is no text stays JSON, tool calls stand in for missing content, blank ones go."""
    parsed = F.from_json(raw, "array<struct<role:string,content:string,tool_calls:string>>")
    kept = F.transform(parsed, lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["content"], m["tool_calls"]).alias("content")))
    return F.filter(kept, lambda m: F.regexp_replace(F.coalesce(m["content"], F.lit("")), r"(?U)\s", "") != "")


def shaped(df: DataFrame, name: str, key: Column, messages: Column, model: Column, info: list[Column], min_assistant_turns: int = 0) -> DataFrame:
    out = df.select(F.concat(F.lit(name + "::"), key.cast("string")).alias("sample_id"), messages.alias("messages"), model.alias("assistant_model"), F.struct(F.lit(name).alias("source"), *info).alias("source_info"))
    spoken = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    return out.where((F.size("messages") > 0) & (spoken >= min_assistant_turns))


@register("chats", "conversation_id, model, language, turn, conversation (JSON)")
def chats(df: DataFrame, models: list[str] | None = None, languages: list[str] | None = None, min_turn: int = 0, min_assistant_turns: int = 0) -> DataFrame:
    for column, allowed in (("model", models), ("language", languages)):
        if allowed:
            df = df.where(F.col(column).isin(*allowed))
    if min_turn:
        df = df.where(F.coalesce("turn", F.lit(0)) >= min_turn)
    return shaped(df, "chats", F.col("conversation_id"), messages_of_json(F.col("conversation")), F.col("model"), [F.col("language"), F.col("turn")], min_assistant_turns)


@register("dialogues", "conversation_id, conversation_history: array of (role, content, if_chosen, model_provider, model_name)")
def dialogues(df: DataFrame, models: list[str] | None = None, min_assistant_turns: int = 0) -> DataFrame:
    """The thread that the user saw: what they said and the replies they chose. Every chosen model must have one of `models` in its name."""
    seen = F.filter("conversation_history", lambda m: (m["role"] == "user") | ((m["role"] == "model") & F.coalesce(m["if_chosen"], F.lit(False))))
    thread = F.transform(seen, lambda m: F.struct(F.when(m["role"] == "user", "user").otherwise("assistant").alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    said = F.filter(thread, lambda m: F.trim(m["content"]) != "")
    names = F.transform(F.filter(seen, lambda m: m["role"] == "model"), lambda m: F.concat_ws("/", F.nullif(m["model_provider"], F.lit("")), F.coalesce(m["model_name"], F.lit(""))))
    df = df.withColumn("__models", names)
    if models:
        fits = lambda n: F.exists(F.array(*map(F.lit, (m.lower() for m in models))), lambda m: F.contains(F.lower(n), m))
        df = df.where((F.size("__models") > 0) & F.forall("__models", fits))
    return shaped(df, "dialogues", F.col("conversation_id"), said, F.get("__models", F.lit(0)), [F.col("__models").alias("chosen_models")], min_assistant_turns)


@register("trajectories", "trajectory_id, trajectory (JSON), repo, resolved")
def trajectories(df: DataFrame, resolved_only: bool = False, min_assistant_turns: int = 0) -> DataFrame:
    if resolved_only:
        df = df.where(F.coalesce("resolved", F.lit(0)) == 1)
    return shaped(df, "trajectories", F.col("trajectory_id"), messages_of_json(F.col("trajectory")), F.lit(None).cast("string"), [F.col("repo"), F.col("resolved")], min_assistant_turns)


def prompts(df: DataFrame, text: Column, category: Column, kind: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """(id, prompt, category, kind) of harmful or benign prompts that aren't empty; n of them by a hash."""
    own = df.select(text.alias("prompt"), F.coalesce(category, F.lit("unknown")).alias("category")).where(F.coalesce("prompt", F.lit("")) != "")
    out = own.select(F.concat(F.lit(kind + "_"), F.substring(F.sha2(F.concat_ws("|", "category", "prompt"), 256), 1, 12)).alias("id"), "prompt", "category", F.lit(kind).alias("kind"))
    return out if n is None else out.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))), "id").limit(n)


def instruction(question: Column, extra: Column) -> Column:
    """A question with its input below it, where there is one."""
    return F.when(F.trim(F.coalesce(extra, F.lit(""))) == "", question).otherwise(F.concat(question, F.lit("\n\n"), extra))


def load_source(spark: SparkSession, kind: str, path: str, seed: int | None = None, max_samples: int | None = None, key: str = "sample_id") -> DataFrame:
    """Rows of parquet or JSON lines, in an order that follows from the seed, the first max_samples of them."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"unknown kind of source {kind!r}")
    df = spark.read.format(kind).load(path)
    if seed is not None:
        df = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df if max_samples is None else df.limit(max_samples)


def run_logs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(model, eval, run, log ...) of run_info.json files below root/<model>/<eval>/[run_NN/]; only runs whose status is ok."""
    files = spark.read.schema(f"status string, {schema}").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run_info.json").json(root)
    parts = F.split(F.substring_index(F.col("_metadata.file_path"), "/run_info.json", 1), "/")
    nested = F.rlike(F.element_at(parts, -1), F.lit(r"^run_\d+$"))
    at = lambda k: F.when(nested, F.element_at(parts, k - 1)).otherwise(F.element_at(parts, k))
    return files.select(at(-2).alias("model"), at(-1).alias("eval"), F.when(nested, F.element_at(parts, -1)).otherwise("run_00").alias("run"), *files.columns).where(F.col("status") == "ok")
