"""Operators on message tables: sample_id, turn_index, role, content, source_stage.

Every window is partitioned by conversation, so the work spreads however many conversations there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

#: Stages of messages that a rollout made; everything else is a seed.
ROLLOUT_STAGES = ("rollout_assistant", "rollout_user_simulator")


def by_sample() -> WindowSpec:
    return W.partitionBy("sample_id").orderBy("turn_index")


def before() -> WindowSpec:
    return by_sample().rowsBetween(W.unboundedPreceding, -1)


def is_seed() -> Column:
    return ~F.coalesce(F.col("source_stage").isin(*ROLLOUT_STAGES), F.lit(False))


def with_question(messages: DataFrame) -> DataFrame:
    """Each message with the content before it as `question`; the first one's is empty."""
    return messages.withColumn("question", F.coalesce(F.lag("content").over(by_sample()), F.lit("")))


def with_last_user(messages: DataFrame) -> DataFrame:
    """Assistant messages with the nearest user message before them (null if none)."""
    said = F.when(F.col("role") == "user", F.col("content"))
    return messages.withColumn("last_user", F.last(said, ignorenulls=True).over(before())).where(F.col("role") == "assistant")


def with_turn_number(messages: DataFrame) -> DataFrame:
    """How many user and assistant messages stand before; -1 for system messages."""
    spoken = F.when(F.col("role").isin("user", "assistant"), 1).otherwise(0)
    so_far = F.coalesce(F.sum(spoken).over(before()), F.lit(0))
    return messages.withColumn("turn_number", F.when(F.col("role") == "system", -1).otherwise(so_far).cast("long"))


def with_order(messages: DataFrame, position: str) -> DataFrame:
    """Total order of a conversation: turn (else the original place), then seed before assistant before others, then the original place."""
    rank = F.when(F.col("source_stage") == "seed", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    w = W.partitionBy("sample_id").orderBy(F.coalesce(F.col("turn_index"), F.col(position)), rank, F.col(position))
    return messages.withColumn("message_order", F.row_number().over(w).cast("long"))


def assistant_turns(messages: DataFrame, which: str = "all") -> DataFrame:
    """The first, the final, or all assistant messages of each conversation."""
    own = messages.where(F.col("role") == "assistant")
    if which == "all":
        return own
    if which not in ("first", "final"):
        raise ValueError(f"which must be first, final or all, not {which!r}")
    pick = F.min if which == "first" else F.max
    chosen = own.groupBy("sample_id").agg(pick("turn_index").alias("turn_index"))
    return own.join(chosen, ["sample_id", "turn_index"], "left_semi")


def last_by_role(messages: DataFrame) -> DataFrame:
    """Last user and last assistant message of each conversation, null where there is none."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("turn_index")))
    return messages.groupBy("sample_id").agg(last("user").alias("last_user"), last("assistant").alias("last_assistant"))


def consecutive_assistants(messages: DataFrame) -> DataFrame:
    """Ids of conversations in which two assistant messages follow one another."""
    follows = (F.col("role") == "assistant") & (F.lag("role").over(by_sample()) == "assistant")
    return messages.withColumn("again", follows).where("again").select("sample_id").distinct()


def select_messages(
    messages: DataFrame, roles: list[str] | None = None, turns: tuple[int, int] | None = None, exclude_seed: bool = False, hashes: list[str | None] | None = None,
) -> DataFrame:
    """Messages that pass all given conditions.

    hashes: values of prompt_hash, among which None stands for messages without one.
    turns: first and last turn, both included; a negative one counts from the last turn that isn't a seed's. A message
    without a turn fails a range.
    """
    out = messages
    if turns:
        last = F.coalesce(F.max(F.when(~is_seed(), F.col("turn_index"))).over(W.partitionBy("sample_id")), F.lit(0))
        bound = lambda t: last + 1 + t if t < 0 else F.lit(t)
        out = out.withColumn("__ok", F.coalesce(F.col("turn_index").between(bound(turns[0]), bound(turns[1])), F.lit(False))).where("__ok").drop("__ok")
    if roles:
        out = out.where(F.col("role").isin(*roles))
    if hashes is not None:
        known = F.coalesce(F.col("prompt_hash").isin(*(h for h in hashes if h is not None)), F.lit(False))
        out = out.where(known | F.col("prompt_hash").isNull() if None in hashes else known)
    return out.where(~is_seed()) if exclude_seed else out


def whole_conversations(messages: DataFrame) -> DataFrame:
    """(sample_id, messages): an array of (role, content) in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "role", "content")))
    return messages.groupBy("sample_id").agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def recent_turns(conversations: DataFrame, turns: int) -> DataFrame:
    """The last `turns` exchanges of each conversation, and how many exchanges it has in all."""
    n = F.size("messages")
    keep = F.least(n, F.lit(2 * turns))
    return conversations.withColumn("total_turns", F.floor(n / 2).cast("long")).withColumn("messages", F.when(keep > 0, F.slice("messages", -keep, keep)).otherwise(F.col("messages")))


def prefix_slices(messages: DataFrame) -> DataFrame:
    """One row per assistant message with every message up to it, in order."""
    upto = F.collect_list(F.struct("role", "content")).over(by_sample().rowsBetween(W.unboundedPreceding, 0))
    return messages.withColumn("prefix", upto).where(F.col("role") == "assistant").select("sample_id", "turn_index", "prefix")


def flipped(conversations: DataFrame) -> DataFrame:
    """User and assistant exchanged; an assistant message at the beginning is dropped afterwards."""
    other = lambda m: F.struct(F.when(m["role"] == "user", "assistant").when(m["role"] == "assistant", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content"))
    turned = F.transform("messages", other)
    return conversations.withColumn("messages", turned).withColumn("messages", F.when(F.get("messages", F.lit(0))["role"] == "assistant", F.slice("messages", 2, F.greatest(F.size("messages") - 1, F.lit(0)))).otherwise(F.col("messages")))


def rollout_stats(messages: DataFrame) -> DataFrame:
    """Messages of each role and characters in all, by conversation."""
    count = lambda role: F.count_if(F.col("role") == role).alias(f"n_{role}")
    return messages.groupBy("sample_id").agg(count("user"), count("assistant"), count("system"), F.sum(F.length("content")).alias("n_chars"))


def stats_summary(stats: DataFrame, field: str, budgets: tuple[int, ...]) -> DataFrame:
    """Mean, median, 90th percentile (linear) and maximum of a field, and the share of rows under each budget."""
    q = F.percentile(field, F.array(F.lit(0.5), F.lit(0.9)))
    under = [F.avg((F.col(field) < b).cast("double")).alias(f"frac_under_{b}") for b in budgets]
    return stats.agg(F.avg(field).alias("mean"), q[0].alias("median"), q[1].alias("p90"), F.max(field).alias("max"), *under)


def upsert_messages(events: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last version of each message, at the place where it first came up (`first_seen`)."""
    rest = [c for c in events.columns if c not in (*keys, sequence)]
    last = F.max_by(F.struct(*rest), F.col(sequence)).alias("m")
    return events.groupBy(*keys).agg(last, F.min(sequence).alias("first_seen")).select(*keys, "m.*", "first_seen")
