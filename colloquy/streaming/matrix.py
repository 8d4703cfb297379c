"""A response matrix kept up to date from a log of raw responses, and built anew when the way of encoding them changes.

The matrix of a version lies below <root>/version=<v>/cells/batch=<n>, a folder for each batch; the batches that are
whole are named by a table beside it, written after them. A cell keeps the number of the event it comes from; the latest event of a cell decides, so a batch that comes twice,
or events that come out of order, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import logprobs as lp

RAW = "seq long, k long, item_id string, item_type string, parsed_choice string, probs map<string,double>, choice_mass double, reverse_keyed boolean, high_option string, mapping map<string,double>, scale int, scoring map<string,map<string,double>>"
CELLS = "k long, item_id string, value double, seq long"


def likeliest(probs: Column) -> Column:
    """The choice of the highest probability, the first of equally high ones; null without any."""
    return F.get(F.array_sort(F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("key")))), F.lit(0))["key"]


def encoded(events: DataFrame, version: int, least_mass: float = 0.75) -> DataFrame:
    """CELLS of raw responses (RAW), by a version's rules.

    A response without a parsed choice takes its likeliest one. likert: the expected digit, or the choice; reversed by
    scale + 1 (before version 3 by the largest digit that was seen, where probabilities are). trait_mcq: the expected
    mapped value of the letters that are mapped (in version 1 the letter's number), or that of the choice. fc_pair:
    2 p(high) - 1, and 0 without probabilities (before version 5 +1 for the high option and -1). forced_choice: +1 for
    A, -1. vignette: a cell <item>_<dimension> for each dimension that an option scores, with the chosen option's score.
    From version 4 on, responses whose choice mass (where there are probabilities) is under least_mass give empty cells;
    so does one without a choice.
    """
    probs, kind = F.col("probs"), F.col("item_type")
    soft = F.coalesce(F.size("probs") > 0, F.lit(False))
    choice = F.coalesce("parsed_choice", likeliest(probs))
    turned = F.coalesce("reverse_keyed", F.lit(False))
    scale = F.coalesce("scale", F.lit(5)).cast("double")
    digits = F.forall(F.map_keys(probs), lambda d: F.rlike(d, F.lit("^[0-9]+$")))
    expected = F.aggregate(F.map_entries(probs), F.lit(0.0), lambda s, e: s + e["key"].try_cast("double") * e["value"])
    ends = scale + 1 if version >= 3 else F.when(soft, F.array_max(F.transform(F.map_keys(probs), lambda d: d.try_cast("double")))).otherwise(scale) + 1
    rating = F.when(soft & digits, expected).otherwise(choice.try_cast("double"))
    mapped = F.filter(F.map_entries(probs), lambda e: F.try_element_at("mapping", e["key"]).isNotNull())
    mcq = F.when(soft, F.when(F.size(mapped) > 0, F.aggregate(mapped, F.lit(0.0), lambda s, e: s + e["value"] * F.try_element_at("mapping", e["key"])))).otherwise(F.try_element_at("mapping", choice))
    letter = (F.ascii(choice) - 64).cast("double")
    pole = F.when(choice == F.col("high_option"), 1.0).otherwise(-1.0)
    pair = F.when(soft, 2 * F.coalesce(F.try_element_at("probs", F.col("high_option")), F.lit(0.0)) - 1).otherwise(0.0) if version >= 5 else pole
    value = F.when(kind == "likert", F.when(turned, ends - rating).otherwise(rating)).when(kind == "trait_mcq", mcq if version >= 2 else letter).when(kind == "fc_pair", pair).when(kind == "forced_choice", F.when(choice == "A", 1.0).otherwise(-1.0))
    dims = F.array_distinct(F.flatten(F.transform(F.map_values("scoring"), lambda o: F.map_keys(F.map_filter(o, lambda _, v: v != 0)))))
    chosen = F.try_element_at("scoring", choice)
    cell = lambda col, v: F.struct(col.alias("item_id"), v.cast("double").alias("value"))
    by_dim = F.transform(dims, lambda d: cell(F.concat("item_id", F.lit("_"), d), F.when(choice.isNotNull(), F.coalesce(F.try_element_at(chosen, d), F.lit(0.0)))))
    heard = choice.isNotNull()
    if version >= 4:
        heard = heard & (~soft | (F.coalesce("choice_mass", lp.total(probs)) >= least_mass))
    each = F.when(kind == "vignette", by_dim).otherwise(F.array(cell(F.col("item_id"), value)))
    return events.select("k", "seq", heard.alias("heard"), F.explode(each).alias("c")).select("k", "c.item_id", F.when(F.col("heard"), F.col("c.value")).alias("value"), "seq")


#: Ways of encoding by version.
VERSIONS: dict[int, Callable[[DataFrame], DataFrame]] = {v: partial(encoded, version=v) for v in range(1, 6)}


def latest(cells: DataFrame) -> DataFrame:
    """The cell of the highest seq; combined before the shuffle. Null values decide, too."""
    return cells.groupBy("k", "item_id").agg(F.max_by(F.struct("value", "seq"), "seq").alias("c")).select("k", "item_id", "c.*")


def folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version}"


def batches_of(spark: SparkSession, root: str, version: int) -> list[int]:
    """Numbers of the batches that a version has whole; a row per batch is read."""
    try:
        return sorted(r.number for r in spark.read.schema("number long").parquet(f"{folder(root, version)}/done").distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def current(spark: SparkSession, root: str, version: int, before: int | None = None) -> DataFrame:
    """CELLS of the last whole batch of a version (before a number, if given); none if there is none."""
    done = [n for n in batches_of(spark, root, version) if before is None or n < before]
    return spark.read.schema(CELLS).parquet(f"{folder(root, version)}/cells/batch={done[-1]:08d}") if done else spark.createDataFrame([], CELLS)


def update(spark: SparkSession, root: str, version: int, events: DataFrame, number: int) -> None:
    """Folds a batch of raw responses into a version's matrix. The same batch under the same number leaves the same matrix."""
    cells = latest(current(spark, root, version, before=number).unionByName(VERSIONS[version](events)))
    cells.write.mode("overwrite").parquet(f"{folder(root, version)}/cells/batch={number:08d}")
    spark.createDataFrame([(number,)], "number long").write.mode("append").parquet(f"{folder(root, version)}/done")


def ensure(spark: SparkSession, root: str, version: int, log: DataFrame, number: int = 0) -> bool:
    """Builds a version's matrix from the whole raw log unless there is one; whether it was built."""
    if batches_of(spark, root, version):
        return False
    update(spark, root, version, log, number)
    return True


def follow(spark: SparkSession, log_path: str, root: str, version: int, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Folds the log's new files in, then ends. Batches follow those of earlier runs by the checkpoint, from number 1; number 0 is a rebuilt matrix."""
    log = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(log_path)
    return log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: update(spark, root, version, batch, n + 1)).start()


def matrix(cells: DataFrame, items: list[str]) -> DataFrame:
    """(k, x): rows with a value or a null for each item, in the items' order."""
    own = cells.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "value"))).alias("m"))
    return own.select("k", F.transform(F.array(*map(F.lit, items)), lambda i: F.try_element_at("m", i)).alias("x"))
