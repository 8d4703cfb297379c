"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Labelled rows that a classifier is fitted on at most.
FIT_ROWS = 8000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one serves a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read back: cuts the lineage and lets later reads prune columns."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """left joined to right, which has one row per key; the rows of a common key are dealt to several tasks.

    A key with over a thousandth of left's rows (and over `least`) is common: there are at most a thousand of those, so
    they can be broadcast. Right's row of such a key is repeated for each of its parts.
    """
    limit = max(least, left.count() // 1000)
    counts = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    common = F.broadcast(checkpointed(counts.select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts"))))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(common, key, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
    copies = right.join(common, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"]).drop("__part")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no column of that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int = FIT_ROWS) -> DataFrame:
    """(place, text, label): whole texts of at most `rows` labelled documents, half of them of either label as far as there are so many.

    learn: condition on doc_id that a row may be learnt from. Which rows are taken, and in which order, depends on a
    hash of the id alone. The ids are at most `rows`, so they can be broadcast. Of rows with one id the longest text is
    taken; of several labels of one id the largest. The rows are written once, so that texts are read once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    order = [F.xxhash64("doc_id", F.lit(label)), F.col("doc_id")]
    parts = [known.where(F.col("__label") == y).orderBy(*order).limit(rows // 2) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("__id"), "__label")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    longest = F.max(F.struct(F.length("__text").alias("n"), F.col("__text").alias("t")))["t"]
    own = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).groupBy("__id").agg(longest.alias("text"), F.max("__label").alias("label"))
    return written(own.select(F.xxhash64("__id", F.lit(1)).alias("place"), "text", "label"), "labelled")


def in_order(sample: DataFrame) -> Iterator[tuple[str, int]]:
    """(text, label) of a sample in its order, one after another: the driver never holds all texts at once."""
    return ((r.text, r.label) for r in sample.orderBy("place", "text").toLocalIterator())


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], column: str = "score") -> DataFrame:
    """The rows of docs with what `score` gives for their whole texts (null: empty); a column of that name is replaced."""
    kept = docs.drop(column)
    schema = StructType([*kept.schema.fields, StructField(column, DoubleType())])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.asarray(score(texts), dtype="float64"))], names=[*names, column])

    return kept.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """The batches of each run of equal keys, one run after another, of rows that come sorted by keys."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new).tolist()
        for lo, hi in zip([0, *starts], [*starts, b.num_rows]):
            key = tuple(c[lo] for c in cols)
            if at is not None and key != at:
                yield held
                held = []
            at = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression (the last is the constant), by Newton steps; few columns."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
        w = w - np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
