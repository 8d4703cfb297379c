"""The event log as a stream: per sample and phase the last status, the attempts, and whether it is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "sample_id long, phase string, status string, attempt int, seq long"
STATE = "seq long, status string, attempts int, n_events long, ever_success boolean"
OUT = "sample_id long, phase string, status string, attempts int, n_events long, ever_success boolean"


def fold(events: DataFrame) -> DataFrame:
    """The same in batch: an aggregate that is combined before the shuffle."""
    return events.groupBy("sample_id", "phase").agg(
        F.max_by("status", "seq").alias("status"), F.max("attempt").alias("attempts"), F.count("*").alias("n_events"), F.bool_or(F.col("status") == "success").alias("ever_success")
    )


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_totals(events: DataFrame) -> DataFrame:
    """Streaming fold by built-in aggregates, in update mode."""
    return fold(events)


class Fold(StatefulProcessor):
    """The fold by custom state: one small row for each sample and phase, whatever the number of its events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, status, attempts, n, good = self.state.get() if self.state.exists() else (-1, None, 0, 0, False)
        for pdf in rows:
            last = pdf.loc[pdf["seq"].idxmax()]
            if last["seq"] >= seq:
                seq, status = int(last["seq"]), last["status"]
            attempts, n, good = max(attempts, int(pdf["attempt"].max())), n + len(pdf), good or bool((pdf["status"] == "success").any())
        self.state.update((seq, status, attempts, n, good))
        yield pd.DataFrame([(*key, status, attempts, n, good)], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stateful_fold(events: DataFrame) -> DataFrame:
    """Emits a key's state whenever events of it arrive; needs the RocksDB state store."""
    return events.groupBy("sample_id", "phase").transformWithStateInPandas(Fold(), OUT, "Update", "None")


def materialise(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the folded table up to date in a folder per batch, each complete once it has its _SUCCESS file."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return running_totals(events).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
