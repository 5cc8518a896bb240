"""The keyed log as a stream: newest row of each key, kept with its sequence, tombstones included."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "seq bigint, value string"
OUT = "key bigint, value string, seq bigint"


def tail(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """Log files of a directory as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _newer(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, value = state.get if state.exists else (None, None)
    changed = False
    for t in parts:
        row = t.loc[t["seq"].idxmax()]
        if seq is None or int(row["seq"]) > seq:
            seq, value, changed = int(row["seq"]), row["value"], True
    if changed:
        state.update((seq, value))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "seq": [seq]})


def upserts(log: DataFrame) -> DataFrame:
    """Rows that change a key's newest state; rows that come late but are older change nothing."""
    return log.groupBy("key").applyInPandasWithState(_newer, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, path: str, schema: str, checkpoint: str, files: int = 64) -> list[str]:
    """Processes what is there and stops; the changes land in memory tables, for tests."""
    name = f"upserts_{uuid.uuid4().hex}"
    query = upserts(tail(spark, path, schema, files)).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [name]


def merge_into(log: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch's newest rows; readers take the newest again, so replays change nothing."""
    from tidelog.operators.read import latest

    def write(batch: DataFrame, _: int) -> None:
        latest(batch).write.mode("append").parquet(path)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
