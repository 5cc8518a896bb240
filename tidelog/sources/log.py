"""The keyed log and its options.

Every write or delete is a row ``key, value, expire_at, meta, seq``. Rows have no order of their own, so
``seq`` says which is newer; an empty or null value is a tombstone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KV_SCHEMA = "key binary, value binary, expire_at bigint, meta int, seq bigint"
MANIFEST_SCHEMA = "seq bigint, id bigint, op string, level int, checksum binary"
VLOG_SCHEMA = "fid bigint, offset bigint, len bigint, key binary, value binary"


@dataclass(frozen=True)
class Options:
    """Sizes in bytes; the defaults are fixed values of the on-disk layout."""

    memtable_size: int = 16 << 20
    sst_size: int = 16 << 20
    vlog_size: int = 16 << 20
    vlog_entries: int = 100_000
    value_threshold: int = 100
    base_table_size: int = 8 << 20
    base_level_size: int = 256 << 20
    level_multiplier: int = 10
    levels: int = 5
    level_zero_tables: int = 5
    false_positive: float = 0.01
    block_size: int = 512
    max_key: int = 65535


def size_of(value: Column | str) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


def is_deleted(value: str = "value") -> Column:
    return size_of(value) == 0


def validated(log: DataFrame, key: str = "key", most: int = Options.max_key) -> DataFrame:
    """Fails the job at the first key that is null, empty or too long."""
    n = F.octet_length(F.col(key).cast("string"))
    bad = n.isNull() | (n < 1) | (n > most)
    return log.withColumn(key, F.when(bad, F.raise_error(F.lit("empty or oversized key"))).otherwise(F.col(key)))


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with writes added; order comes from their ``seq``."""
    return log.unionByName(rows, allowMissingColumns=True)


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with a tombstone for each (key, seq)."""
    kind = dict(log.dtypes)["value"]
    return put(log, keys.select("key", "seq", F.lit(None).cast(kind).alias("value")))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """The log as of a sequence number (an extension)."""
    return log.filter(F.col("seq") <= seq)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a keyed log: user_id is the key, event_id the sequence, errors are deletes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("bigint").alias("key"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("value"), F.col("event_id").cast("bigint").alias("seq"), (F.col("event_id") * 10).cast("bigint").alias("expire_at"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
