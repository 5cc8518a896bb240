"""Reads: the newest row of each key, live views, lookups and ordered seeks.

Filters on the key go below the choice of the newest row, into the scan; filters on the value come after it, as
an older value would reappear otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.sources.log import is_deleted


def latest(log: DataFrame, keys: list[str] | str = "key", *, order: list[Column] | None = None) -> DataFrame:
    """Last write wins. max_by over a struct aggregates before the shuffle, so a hot key moves one row a task."""
    keys = [keys] if isinstance(keys, str) else keys
    rest = [c for c in log.columns if c not in keys]
    by = F.struct(*(order or [F.col("seq"), *(F.col(c) for c in rest if c != "seq")]))
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*(F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in log.columns))


def live(log: DataFrame, keys: list[str] | str = "key") -> DataFrame:
    return latest(log, keys).filter(~is_deleted())


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).filter(is_deleted())


def unexpired(log: DataFrame, now: int) -> DataFrame:
    """Live rows that have not expired; 0 never does (an extension: expiry is carried, not enforced, elsewhere)."""
    return live(log).filter((F.col("expire_at") == 0) | (F.col("expire_at") > now))


def get(log: DataFrame, key) -> DataFrame:
    return live(log.filter(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """One job for many keys: each with its live value, or found = false. The planner picks the join by size."""
    wanted = keys.select("key").distinct()
    found = live(log.join(wanted, "key", "left_semi")).withColumn("found", F.lit(True))
    return wanted.join(found, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def seek_ge(rows: DataFrame, key, by: str = "key") -> DataFrame:
    return rows.filter(F.col(by) >= F.lit(key)).orderBy(by).limit(1)


def seek_le(rows: DataFrame, key, by: str = "key") -> DataFrame:
    return rows.filter(F.col(by) <= F.lit(key)).orderBy(F.desc(by)).limit(1)


def first(rows: DataFrame, by: str = "key") -> DataFrame:
    return rows.orderBy(by).limit(1)


def last(rows: DataFrame, by: str = "key") -> DataFrame:
    return rows.orderBy(F.desc(by)).limit(1)


def prev(rows: DataFrame, key, by: str = "key") -> DataFrame:
    """The key before: a seek, not a window over the table."""
    return rows.filter(F.col(by) < F.lit(key)).orderBy(F.desc(by)).limit(1)


def prev_of_all(rows: DataFrame, by: str = "key", parts: int = 64) -> DataFrame:
    """Every key with the one before it: a lag in range partitions, and the ends of partitions looked up in a small table."""
    ranged = rows.select(F.col(by).alias("k")).repartitionByRange(parts, "k").withColumn("_p", F.spark_partition_id())
    ends = ranged.groupBy("_p").agg(F.max("k").alias("_end"))
    before = ends.select(F.col("_p").alias("_q"), F.lag("_end").over(Window.orderBy("_p")).alias("_before"))
    lagged = ranged.withColumn("_lag", F.lag("k").over(Window.partitionBy("_p").orderBy("k")))
    return lagged.join(before, F.col("_p") == F.col("_q")).select(F.col("k").alias(by), F.coalesce("_lag", "_before").alias("prev"))


def range_scan(rows: DataFrame, left, right, by: str = "key") -> DataFrame:
    """Half open: left <= key < right."""
    return rows.filter((F.col(by) >= F.lit(left)) & (F.col(by) < F.lit(right)))
