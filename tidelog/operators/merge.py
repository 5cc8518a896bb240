"""Merging sorted inputs and compacting levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.read import latest


def merge(inputs: list[DataFrame], keys: list[str] | str = "key", reverse: bool = False) -> DataFrame:
    """One row a key: of inputs that hold it, the first one's (the last one's if ``reverse``)."""
    ranked = [df.withColumn("_input", F.lit(-i if not reverse else i)) for i, df in enumerate(inputs)]
    rest = [c for c in inputs[0].columns if c not in ([keys] if isinstance(keys, str) else keys)]
    union = reduce(lambda a, b: a.unionByName(b), ranked)
    return latest(union, keys, order=[F.col("_input"), *(F.col(c) for c in rest)]).drop("_input")


def concat(inputs: list[DataFrame]) -> DataFrame:
    """Inputs of disjoint key ranges one after the other."""
    return reduce(lambda a, b: a.unionByName(b), inputs)


def compact(levels: list[DataFrame], keys: list[str] | str = "key") -> DataFrame:
    """Newest row of each key over all levels; tombstones stay, since older levels may be left out."""
    return latest(concat(levels), keys)


def write_sorted(rows: DataFrame, path: str, by: str = "key", tables: int = 64, distinct: int | None = None) -> None:
    """Range-partitioned, sorted Parquet: row-group ranges prune seeks, and a bloom filter, sized by ``distinct``, prunes lookups."""
    out = rows.repartitionByRange(tables, by).sortWithinPartitions(by).write.mode("overwrite")
    if distinct:
        out = out.option(f"parquet.bloom.filter.enabled#{by}", "true").option(f"parquet.bloom.filter.expected.ndv#{by}", str(max(1, distinct // tables)))
    out.parquet(path)
