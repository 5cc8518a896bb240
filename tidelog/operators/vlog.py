"""Separation of large values into value logs, and the way back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.codec import vlog_record_size
from tidelog.sources.log import Options, size_of


def inline_or_pointer(log: DataFrame, threshold: int = Options.value_threshold) -> DataFrame:
    """meta bit 0 is set for values that go to the value log."""
    return log.withColumn("meta", F.when(size_of("value") >= threshold, 1).otherwise(0))


def place(large: DataFrame, shards: int = 1, options: Options = Options()) -> DataFrame:  # noqa: B008
    """fid, offset and len of each record, in ``seq`` order within its shard of the log; a shard is a writer with files of its own.

    The fold sees sequence numbers and sizes only; values stay where they are and meet their places by ``seq``.
    An offset that 32 bits can't hold fails the job.
    """
    rows = large.withColumn("_shard", F.pmod("seq", F.lit(shards)))
    at = rotate_exactly(rows, "_shard", options)
    fid = (F.col("fid") * shards + F.col("_shard")).cast("bigint")
    bounded = F.when(F.col("offset") < F.lit(1 << 32), F.col("offset")).otherwise(F.raise_error(F.lit("value log offset over 32 bits")).cast("bigint"))
    at = at.select(F.col("seq").alias("_seq"), "len", fid.alias("fid"), bounded.alias("offset"))
    return large.join(at, F.col("seq") == F.col("_seq")).drop("_seq")


def rotate_exactly(large: DataFrame, shard: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """fid and offset where a file ends after the record that passes a limit of bytes or entries: a fold over each shard's order."""
    schema = f"{shard} {dict(large.dtypes)[shard]}, seq bigint, len bigint, fid bigint, offset bigint"
    rows = large.select(shard, F.col("seq").cast("bigint"), vlog_record_size(size_of("key"), size_of("value")).alias("len"))

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fid, used, count = object(), 0, 0, 0
        for t in parts:
            fids, offsets = [], []
            for s, n in zip(t[shard], t["len"], strict=True):
                if s != now:
                    now, fid, used, count = s, 0, 0, 0
                fids.append(fid)
                offsets.append(used)
                used, count = used + n, count + 1
                if used > options.vlog_size or count > options.vlog_entries:
                    fid, used, count = fid + 1, 0, 0
            yield t.assign(fid=fids, offset=offsets)

    return rows.repartition(shard).sortWithinPartitions(shard, "seq").mapInPandas(fold, schema)


def separate(log: DataFrame, options: Options = Options(), shards: int = 1) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(log with pointers for large values, value log)."""
    marked = inline_or_pointer(log, options.value_threshold)
    placed = place(marked.filter("meta = 1"), shards, options)
    vlog = placed.select("fid", "offset", "len", "key", "value")
    pointer = F.struct("fid", "offset", "len").alias("ptr")
    large = placed.select("key", F.lit(None).cast(dict(log.dtypes)["value"]).alias("value"), "seq", "meta", pointer)
    small = marked.filter("meta = 0").select("key", "value", "seq", "meta", F.lit(None).cast("struct<fid:bigint,offset:bigint,len:bigint>").alias("ptr"))
    return small.unionByName(large), vlog


def dereference(log: DataFrame, vlog: DataFrame) -> DataFrame:
    """Values back in place: an equi-join on file and offset, and on the key, so that a wrong pointer finds nothing."""
    v = vlog.select(F.col("fid").alias("_f"), F.col("offset").alias("_o"), F.col("key").alias("_key"), F.col("value").alias("_value"))
    joined = log.join(v, (F.col("ptr.fid") == F.col("_f")) & (F.col("ptr.offset") == F.col("_o")) & (F.col("key") == F.col("_key")), "left")
    return joined.withColumn("value", F.when(F.col("meta").bitwiseAND(1) > 0, F.col("_value")).otherwise(F.col("value"))).drop("_f", "_o", "_key", "_value")


def replay(vlog: DataFrame, threshold: int = Options.value_threshold) -> DataFrame:
    """Value-log rows as log rows again, in file and offset order."""
    rows = vlog.select("key", "value", (F.col("fid") * F.lit(1 << 32) + F.col("offset")).alias("seq"))
    return inline_or_pointer(rows, threshold)
