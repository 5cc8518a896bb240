"""Tables, levels, and the choice of what to compact."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.sources.log import Options


def table_meta(rows: DataFrame, file: str = "fid", key: str = "key", size: str = "size") -> DataFrame:
    return rows.groupBy(file).agg(F.count(F.lit(1)).cast("bigint").alias("key_count"), F.sum(size).cast("bigint").alias("size_bytes"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def level_totals(tables: DataFrame) -> DataFrame:
    return tables.groupBy("level").agg(F.count(F.lit(1)).cast("bigint").alias("tables"), F.sum("size_bytes").cast("bigint").alias("bytes"))


def key_range(tables: DataFrame) -> DataFrame:
    return tables.agg(F.min("min_key").alias("left"), F.max("max_key").alias("right"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_fid, b_fid) of tables whose key ranges meet; a null end is unbounded. Both sides are catalogues, of a row a file."""
    x = a.select(F.col("fid").alias("a_fid"), F.col("min_key").alias("_al"), F.col("max_key").alias("_ar"))
    y = b.select(F.col("fid").alias("b_fid"), F.col("min_key").alias("_bl"), F.col("max_key").alias("_br"))
    meet = F.coalesce(F.col("_al") <= F.col("_br"), F.lit(True)) & F.coalesce(F.col("_ar") >= F.col("_bl"), F.lit(True))
    return x.join(y, meet).select("a_fid", "b_fid")


def unconflicted(candidates: DataFrame, running: DataFrame) -> DataFrame:
    """Candidate ranges that meet no range under compaction."""
    r = running.select(F.col("min_key").alias("_l"), F.col("max_key").alias("_r"))
    return candidates.join(r, (F.col("min_key") <= F.col("_r")) & (F.col("max_key") >= F.col("_l")), "left_anti")


def except_files(tables: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    return tables.join(gone.select("fid"), "fid", "left_anti").unionByName(new)


def order_of_levels(scores: DataFrame) -> DataFrame:
    """Level 0 first, then by score; those of 1 or more."""
    return scores.filter("score >= 1").orderBy(F.col("level") != 0, F.desc("score"), "level")


def level_zero_chain(tables: DataFrame) -> DataFrame:
    """The oldest level-0 tables that follow one another with overlap, up to the first gap."""
    up = Window.orderBy("fid").rowsBetween(Window.unboundedPreceding, -1)
    rows = tables.withColumn("_r", F.max("max_key").over(up)).withColumn("_l", F.min("min_key").over(up))
    gap = F.coalesce((F.col("min_key") > F.col("_r")) | (F.col("max_key") < F.col("_l")), F.lit(False))
    rows = rows.withColumn("_gaps", F.sum(gap.cast("int")).over(Window.orderBy("fid").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("_gaps = 0").drop("_r", "_l", "_gaps")


def split_bounds(tables: DataFrame, parts: int = 5, least: int = 3) -> DataFrame:
    """Every n-th bottom table's last key ends a split; the last split has no end."""
    w = Window.orderBy("min_key", "fid")
    total = F.count(F.lit(1)).over(Window.partitionBy())
    step = F.greatest(F.lit(least), F.ceil(total / parts)).cast("int")
    rows = tables.withColumn("_n", F.row_number().over(w)).withColumn("_step", step).withColumn("_total", total)
    ends = rows.filter((F.col("_n") % F.col("_step") == 0) | (F.col("_n") == F.col("_total")))
    right = F.when(F.col("_n") == F.col("_total"), F.lit(None)).otherwise(F.col("max_key"))
    return ends.select(F.lag("max_key").over(Window.orderBy("_n")).alias("left"), right.alias("right"))


def pack_blocks(rows: DataFrame, file: str = "fid", key: str = "key", options: Options = Options()) -> DataFrame:  # noqa: B008
    """Index of blocks as the writer packs them: (file, block, first_key, entries, bytes), in key order within a file.

    ``size`` is a value's encoded size. An entry that would bring a block over its limit, with its header, whole key,
    value, place list and trailer, begins the next one; stored are the header, the key past its common prefix with the
    block's first key, and the value. ``bytes`` is the finished block. A fold over each file's order; keys are strings.
    """
    most = options.block_size

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, first, entries, used = None, 0, None, 0, 1
        out: list[tuple] = []

        def close() -> None:
            if entries:
                out.append((now, number, first, entries, used + 4 * entries + 12))

        for t in parts:
            for f, k, size in zip(t[file], t[key], t["size"], strict=True):
                if f != now:
                    close()
                    now, number, first, entries, used = f, 0, None, 0, 1
                b = k.encode()
                if entries and used + 4 + len(b) + size + 4 * (entries + 1) + 12 > most:
                    close()
                    number, first, entries, used = number + 1, None, 0, 1
                if first is None:
                    first = k
                same = len(os.path.commonprefix([first.encode(), b])) if entries else 0
                used += 4 + len(b) - same + size
                entries += 1
        close()
        yield pd.DataFrame(out, columns=[file, "block", "first_key", "entries", "bytes"])

    kinds = dict(rows.dtypes)
    sized = rows.select(file, key, F.col("size").cast("bigint").alias("size"))
    return sized.repartition(file).sortWithinPartitions(file, key).mapInPandas(fold, f"{file} {kinds[file]}, block bigint, first_key string, entries bigint, bytes bigint")
