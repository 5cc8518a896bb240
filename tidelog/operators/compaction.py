"""Choosing and committing compactions: plans over the catalogue, which has a row a file.

A catalogue row is ``fid, level, size_bytes, min_key, max_key``; ``busy`` holds the same for files under compaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.levels import level_zero_chain
from tidelog.sources.log import Options

DEFAULTS = Options()


def key_span(left: Column, right: Column, inf: Column | None = None) -> Column:
    """A key range: null ends are empty, ``inf`` is everything."""
    return F.struct(left.alias("left"), right.alias("right"), F.coalesce(inf if inf is not None else F.lit(False), F.lit(False)).alias("inf"))


def is_empty(span: Column) -> Column:
    return span["left"].isNull() & span["right"].isNull() & ~span["inf"]


def spans_equal(a: Column, b: Column) -> Column:
    return a["left"].eqNullSafe(b["left"]) & a["right"].eqNullSafe(b["right"]) & (a["inf"] == b["inf"])


def spans_meet(a: Column, b: Column) -> Column:
    """An empty first range meets everything, an empty second one nothing, an infinite one everything else."""
    apart = F.coalesce((a["left"] > b["right"]) | (a["right"] < b["left"]), F.lit(False))
    return F.when(is_empty(a), True).when(is_empty(b), False).when(a["inf"] | b["inf"], True).otherwise(~apart)


def span_union(a: Column, b: Column) -> Column:
    """The least range with both; a null end takes the other's."""
    return key_span(F.least(a["left"], b["left"]), F.greatest(a["right"], b["right"]), a["inf"] | b["inf"])


def span_text(span: Column) -> Column:
    return F.format_string("[left=%s, right=%s, inf=%s]", F.lower(F.hex(span["left"].cast("string"))), F.lower(F.hex(span["right"].cast("string"))), span["inf"])


def level_sort(tables: DataFrame) -> DataFrame:
    """``pos`` of each table in its level: level 0 by file number, oldest first, others by first key."""
    order = Window.partitionBy("level").orderBy(F.when(F.col("level") == 0, F.col("fid")).otherwise(F.col("min_key")), "fid")
    return tables.withColumn("pos", F.row_number().over(order).cast("bigint"))


def new_table_sort(tables: DataFrame) -> DataFrame:
    """New tables of a compaction by last key."""
    return tables.orderBy("max_key", "fid")


def targets(totals: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(level, level_target, file_target, base_level) of every configured level.

    From the last level's bytes upwards, each a multiplier's part of the one below and none under the base level size;
    level 0 has no size target. The base level is the deepest that reaches the base size, moved past one that is empty
    above one with room.
    """
    spark, last, mult = totals.sparkSession, options.levels - 1, options.level_multiplier
    rows = spark.range(options.levels).select(F.col("id").cast("int").alias("level")).join(totals.select("level", F.col("bytes").alias("_bytes")), "level", "left").fillna(0, ["_bytes"])
    bottom = rows.filter(F.col("level") == last).select(F.col("_bytes").alias("_last"))
    part = F.floor(F.col("_last") / F.pow(F.lit(float(mult)), F.lit(last) - F.col("level")))
    target = F.greatest(part, F.lit(options.base_level_size)).cast("bigint")
    rows = rows.crossJoin(bottom).withColumn("level_target", F.when(F.col("level") > 0, target))
    by_level = rows.agg(F.max(F.when(F.col("level_target") >= options.base_level_size, F.col("level"))).alias("_base"), F.map_from_entries(F.collect_list(F.struct("level", F.struct("_bytes", "level_target")))).alias("_at"))
    here, below = F.col("_at")[F.col("_base")], F.try_element_at("_at", F.col("_base") + 1)
    moved = F.coalesce((F.col("_base") < last) & (here["_bytes"] == 0) & (below["_bytes"] < below["level_target"]), F.lit(False))
    by_level = by_level.select("_base", F.when(moved, F.col("_base") + 1).otherwise(F.col("_base")).cast("bigint").alias("base_level"))
    deeper = F.greatest(F.col("level") - F.col("_base"), F.lit(0))
    size = F.when(F.col("level") == 0, F.lit(options.memtable_size)).otherwise((F.lit(options.base_table_size) * F.pow(F.lit(float(mult)), deeper)))
    return rows.crossJoin(by_level).select("level", "level_target", size.cast("bigint").alias("file_target"), "base_level")


def scores(tables: DataFrame, busy: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(level, score) of every configured level: level 0 by number of tables, others by bytes not under compaction against the target."""
    totals = tables.groupBy("level").agg(F.count(F.lit(1)).alias("_n"), F.sum("size_bytes").cast("bigint").alias("bytes"))
    gone = busy.groupBy("level").agg(F.sum("size_bytes").alias("_gone"))
    rows = targets(totals, options).join(totals, "level", "left").join(gone, "level", "left").fillna(0, ["_n", "bytes", "_gone"])
    score = F.when(F.col("level") == 0, F.col("_n") / F.lit(float(options.level_zero_tables))).otherwise((F.col("bytes") - F.col("_gone")) / F.col("level_target"))
    return rows.select("level", F.round(score, 9).alias("score"))


def _free(tables: DataFrame, busy: DataFrame) -> DataFrame:
    """Tables whose range meets none under compaction in their level."""
    b = busy.select(F.col("level").alias("_lv"), F.col("min_key").alias("_l"), F.col("max_key").alias("_r"))
    return tables.join(b, (F.col("level") == F.col("_lv")) & (F.col("min_key") <= F.col("_r")) & (F.col("max_key") >= F.col("_l")), "left_anti")


def fill_l0_l0(tables: DataFrame, busy: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Level-0 tables to merge with one another: small, not busy, four of them at least, else none."""
    few = tables.filter((F.col("level") == 0) & (F.col("size_bytes") < int(options.memtable_size * 0.9))).join(busy.select("fid"), "fid", "left_anti")
    enough = few.agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 4")
    return few.crossJoin(enough).select("fid", "level", F.lit("top").alias("role"))


def with_overlaps(top: DataFrame, lower: DataFrame) -> DataFrame:
    """``top`` tables, and those of ``lower`` that meet their common range, by role."""
    span = top.agg(F.min("min_key").alias("_l"), F.max("max_key").alias("_r"))
    bot = lower.join(span, (F.col("min_key") <= F.col("_r")) & (F.col("max_key") >= F.col("_l")), "left_semi")
    return top.select("fid", "level", F.lit("top").alias("role")).unionByName(bot.select("fid", "level", F.lit("bot").alias("role")))


def fill_l0_base(tables: DataFrame, base_level: int) -> DataFrame:
    """The oldest level-0 tables that follow one another with overlap, and what they meet in the base level."""
    return with_overlaps(level_zero_chain(tables.filter("level = 0")), tables.filter(F.col("level") == base_level))


def fill_l0(tables: DataFrame, busy: DataFrame, base_level: int, options: Options = DEFAULTS) -> DataFrame:
    """Level 0 into itself while it is small, else into the base level, else into itself."""
    least = options.level_zero_tables * options.memtable_size
    small = tables.filter("level = 0").agg((F.coalesce(F.sum("size_bytes"), F.lit(0)) < least).alias("_small"))
    base = fill_l0_base(tables, base_level).crossJoin(small.filter("not _small")).drop("_small")
    some = base.agg((F.count(F.lit(1)) > 0).alias("_some"))
    own = fill_l0_l0(tables, busy, options).crossJoin(some.filter("not _some")).drop("_some")
    return base.unionByName(own)


def fill_ln(tables: DataFrame, busy: DataFrame, level: int) -> DataFrame:
    """The first table of a level, by first key, that is free and whose overlaps in the next level are free; and those."""
    lower = tables.filter(F.col("level") == level + 1)
    mine = _free(tables.filter(F.col("level") == level), busy)
    low = lower.select(F.col("fid").alias("_bf"), F.col("min_key").alias("_bl"), F.col("max_key").alias("_br"))
    met = mine.join(low, (F.col("min_key") <= F.col("_br")) & (F.col("max_key") >= F.col("_bl")), "left")
    ranges = met.groupBy("fid", F.col("level"), F.col("min_key"), F.col("max_key")).agg(F.min("_bl").alias("_nl"), F.max("_br").alias("_nr"))
    b = busy.filter(F.col("level") == level + 1).select(F.col("min_key").alias("_l"), F.col("max_key").alias("_r"))
    able = ranges.join(b, (F.col("_nl") <= F.col("_r")) & (F.col("_nr") >= F.col("_l")), "left_anti")
    return with_overlaps(able.select("fid", "level", "min_key", "max_key").orderBy("min_key", "fid").limit(1), lower)


def commit_changes(filled: DataFrame, new: DataFrame, next_level: int) -> DataFrame:
    """Catalogue changes of a compaction: a CREATE of each new table in the next level, then a DELETE of each input."""
    made = new.select("fid", F.lit("CREATE").alias("op"), F.lit(next_level).alias("level"))
    return made.unionByName(filled.select("fid", F.lit("DELETE").alias("op"), F.lit(None).cast("int").alias("level")))


def committed(tables: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue after a commit."""
    left = tables.join(changes.filter("op = 'DELETE'").select("fid"), "fid", "left_anti")
    return left.unionByName(new.join(changes.filter("op = 'CREATE'").select("fid", "level"), "fid"), allowMissingColumns=True).select(tables.columns)


def lookup_tables(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, fid, level, turn): files whose range holds a key, in the order a read goes through them.

    Level 0 from its newest file on; below it a level at a time. Files outside every key's range are never opened.
    """
    k = keys.select("key").distinct()
    met = tables.join(k, (F.col("min_key") <= F.col("key")) & (F.col("max_key") >= F.col("key")))
    order = Window.partitionBy("key").orderBy("level", F.desc("fid"))
    return met.select("key", "fid", "level", F.row_number().over(order).cast("bigint").alias("turn"))


def level_get(rows: DataFrame, tables: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key's row from the first file of its turn that has it; ``rows`` carry ``fid`` and ``key``. An equi-join on both."""
    found = rows.join(lookup_tables(tables, keys), ["fid", "key"])
    rest = [c for c in found.columns if c != "key"]
    return found.groupBy("key").agg(F.min_by(F.struct(*rest), "turn").alias("_row")).select("key", "_row.*")
