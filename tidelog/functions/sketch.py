"""Bloom filters, counting and recency as plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bits_per_key(false_positive: float) -> int:
    return max(1, math.ceil(-math.log(false_positive) / math.log(2) ** 2))


def num_hashes(bits: int) -> int:
    return min(30, max(1, int(bits * math.log(2))))


def num_bytes(keys: Column, bits: int) -> Column:
    return F.floor((F.greatest(F.lit(64), keys * bits) + 7) / 8).cast("bigint")


def surrogate_hash(key: Column) -> Column:
    """32 bits of an integer key by multiplication; both engines can do it."""
    return F.pmod(key * F.lit(2654435761), F.lit(1 << 32))


def position(key: Column, i: Column, bits: Column) -> Column:
    """Double hashing: h + i * (h rotated right by 17), modulo 2^32 and the number of bits."""
    h = surrogate_hash(key)
    turned = F.shiftright(h, 17) + F.pmod(F.shiftleft(h, 15), F.lit(1 << 32))
    return F.pmod(F.pmod(h + i * F.pmod(turned, F.lit(1 << 32)), F.lit(1 << 32)), bits).cast("bigint")


def positions(key: Column, hashes: int, bits: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: position(key, i, bits))


def packed(built: DataFrame) -> DataFrame:
    """(word, mask): positions as words of 64 bits."""
    return built.groupBy(F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pos & 63))")).alias("mask"))


def bloom_words(keys: DataFrame, hashes: int, bits: Column, key: str = "key") -> DataFrame:
    """The filter's words that have set bits; partial aggregation keeps tasks and the shuffle at their number, which is a 64th of the bits."""
    return packed(keys.select(F.explode(positions(F.col(key), hashes, bits)).alias("pos")))


def bloom_build(keys: DataFrame, hashes: int, bits: Column, key: str = "key") -> DataFrame:
    """Distinct set bits."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("mask"), i) == 1)
    return bloom_words(keys, hashes, bits, key).select("word", F.explode(places).alias("_i")).select((F.shiftleft("word", 6) + F.col("_i")).alias("pos"))


def bloom_probe(keys: DataFrame, built: DataFrame, hashes: int, bits: Column, key: str = "key") -> DataFrame:
    """Keys whose positions are all set; ``built`` holds positions, or words as of ``bloom_words``.

    Each position in turn is looked up by a row a key. The words of a task are its hash table, so that keys stream by
    and need not be sorted; keys already known to miss are spread over the tasks and meet no word.
    """
    words = (built if "mask" in built.columns else packed(built)).hint("shuffle_hash")
    rows = keys.select(key, bits.alias("_bits"), F.lit(True).alias("may_contain")).dropDuplicates([key])
    for i in range(hashes):
        pos = position(F.col(key), F.lit(i), F.col("_bits"))
        asked = rows.withColumn("_word", F.when(F.col("may_contain"), F.shiftright(pos, 6)).otherwise(-1 - F.pmod(F.xxhash64(key), F.lit(1 << 32))))
        there = F.getbit(F.col("mask"), pos.bitwiseAND(F.lit(63)).cast("int")) == 1
        rows = asked.join(words, F.col("_word") == F.col("word"), "left").select(key, "_bits", (F.col("may_contain") & F.coalesce(there, F.lit(False))).alias("may_contain"))
    return rows.select(key, "may_contain")


def frequency(log: DataFrame, key: str = "key") -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("freq"))


def frequency_sketch(log: DataFrame, key: str = "key", eps: float = 0.001, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    """Spark's count-min sketch of the keys."""
    return log.agg(F.count_min_sketch(F.col(key), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def doorkeeper(log: DataFrame) -> DataFrame:
    """Whether a key was accessed before: by its first access, so that a hot key is no task of its own."""
    first = log.groupBy(F.col("key").alias("_key")).agg(F.min("seq").alias("_first"))
    return log.join(first, F.col("key") == F.col("_key")).withColumn("seen_before", F.col("seq") > F.col("_first")).drop("_key", "_first")


def recency(log: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Rank of each key by its last access, the latest first.

    Ranks are counted within runs of ``width`` sequence numbers; only a row a run passes through one task.
    """
    last = log.groupBy("key").agg(F.max("seq").alias("last_seq")).withColumn("_run", F.floor(F.col("last_seq") / width))
    runs = last.groupBy(F.col("_run").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = runs.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_run").orderBy(F.desc("last_seq")))
    return last.withColumn("_own", own).join(before, F.col("_run") == F.col("_r")).select("key", "last_seq", (F.col("_before") + F.col("_own")).cast("bigint").alias("rank"))


def admission(log: DataFrame, size: int) -> DataFrame:
    """Batch form of frequency-based admission: the latest 1 % of keys (one at least) are the window, the rest by frequency, 80 % of it protected."""
    window = max(1, size // 100)
    main = size - window
    protected = main * 4 // 5
    ranked = recency(log).join(frequency(log), "key")
    by_freq = F.row_number().over(Window.partitionBy(F.col("rank") <= window).orderBy(F.desc("freq"), F.desc("last_seq")))
    ranked = ranked.withColumn("_r", by_freq)
    segment = F.when(F.col("rank") <= window, "window").when(F.col("_r") <= protected, "protected").when(F.col("_r") <= main, "probation").otherwise("out")
    return ranked.select("key", "freq", "last_seq", segment.alias("segment"))
