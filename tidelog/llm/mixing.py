"""Operator 7: mixing sources to target weights by Sainte-Lague apportionment.

Targets are water-filled under each source's cap. The mix is a number of equal blocks of
``block`` words; blocks go to sources, and a source's blocks to its shards, by highest quotients
v / (2 s + 1). In each shard the documents in seeded order form a stream of words; its quota takes
whole passes of the stream first, then the blocks from its start. A shard is a hash part of a source of
about ``shard_rows`` rows, so that no window or task grows with the input.

Defined cases: a null or empty text has size 0 and nothing taken; null source is the last source;
rows that repeat are taken each by itself; very long texts are counted whole and may be cut where a source's
last block ends; equal places in the seeded order go by size; an empty table gives an empty result. Other columns, whatever
their names, stay as they are: a result column gets more leading underscores until no carried column has its name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import cut, stash, words_of


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above cap * size; the excess goes to the others by weight."""
    out, open_, left = np.zeros(len(sizes)), sizes > 0, float(total)
    while open_.any() and left > 0:
        share = left * weights / weights[open_].sum()
        above = open_ & (share > cap * sizes)
        if not above.any():
            out[open_] = share[open_]
            break
        out[above] = cap * sizes[above]
        left -= out[above].sum()
        open_ &= ~above
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1); equal quotients go to the earlier party.

    Bisection on the divisor gives all seats but those of the last few quotients, which are dealt one by one.
    """
    votes = np.asarray(votes, float)
    got = np.zeros(len(votes), np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return got
    at = lambda d: np.floor(votes / d + 0.5).astype(np.int64)
    low, high = 0.0, 4 * votes.sum() / seats * 2 + 4 * votes.max()  # at(high) has no more than the seats
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while (rest := seats - got.sum()) > 0:
        quotients = votes / (2 * got + 1)
        best = np.argsort(-quotients, kind="stable")[: min(rest, max(1, int((quotients == quotients.max()).sum())))]
        got[best] += 1
    return got


def result_names(carry: list[str]) -> list[str]:
    """Names of size, source_size, target, taken and run that no carried column has."""
    known, out = {c.lower() for c in carry}, []
    for name in ("_size", "_source_size", "_target", "_taken", "_run"):
        while name in known:
            name = "_" + name
        out.append(name)
    return out


def mix(docs: DataFrame, carry: list[str] | None = None, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0, block: int = 16, shard_rows: int = 4096, seed: int = 7) -> DataFrame:
    """``carry`` and _size, _source_size, _target, _taken (words, passes counted) of each row."""
    carry = list(docs.columns if carry is None else carry)
    kept = [f"_c{i}" for i in range(len(carry))]
    order = F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text)))
    base = docs.select(*(F.col(c).alias(k) for k, c in zip(kept, carry, strict=True)), F.col(source).alias("_source"), words_of(text).alias("_size"), order.alias("_order"))
    light = base if text in carry else stash(base)
    sums = cut(light.groupBy("_source").agg(F.sum("_size").alias("v"), F.count(F.lit(1)).alias("n")))

    def by_source(t: pd.DataFrame) -> pd.DataFrame:
        names = [(x is None, (x or "").encode()) for x in t._source]
        t = t.iloc[sorted(range(len(t)), key=names.__getitem__)].reset_index(drop=True)
        v = t.v.to_numpy(float)
        goal = targets(v, np.array([weights[i % len(weights)] for i in range(len(t))], float), total * v.sum(), cap)
        return t.assign(target=goal, quota=sainte_lague(goal, round(goal.sum() / block)), shards=np.maximum(1, -(-t.n.to_numpy() // shard_rows)))

    plan = cut(sums.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda k, t: by_source(t[["_source", "v", "n"]]), "_source string, v long, n long, target double, quota long, shards long"))
    placed = lambda rows: rows.join(plan.withColumnRenamed("_source", "_name"), F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_shard", F.pmod("_order", F.col("shards")))
    parts = placed(light.select("_source", "_size", "_order")).groupBy("_source", "_shard").agg(F.sum("_size").alias("w"), F.first("quota").alias("quota"))

    def by_shard(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_shard", ignore_index=True)
        return pd.DataFrame({"_source": t._source, "_shard": t._shard, "words": np.minimum(sainte_lague(t.w.to_numpy(), int(t.quota.iloc[0])) * block, (t.w * cap).astype("int64")), "w": t.w})

    quotas = cut(parts.groupBy("_source").applyInPandas(by_shard, "_source string, _shard long, words long, w long"))
    names = quotas.select(F.col("_source").alias("_name2"), F.col("_shard").alias("_shard2"), "words", "w")
    rows = placed(base if text in carry else light).join(names, F.col("_source").eqNullSafe(F.col("_name2")) & (F.col("_shard") == F.col("_shard2")))
    end = F.sum("_size").over(Window.partitionBy("_source", "_shard").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_end", end)
    passes = F.when(F.col("w") > 0, F.floor(F.col("words") / F.col("w"))).otherwise(0)
    part = F.least(F.col("_size"), F.greatest(F.lit(0), F.col("words") - passes * F.col("w") - (F.col("_end") - F.col("_size"))))
    results = [F.col("_size"), F.col("v"), F.col("target"), (passes * F.col("_size") + part).cast("long")]
    return rows.select(*(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)), *(x.alias(n) for x, n in zip(results, result_names(carry)[:4], strict=True)))


def take(mixed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The mix itself: a row for each whole pass over a document, and one with the words that a last block cuts off."""
    size, _, _, taken, run = result_names(columns)
    whole = F.floor(F.col(taken) / F.greatest(size, F.lit(1))).cast("int")
    rest = (F.col(taken) - whole * F.col(size)).cast("int")
    runs = F.array_repeat(F.lit(-1), whole)
    runs = F.when(rest > 0, F.concat(runs, F.array(rest))).otherwise(runs)
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col(run)), "")
    rows = mixed.withColumn(run, F.explode(runs))
    rows = rows.withColumn(text, F.when(F.col(run) < 0, F.col(text)).otherwise(head))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col(run) < 0, F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return rows.select(*(F.col(f"`{c}`") for c in columns))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, ["doc_id"]).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))
