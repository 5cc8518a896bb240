"""Operator 10: quality rules with robust multivariate outliers.

Every document gets count statistics of its whole text. Within each (language, source) group a
minimum-covariance-determinant (MCD) estimate of a transformed statistic vector is found by
concentration steps, each of them two distributed aggregations over all rows of all groups; a
document goes when its Mahalanobis distance is far beyond the group's bulk. Rows of groups below
``min_group`` rows are judged by an estimate over all rows of their language, those of a language
below it by one over all rows; only a table below it as a whole gets no verdict from the method.

Defined cases: a null or empty text has no words and fails the base rule; null language or source
is a group of its own; repeated rows count as often as they occur and get the same verdict; an
empty table gives an empty result; other columns are carried or left out as ``carry`` says, whatever
their names, since the statistics live in one struct column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import cut, release, small_batches, stash

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct")
VECTOR = 4
SYMBOLS = b"#*$%&|<>"
#: ASCII punctuation; letters beyond ASCII are not in it.
PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = b" \t\n\r\x0b\x0c"
_CONT = bytes(range(0x80, 0xC0))
STEP = 32  # cells of the distance histogram to a doubling


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words found twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = x[:n].copy()
    for i in range(1, size):
        if i > 1:  # renumber, so that products stay below 2^63 for any length
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
        key = key * len(ids) + x[i : i + n]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[back.reshape(-1)] > 1
    cover = np.zeros(len(words), bool)
    for i in range(size):
        cover[i : i + n] |= hit
    return int(cover.sum())


def count_text(b: bytes) -> tuple[int, ...]:
    words = b.split()
    if not words:
        return (0,) * len(COUNTS)
    solid = b.translate(None, SPACE)
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    upper = len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words), len(solid.translate(None, _CONT)), len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeat_words(words), upper, len(solid) - len(solid.translate(None, PUNCT)),
    )


def _count(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [count_text(x or b"") for x in batch.column(text).cast(pa.binary()).to_pylist()]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.StructArray.from_arrays(cols, list(COUNTS))], [*keep, name])
        del batch, rows, cols
    release()  # the worker waits for its next task beside what runs then


def text_stats(docs: DataFrame, carry: list[str], text: str = "text", name: str = "_stats") -> DataFrame:
    """``carry`` and a struct of counts of each whole text."""
    small_batches(docs.sparkSession)
    need = list(dict.fromkeys([*carry, text]))
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    return docs.select(*need).mapInArrow(lambda it: _count(it, text, carry, name), schema)


def vector(s: str = "_stats") -> Column:
    """The statistic vector: word length, symbols, capitals and punctuation, roots to even out spread.

    A few pseudo-counts keep short texts from looking extreme by chance.
    """
    g = lambda c: F.col(f"{s}.{c}").cast("double")
    n = g("word_chars") + 20.0
    return F.array(F.log((g("word_chars") + 50.0) / (g("n_words") + 10.0)), F.sqrt((g("n_symbols") + 0.1) / n), F.sqrt((g("n_upper") + 0.5) / n), F.sqrt((g("n_punct") + 0.6) / n))


def base_failed(s: str = "_stats") -> Column:
    n, r = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def _group() -> Column:
    return F.concat_ws("\x00", _key("_lang"), _key("_source"))


def _distance(mean: str, inverse: str) -> Column:
    d = [F.col("_x")[i] - F.col(mean)[i] for i in range(VECTOR)]
    out = F.lit(0.0)
    for i in range(VECTOR):
        for j in range(i, VECTOR):
            out = out + F.col(inverse)[i * VECTOR + j] * (d[i] * d[j] * (1.0 if i == j else 2.0))
    return out


def _cell(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * STEP).cast("int")


def _first(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Medians and quartile spreads to a diagonal start."""
    for t in rows:
        out = []
        for g, mids, spread in zip(t._g, t.mid, t.spread, strict=True):
            inv = np.diag(1.0 / np.maximum(np.asarray(spread, float), 0.01) ** 2)
            out.append((g, list(map(float, mids)), inv.reshape(-1).tolist()))
        yield pd.DataFrame(out, columns=["_g", "_m", "_i"])


def _moments(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over the concentrated half to mean and inverse covariance, rounded so that the order of sums cannot show."""
    for t in rows:
        out = []
        for g, n, s, p in zip(t._g, t.n, t.s, t.p, strict=True):
            m = np.asarray(s, float) / n
            c = np.asarray(p, float).reshape(VECTOR, VECTOR) / n - np.outer(m, m)
            c = (c + c.T) / 2 + np.eye(VECTOR) * 1e-4
            out.append((g, np.round(m, 9).tolist(), [float(f"{x:.8g}") for x in np.linalg.inv(c).reshape(-1)]))
        yield pd.DataFrame(out, columns=["_g", "_m", "_i"])


PARAMS = "_g string, _m array<double>, _i array<double>"


def fit(stats: DataFrame, h: float = 0.75, steps: int = 4, min_group: int = 50) -> tuple[DataFrame, DataFrame]:
    """MCD of every group: (the group _g that judges each language and source _k, parameters by _g with the bulk's median distance).

    ``stats`` has _lang, _source and _x. Medians, subsets of the h nearest and their moments are
    aggregations over all rows. A row counts in its own group, and in its language and in the table
    where these judge a group that is too small.
    """
    sizes = stats.groupBy(_group().alias("_k"), _key("_lang").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    langs = sizes.groupBy(F.col("_l").alias("_l2")).agg(F.sum("_n").alias("_ln"), F.min("_n").alias("_least"))
    levels = cut(sizes.join(langs, F.col("_l") == F.col("_l2")).select("_k", "_l", "_n", "_ln", "_least"))
    large, wide = F.col("_n") >= min_group, F.col("_ln") >= min_group
    every = not levels.filter(~wide).isEmpty()
    into = F.array(F.when(large, F.col("_k")), F.when(wide & (F.col("_least") < min_group), F.col("_l")), F.when(F.lit(every), F.lit("")))
    rows = stash(stats.select(_group().alias("_k"), "_x").join(levels.select("_k", F.array_compact(into).alias("_into")), "_k").select(F.explode("_into").alias("_g"), "_x"))
    levels = levels.select("_k", F.when(large, F.col("_k")).when(wide, F.col("_l")).otherwise("").alias("_g"))
    cells = rows.select("_g", F.posexplode(F.transform("_x", lambda v: F.floor(v * 512).cast("int"))).alias("_d", "_c")).groupBy("_g", "_d", "_c").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_g", "_d")
    run = cells.withColumn("r", F.sum("n").over(w.orderBy("_c"))).withColumn("t", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("r") >= F.col("t") * q, F.col("_c")))
    mids = run.groupBy("_g", "_d").agg((at(0.5) / 512.0).alias("m"), ((at(0.75) - at(0.25)) / 512.0 / 1.349).alias("s"), F.max("t").alias("t"))
    start = mids.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_d", "m", "s"))).alias("a"), F.max("t").alias("t")).filter(F.col("t") >= min_group)
    params = cut(start.select("_g", F.col("a.m").alias("mid"), F.col("a.s").alias("spread")).mapInPandas(_first, PARAMS))
    g = Window.partitionBy("_g")
    for _ in range(steps):
        near = rows.join(params, "_g").withColumn("_c", _cell(_distance("_m", "_i")))
        hist = near.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.sum("n").over(g.orderBy("_c"))).withColumn("t", F.sum("n").over(g))
        edge = hist.groupBy("_g").agg(F.min(F.when(F.col("r") >= F.col("t") * h, F.col("_c"))).alias("_e"))
        x = F.col("_x")
        sums = [F.sum(x[i]) for i in range(VECTOR)], [F.sum(x[i] * x[j]) for i in range(VECTOR) for j in range(VECTOR)]
        inner = near.join(edge, "_g").filter("_c <= _e").groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.array(*sums[0]).alias("s"), F.array(*sums[1]).alias("p"))
        params = cut(inner.mapInPandas(_moments, PARAMS))
    last = rows.join(params, "_g").groupBy("_g", _cell(_distance("_m", "_i")).alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    last = last.withColumn("r", F.sum("n").over(g.orderBy("_c"))).withColumn("t", F.sum("n").over(g))
    middle = last.groupBy("_g").agg(F.pow(2.0, F.min(F.when(F.col("r") >= F.col("t") * 0.5, F.col("_c"))) / STEP).alias("_mid"))
    return levels, cut(params.join(middle, "_g"))


#: Median of the chi-squared distribution with VECTOR degrees of freedom.
CHI_MEDIAN = 3.3567


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, cutoff: float = 400.0, min_group: int = 50) -> DataFrame:
    """``carry`` columns, counts, base_failed, outlier (null without a verdict) and kept of each row.

    ``cutoff`` bounds the squared Mahalanobis distance in units where the bulk's median is that of
    a Gaussian; it is far out, so that clean text of an unusual kind stays.
    """
    carry = list(docs.columns if carry is None else carry)
    named = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_t"))
    kept = [f"_c{i}" for i in range(len(carry))]
    if text in carry:  # texts stay out of what is written; the last pass counts them again
        fitted = text_stats(named, ["_lang", "_source"], "_t").withColumn("_x", vector())
        full = text_stats(named, [*kept, "_lang", "_source"], "_t").withColumn("_x", vector())
    else:
        fitted = full = stash(text_stats(named, [*kept, "_lang", "_source"], "_t").withColumn("_x", vector()))
    levels, params = fit(fitted.filter(~base_failed()).select("_lang", "_source", "_x"), min_group=min_group)
    table = levels.join(params, "_g").select("_k", "_m", "_i", "_mid")
    judged = full.withColumn("_k", _group()).join(table, "_k", "left").withColumn("_d2", _distance("_m", "_i") / F.col("_mid") * CHI_MEDIAN)
    out = F.col("_d2") > cutoff
    return judged.select(
        *(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)), F.col("_stats"), base_failed().alias("_base_failed"), F.col("_d2").alias("_distance"), (~base_failed() & ~F.coalesce(out, F.lit(False))).alias("_kept")
    )


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality_rules(docs, carry=["doc_id"])
    return out.select("doc_id", *(F.col(f"_stats.{c}").alias(c) for c in COUNTS[:5]), F.col("_base_failed").alias("base_failed"), F.round("_distance", 4).alias("distance"), F.col("_kept").alias("kept"))
