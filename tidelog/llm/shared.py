"""Helpers the operators share: checkpoint folder, written tables, word bytes, hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only; every other byte stays.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session. Where it is unset, a temporary one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = got.get() if got.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage of a small table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of plans that nothing refers to any more; it goes by the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


#: Paths of the tables stashed in each open scope, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stashed inside are deleted at the end; what is used later must have been cut from them by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _SCOPES.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table from ``stash``; nothing that is still to run may read it."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def stash(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again, so that later passes reuse it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    free(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed = path
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch holds, whatever the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of rows of about ``most`` together, one row at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def release() -> None:
    """Gives freed memory back to the system, so that a worker that is used again doesn't keep its peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only the GNU C library has it
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHash:
    """64-bit hashes of words, remembered between texts up to a bound."""

    def __init__(self, bound: int = 400_000) -> None:
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.bound:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), U64, len(words))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence where there are fewer; none of none."""
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, U64)
    for i in range(size):
        out = (out + h[i : i + len(out)]) * GOLDEN
        out ^= out >> U64(29)
    return mix64(out)


def words_of(text: Column | str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 of null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
