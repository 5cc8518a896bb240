"""Readers and writers of the binary log records, as Arrow batches, and file names.

A write-ahead record is uvarint key length, value length, meta and expiry, then key, value and a
CRC32-Castagnoli of all of it, little endian. A value-log record is uvarint key and value length, key,
value and checksum. A reader stops at a torn tail and fails on a wrong checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.crc import crc32c


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it); raises IndexError at a torn end."""
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def wal_record(key: bytes, value: bytes, expire_at: int = 0, meta: int = 0) -> bytes:
    body = uvarint(len(key)) + uvarint(len(value)) + uvarint(meta) + uvarint(expire_at) + key + value
    return body + crc32c(body).to_bytes(4, "little")


def vlog_record(key: bytes, value: bytes) -> bytes:
    body = uvarint(len(key)) + uvarint(len(value)) + key + value
    return body + crc32c(body).to_bytes(4, "little")


def records(data: bytes, fields: int, longest_key: int = 1 << 16, start: int = 0) -> Iterator[tuple]:
    """(offset, length, key, value, other header fields) of each whole record from ``start`` on."""
    at = start
    while at < len(data):
        try:
            head, place = [], at
            for _ in range(fields):
                x, place = read_uvarint(data, place)
                head.append(x)
        except IndexError:
            return
        end = place + head[0] + head[1]
        if head[0] == 0 or head[0] > longest_key or end + 4 > len(data):
            return
        if crc32c(data[at:end]) != int.from_bytes(data[end : end + 4], "little"):
            raise ValueError(f"wrong checksum at {at}")
        yield at, end + 4 - at, data[place : place + head[0]], data[place + head[0] : end], head[2:]
        at = end + 4


def _rows(batches: Iterator[pa.RecordBatch], wal: bool, start: int = 0) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(path, *r) for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in records(data, 4 if wal else 2, start=start)]
        cols = [pa.array([r[i] for r in out], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()), (3, pa.binary()), (4, pa.binary()))]
        names = ["path", "offset", "len", "key", "value"]
        if wal:
            cols += [pa.array([r[5][0] for r in out], pa.int32()), pa.array([r[5][1] for r in out], pa.int64())]
            names += ["meta", "expire_at"]
        yield pa.RecordBatch.from_arrays(cols, names)


def valid_ends(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(fid, valid_end): where the whole records of each file end; what follows is a torn tail to cut off."""
    fields = 4 if kind == "wal" else 2

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = [max((r[0] + r[1] for r in records(x, fields)), default=0) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(last, pa.int64())], ["path", "valid_end"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")
    return files.mapInArrow(ends, "path string, valid_end bigint").select(fid_of(F.col("path")).alias("fid"), "valid_end")


def read_records(spark: SparkSession, path: str, kind: str, start: int = 0) -> DataFrame:
    """Rows of .wal or .vlog files from an offset on: fid from the name, offset and length in the file, the record's fields.

    A file is one task's work; logs rotate at a bounded size.
    """
    wal = kind == "wal"
    more = ", meta int, expire_at bigint" if wal else ""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")
    out = files.mapInArrow(lambda it: _rows(it, wal, start), f"path string, offset bigint, len bigint, key binary, value binary{more}")
    return out.withColumn("fid", fid_of(F.col("path"))).drop("path")


def fid_of(path: Column) -> Column:
    """The number in a file's name."""
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("bigint")


def file_name(fid: Column, kind: str) -> Column:
    return F.concat(F.lpad(fid.cast("string"), 5, "0"), F.lit(f".{kind}"))
