"""Operator 8: media columns as progressive JPEG.

``store`` puts bytes into the coefficients of a 4:2:0 colour image, the format's unit: 64 bytes are the 64
coefficients of a block, in zigzag order, so nothing is lost; ``load`` reads files back by accumulating
their scans; ``features`` transforms the coefficients, replicates chroma and sums up the RGB tensor.
Both work on batches of files of bounded size, whatever the number of rows.

Defined cases: a null payload is an empty one; an empty payload is one block of zeros; equal payloads give
equal files and features, whatever they are batched with; a payload is limited by the format to
4095 x 4095 units of 384 bytes (6 GB).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import jpeg
from tidelog.llm.shared import slices, small_batches

UNIT = 64
SLICE = 4 << 20  # bytes that are coded at a time


def padded(size: int) -> int:
    return max(UNIT, -(-size // UNIT) * UNIT)


def shape_of(size: int) -> tuple[int, int]:
    """Width and height of the image for a padded size: units of 16 x 16 pixels, about square."""
    n = -(-size // (6 * UNIT))
    across = math.isqrt(n - 1) + 1
    return 16 * across, 16 * -(-n // across)


def store(payloads: list[bytes]) -> list[bytes]:
    """Files of payloads; each notes its number of bytes before and after padding."""
    sizes = [padded(len(p)) for p in payloads]
    shapes = [shape_of(n) for n in sizes]
    rooms = [w * h // 256 * 6 * UNIT for w, h in shapes]
    raw = b"".join(p + bytes(r - len(p)) for p, r in zip(payloads, rooms, strict=True))
    coef = np.frombuffer(raw, np.uint8).reshape(-1, UNIT).astype(np.int32)
    return jpeg.write(coef, shapes, [f"{len(p)} {n}".encode() for p, n in zip(payloads, sizes, strict=True)])


def load(files: list[bytes]) -> tuple[list[bytes], np.ndarray, list[jpeg.Image]]:
    """Payloads, still padded, of files that ``store`` made, and their coefficients."""
    coef, images = jpeg.read(files)
    raw = coef.astype(np.uint8).tobytes()
    return [raw[im.base * UNIT : im.base * UNIT + int(im.note.split()[1])] for im in images], coef, images


def tensors(coef: np.ndarray, images: list[jpeg.Image]) -> Iterator[np.ndarray]:
    """The RGB tensor of each image."""
    plain = all(set(q) == {1} for im in images for q in im.quant)
    blocks = jpeg.samples(coef) if plain else None
    for i, im in enumerate(images):
        end = images[i + 1].base if i + 1 < len(images) else len(coef)
        if blocks is None:
            scale = np.ones((end - im.base, UNIT))
            for (first, across, down, _, _), q in zip(jpeg.layout(im.width, im.height, im.sampling)[0], im.quant, strict=True):
                scale[first : first + across * down] = q
            yield jpeg.rgb(jpeg.samples(coef[im.base : end] * scale), im)
        else:
            yield jpeg.rgb(blocks[im.base : end], im)


def feature(x: np.ndarray) -> str:
    """Size, channel sums and a checksum of the tensor."""
    sums = x.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{x.shape[1]}x{x.shape[0]};{sums[0]};{sums[1]};{sums[2]};{zlib.crc32(x):08x}"


def _over(docs: DataFrame, column: str, carry: list[str], fields: list[T.StructField], work) -> DataFrame:
    """``carry`` and what ``work`` makes of the column's bytes, a bounded number of bytes at a time."""
    small_batches(docs.sparkSession)
    kept = [f"_c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column("_t").to_pylist()]
            for s in slices([len(x) for x in raw], SLICE):
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *work(raw[s])], [*kept, *(f.name for f in fields)])

    named = docs.select(*(F.col(c).alias(k) for k, c in zip(kept, carry, strict=True)), F.col(column).cast("binary").alias("_t"))
    out = named.mapInArrow(run, T.StructType([*named.schema.fields[:-1], *fields]))
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)), *(f.name for f in fields))


def encode_media(docs: DataFrame, carry: list[str], column: str = "text") -> DataFrame:
    """``carry`` and _media, the JPEG file of the column's bytes."""
    return _over(docs, column, carry, [T.StructField("_media", T.BinaryType())], lambda raw: [pa.array(store(raw), pa.binary())])


def decode_media(files: DataFrame, carry: list[str], column: str = "_media") -> DataFrame:
    """``carry``, _payload (padded), _height, _width, and _rgb, the bytes of the full-resolution tensor."""

    def work(raw: list[bytes]) -> list[pa.Array]:
        payloads, coef, images = load(raw)
        return [pa.array(payloads, pa.binary()), pa.array([im.height for im in images], pa.int32()), pa.array([im.width for im in images], pa.int32()), pa.array([x.tobytes() for x in tensors(coef, images)], pa.binary())]

    fields = [T.StructField("_payload", T.BinaryType()), T.StructField("_height", T.IntegerType()), T.StructField("_width", T.IntegerType()), T.StructField("_rgb", T.BinaryType())]
    return _over(files, column, carry, fields, work)


DIGEST = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]


def media_digest(docs: DataFrame, carry: list[str], column: str = "text") -> DataFrame:
    """``carry`` and sizes, hashes and features: bytes are stored, the files read back, and what was read is digested."""

    def work(raw: list[bytes]) -> list[pa.Array]:
        files = store(raw)
        payloads, coef, images = load(files)
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        n = lambda xs: pa.array(list(xs), pa.int64())
        return [n(int(im.note.split()[0]) for im in images), n(map(len, payloads)), sha(payloads), n(zlib.crc32(p[-UNIT:]) for p in payloads), n(map(len, files)), sha(files), pa.array([feature(x) for x in tensors(coef, images)])]

    return _over(docs, column, carry, [T.StructField(c, T.LongType() if t == "long" else T.StringType()) for c, t in DIGEST], work)


def op8_media(spark, sf_dir: str) -> DataFrame:
    return media_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
