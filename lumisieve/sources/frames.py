"""Frames: raw files, random bytes, pictures, synthetic images.

Frames are rows (image_id, frame_idx, fmt, pixels), with width and height where they need not be 512.  Raw files hold frames one after the
other without headers.  A file that ends between rows of a frame drops that frame; one that
ends inside a row is an error, or a row with an error text if ``permissive``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.constants import SIZE
from ..functions.runtime import batch_rows, ship
from ..operators.hashing import BYTES, Made, few

FRAME_COLUMNS = ["image_id", "frame_idx", "fmt", "pixels"]


def frame_bytes(fmt: str) -> int:
    if fmt not in BYTES:
        raise ValueError(f"unknown input format {fmt!r}; one of {', '.join(BYTES)}")
    return SIZE * SIZE * BYTES[fmt]


def tail(length: Column, fmt: str) -> Column:
    """What a file's last bytes are: complete, dropped (whole rows only) or error (ends inside a row)."""
    size, row = frame_bytes(fmt), SIZE * BYTES[fmt]
    return F.when(length % size == 0, "complete").when(length % row == 0, "dropped").otherwise("error")


def split(files: DataFrame, fmt: str = "luma8", permissive: bool = False) -> DataFrame:
    """Frames of rows (path, length, content), as the binaryFile source has them; permissive adds ``error``."""
    size = frame_bytes(fmt)
    kind = tail(F.col("length"), fmt)
    message = F.concat(F.lit("unexpected end of file inside a row: "), F.col("path"))
    rows = files.withColumn("n", F.floor(F.col("length") / size).cast("int"))
    if permissive:
        rows = rows.withColumn("error", F.when(kind == "error", message))
    else:
        rows = rows.withColumn("n", F.when(kind == "error", F.raise_error(message).cast("int")).otherwise(F.col("n")))
    more = ["error"] if permissive else []
    at = F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))) if permissive else F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("path", "content", *more, at.alias("i"))
    cut = F.substr(F.col("content"), F.col("i") * size + 1, F.lit(size))
    return rows.select(F.xxhash64("path", "i").alias("image_id"), F.col("i").cast("long").alias("frame_idx"), F.lit(fmt).alias("fmt"), cut.alias("pixels"), *more)


def read_raw(spark: SparkSession, path: str, fmt: str = "luma8", permissive: bool = False) -> DataFrame:
    """Frames of headerless files through Spark's own reader: a file is one row there, of 2 GB at most (else :func:`~.splittable.read_frames`)."""
    frame_bytes(fmt)
    return split(spark.read.format("binaryFile").load(path).select("path", "length", "content"), fmt, permissive)


def stream_raw(spark: SparkSession, path: str, fmt: str = "luma8") -> DataFrame:
    """The same, as a stream of files."""
    frame_bytes(fmt)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return split(spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "length", "content"), fmt)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of any size through Spark's image source (which has blue, green, red), as frames with width, height, path and error.

    A file that is no picture keeps its row, with null pixels and an error text.
    """
    rows = spark.read.format("image").load(path).select("image.*")
    ship(spark), batch_rows(spark, 1)  # a picture can be large

    def to_rgb(batches):
        for batch in batches:
            out = []
            for raw, channels in zip(batch.column(1), batch.column(2).to_pylist()):
                px = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, channels) if raw.is_valid and channels and channels > 0 else None
                out.append(None if px is None else np.repeat(px, 3, axis=1).tobytes() if channels == 1 else px[:, 2::-1].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 3, 4, 5)), pa.array(out, pa.binary())], ["image_id", "width", "height", "path", "pixels"])

    got = rows.select(F.xxhash64("origin").alias("image_id"), "data", "nChannels", "width", "height", "origin").mapInArrow(to_rgb, "image_id long, width int, height int, path string, pixels binary")
    bad = F.when(F.col("pixels").isNull(), F.concat(F.lit("not a picture: "), F.col("path")))
    return got.select("image_id", F.lit(0).cast("long").alias("frame_idx"), F.lit("rgb8").alias("fmt"), "pixels", "width", "height", "path", bad.alias("error"))


def random_frames(spark: SparkSession, n: int, fmt: str = "luma8", seed: int = 0) -> DataFrame:
    """n frames of seeded random bytes; a frame depends on its number and the seed alone."""
    return random_frames_of(spark.range(n).withColumnRenamed("id", "image_id"), fmt, seed)


def random_frames_of(ids: DataFrame, fmt: str = "luma8", seed: int = 0) -> DataFrame:
    """A random frame for each image_id."""
    return random_made(ids, fmt, seed).frames().select("image_id", F.col("image_id").alias("frame_idx"), "fmt", "pixels")


def random_made(ids: DataFrame, fmt: str = "luma8", seed: int = 0) -> Made:
    """The same, made where they are read."""
    size = frame_bytes(fmt)

    def make(batches):
        for batch in few(batches):
            ids = batch.column(0)
            pixels = pa.array([np.random.default_rng([seed, i]).bytes(size) for i in ids.to_pylist()], pa.binary())
            yield _framed(ids, pixels, fmt, [(SIZE, SIZE)] * len(ids))

    return Made(ids.select(F.col("image_id").cast("long").alias("image_id")), make)


def _framed(ids: pa.Array, pixels: pa.Array, fmt: str, shape: list[tuple[int, int]]) -> pa.RecordBatch:
    width, height = (pa.array([wh[k] for wh in shape], pa.int32()) for k in (0, 1))
    return pa.RecordBatch.from_arrays([ids, pixels, pa.array([fmt] * len(ids), pa.string()), width, height], list(Made.kinds))


def synthetic_frames(parts: DataFrame, fmt: str = "luma8", sizes: tuple[tuple[int, int], ...] = ((SIZE, SIZE),)) -> DataFrame:
    """A frame for every row of part, as rows: those of :func:`synthetic`."""
    return synthetic(parts, fmt, sizes).frames().select("image_id", F.lit(0).cast("long").alias("frame_idx"), "fmt", "pixels", "width", "height")


def synthetic(parts: DataFrame, fmt: str = "luma8", sizes: tuple[tuple[int, int], ...] = ((SIZE, SIZE),)) -> Made:
    """A frame for every row of part, made where it is read: integer planes made of two products of a row and a column pattern.

    Part k has the width and height that stand at k modulo their number in ``sizes``.

    Pixel (r, c) of part k with size s is a1(r) * b1(c) + a2(r) * b2(c), from 0 to 252, with
    a1 = ((r * (3 + s % 7)) / 32 + k) % 8, b1 = ((c * (5 + k % 11)) / 24 + s) % 19,
    a2 = (((r + k) * (1 + k % 5)) / 16) % 8, b2 = (((c + 3 * s) * (2 + s % 5)) / 20) % 19,
    in whole numbers.  In rgb8 and rgba8 the channels are the plane, its complement and the plane halved.
    """
    frame_bytes(fmt)
    depth = BYTES[fmt]

    def make(batches):
        for batch in few(batches):
            keys, shape = batch.column(0).to_pylist(), [sizes[k % len(sizes)] for k in batch.column(0).to_pylist()]
            ends = np.cumsum([0] + [w * h * depth for w, h in shape])
            raw = np.empty(ends[-1], np.uint8)
            for k, s, (w, h), a, b in zip(keys, batch.column(1).to_pylist(), shape, ends, ends[1:]):
                x, y = np.arange(w), np.arange(h)
                a1, b1 = ((y * (3 + s % 7)) // 32 + k) % 8, ((x * (5 + k % 11)) // 24 + s) % 19
                a2, b2 = (((y + k) * (1 + k % 5)) // 16) % 8, (((x + 3 * s) * (2 + s % 5)) // 20) % 19
                # a row is one of 64, as its a1 and a2 are
                each = np.arange(8, dtype=np.uint8)
                v = (np.multiply.outer(each, b1.astype(np.uint8))[:, None] + np.multiply.outer(each, b2.astype(np.uint8))).reshape(64, w)
                some = v if depth == 1 else np.stack([v, 255 - v, v // 2, np.full_like(v, 128)][:depth], axis=-1)
                np.take(some.reshape(64, w * depth), 8 * a1 + a2, axis=0, out=raw[a:b].reshape(h, w * depth), mode="clip")
            yield _framed(batch.column(0), pa.Array.from_buffers(pa.binary(), len(shape), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]), fmt, shape)

    return Made(parts.select(F.col("p_partkey").cast("long").alias("image_id"), F.col("p_size").cast("long").alias("p_size")), make)
