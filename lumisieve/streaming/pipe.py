"""Endless streams of frames: hash, screen, write; and frames per second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.hashing import Made, hash_frames
from ..operators.matching import Matcher
from ..sources.sinks import parse, records
from ..sources.splittable import SINK, register


def pipe(frames: DataFrame | Made, mode: str = "variant", dihedrals: bool = False) -> DataFrame:
    """Hashes of a stream of frames; stateless, so rows go out as they come."""
    return hash_frames(frames, mode, dihedrals)


def screen(frames: DataFrame, needles: DataFrame, radius: int = 31, least_quality: float = 0.5) -> DataFrame:
    """(needle_id, hash_id, dist) of a stream's frames against fixed needles; hash_id is image_id."""
    hashes = hash_frames(frames).where(F.col("quality") > least_quality).select(F.col("image_id").alias("hash_id"), "w0", "w1", "w2", "w3")
    return Matcher(needles, radius).all(hashes)


def write(hashes: DataFrame, path: str, checkpoint: str, spec: str = "hex+nl") -> StreamingQuery:
    """Appends records of any format but diagnostic, each once also over restarts; what is there is taken and the query ends.

    Frames keep the order of their source: files in the order of their names are the records in order.
    """
    kind, _ = parse(spec)
    if kind == "diagnostic":
        raise ValueError("diagnostic needs all variants of an image together; write it in batches")
    register(hashes.sparkSession)
    rows = records(hashes, spec).select("record")
    return rows.writeStream.format(SINK).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def per_second(rows: DataFrame, at: Column) -> DataFrame:
    """(second, n): rows in each second, as --stats prints them; batch or stream (with a watermark on ``at``)."""
    return rows.groupBy(F.window(at, "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("second"), "n")


def drop_repeats(hashes: DataFrame, at: str, delay: str = "10 minutes") -> DataFrame:
    """A stream of hashes without those seen within the delay."""
    return hashes.withWatermark(at, delay).dropDuplicatesWithinWatermark(["hash"])
