"""Rates of running streams, and a soak test."""

from __future__ import annotations

import sys
import time
from collections import deque
from dataclasses import dataclass

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.hashing import hash_frames
from ..sources.frames import random_frames_of


@dataclass
class Rate:
    query: str
    batch: int
    frames: int
    seconds: float

    @property
    def per_second(self) -> float:
        return self.frames / self.seconds if self.seconds else 0.0


class FrameRates(StreamingQueryListener):
    """Keeps the frames and seconds of the last batches of every stream; says them as they come if asked to.

    with FrameRates(spark) as rates: ... listens inside the block.
    """

    def __init__(self, spark: SparkSession, keep: int = 1000, say: bool = False):
        self.spark, self.say = spark, say
        self.rates: deque[Rate] = deque(maxlen=keep)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rate = Rate(str(p.runId), p.batchId, p.numInputRows, p.batchDuration / 1000)
        self.rates.append(rate)
        if self.say and rate.frames:
            print(f"{rate.per_second:.1f} frames a second", file=sys.stderr, flush=True)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)] = event.exception

    def total(self, query: str | None = None) -> Rate:
        """Frames and seconds of all batches that are kept, or of one query's."""
        mine = [r for r in self.rates if query is None or r.query == query]
        return Rate(query or "all", len(mine), sum(r.frames for r in mine), sum(r.seconds for r in mine))

    def __enter__(self) -> FrameRates:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)


def soak(spark: SparkSession, seconds: float = 10, per_second: int = 200, mode: str = "variant", dihedrals: bool = False) -> Rate:
    """Hashes random frames that arrive at a rate, for so long; fails if the stream does, or if a batch with frames never ends."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    hashes = hash_frames(random_frames_of(ticks.select(F.col("value").alias("image_id"))), mode, dihedrals)
    with FrameRates(spark) as rates:
        query = hashes.writeStream.format("noop").outputMode("append").start()
        run, end = str(query.runId), time.time() + seconds
        try:
            while time.time() < end and query.isActive:
                query.awaitTermination(1)
        finally:
            query.stop()
        if query.exception():
            raise query.exception()
        waited = time.time() + 10  # progress comes by another thread
        while not rates.total(run).frames and time.time() < waited:
            time.sleep(0.1)
        found = rates.total(run)
    if not found.frames:
        raise RuntimeError(f"no frame was hashed in {seconds} seconds")
    return found
