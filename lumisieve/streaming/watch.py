"""Screening a stream of frames against needles that change while it runs.

A :class:`NeedleBook` is a resident store of needles to which batches are added and from which
needles are retired, from any session, at any time; there may be more of them than can be
broadcast.  Every micro-batch of frames sees one version of the book: the one that was there when
the batch was first tried, which is written down before anything is matched.  A batch that is
tried again, after a lost driver too, is matched against the same version and
replaces what it had written, so results do not depend on failures.

Frames of a batch are the smaller side: their hashes are what is looked up in the store, by
scan or index as their numbers ask, and the needles are not moved - unless comparing all rows would cost
more than to bring equal hashes of both sides together, and then different hashes are compared once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import DEFAULT_RADIUS
from ..functions.expr import WORDS
from ..functions.runtime import exists, passing, stored
from ..operators.hashing import Made, hash_frames
from ..operators.matching import Matcher, all_distinct
from ..operators.store import HashStore

FOUND = "needle_id long, image_id long, dist int"
_VERSION = "added array<long>, retired array<long>"


@dataclass(frozen=True)
class Version:
    """Numbers of the batches of needles, and of the retirements, that are seen."""

    added: tuple[int, ...]
    retired: tuple[int, ...]


class NeedleBook:
    """Needles (needle_id, w0..w3) under one path; a needle_id that was retired stays so."""

    def __init__(self, spark: SparkSession, path: str):
        """Opens the book at a path that :meth:`create` has made."""
        self.spark, self.path = spark, path.rstrip("/")
        self.store = HashStore(spark, f"{self.path}/needles")
        spark.catalog.refreshTable(self.store.name)  # another session may have added some

    @classmethod
    def create(cls, spark: SparkSession, path: str, needles: DataFrame | None = None, buckets: int | None = None) -> NeedleBook:
        HashStore.create(spark, f"{path.rstrip('/')}/needles", buckets=buckets)
        book = cls(spark, path)
        if needles is not None:
            book.add(needles)
        return book

    def add(self, needles: DataFrame) -> None:
        self.store.append(needles.select(F.col("needle_id").alias("hash_id"), *WORDS))

    def retire(self, ids: DataFrame) -> None:
        """Takes needles (needle_id) out of later versions; all of them at once, by a last small write."""
        number = uuid.uuid4().int >> 65
        ids.select(F.col("needle_id").cast("long").alias("needle_id"), F.lit(number).alias("retirement")).write.mode("append").parquet(f"{self.path}/retired")
        self.spark.range(1).select(F.lit(number).alias("retirement")).write.mode("append").parquet(f"{self.path}/retirements")

    def version(self) -> Version:
        """What is there now."""
        fresh = HashStore(self.spark, self.store.path)
        gone = _rows(self.spark, f"{self.path}/retirements", "retirement long").collect()  # a row for each retirement
        return Version(tuple(sorted(fresh._batches)), tuple(sorted(r.retirement for r in gone)))

    def needles(self, version: Version) -> HashStore:
        """The store as it was, retired needles included."""
        return HashStore(self.spark, self.store.path).only(version.added)

    def retired(self, version: Version) -> DataFrame:
        rows = _rows(self.spark, f"{self.path}/retired", "needle_id long, retirement long")
        return rows.where(F.col("retirement").isin(list(version.retired))).select("needle_id").distinct()

    def match(self, hashes: DataFrame, version: Version, radius: int = DEFAULT_RADIUS) -> DataFrame:
        """(needle_id, image_id, dist) of hashes (image_id, w0..w3) within the radius of a version's live needles."""
        store, retired = self.needles(version), self.retired(version)
        asked = Matcher(hashes.select(F.col("image_id").alias("needle_id"), *WORDS), radius)
        if asked.better_grouped(store):
            live = store.hashes().withColumnRenamed("hash_id", "needle_id")
            live = stored(live.join(retired, "needle_id", "left_anti") if version.retired else live, "live")
            found = all_distinct(live, hashes.withColumnRenamed("image_id", "hash_id"), radius)
            return found.select("needle_id", F.col("hash_id").alias("image_id"), "dist")
        found = asked.all(store)
        pairs = found.select(F.col("hash_id").alias("needle_id"), F.col("needle_id").alias("image_id"), "dist")
        return pairs.join(retired, "needle_id", "left_anti") if version.retired else pairs


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def pinned(book: NeedleBook, path: str) -> Version:
    """The version that is written at a path, or today's, written there first."""
    have = _rows(book.spark, path, _VERSION).first()
    if have is None:
        now = book.version()
        book.spark.createDataFrame([(list(now.added), list(now.retired))], _VERSION).coalesce(1).write.mode("overwrite").parquet(path)
        return now
    return Version(tuple(have.added), tuple(have.retired))


def watch(frames: DataFrame | Made, book: str, out: str, checkpoint: str, radius: int = DEFAULT_RADIUS, least_quality: float = 0.5, **trigger) -> StreamingQuery:
    """Screens a stream of frames (image_id, pixels, fmt) against the book at a path; :func:`found` reads what is under ``out``.

    trigger: as for writeStream.trigger; what is there is taken and the query ends if none is given.
    An ``out`` folder belongs to one checkpoint: batches are numbered by it.
    """
    spark, out = frames.sparkSession, out.rstrip("/")
    make = frames.make if isinstance(frames, Made) else None
    rows = frames.rows if make else frames
    if exists(spark, f"{out}/_versions") and not exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{out} has results of another checkpoint")

    def screen(batch: DataFrame, number: int) -> None:
        mine = NeedleBook(batch.sparkSession, book)
        seen = pinned(mine, f"{out}/_versions/{number}")
        hashes = hash_frames(Made(batch, make) if make else batch).where(F.col("quality") > least_quality).select("image_id", *WORDS)
        # hashed once for the count and the match, in a place that the next batch takes over
        hashes.write.mode("overwrite").parquet(f"{out}/_hashes")
        hashes = batch.sparkSession.read.schema(hashes.schema).parquet(f"{out}/_hashes")
        with passing(batch.sparkSession):
            mine.match(hashes, seen, radius).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(screen).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def found(spark: SparkSession, out: str) -> DataFrame:
    """(needle_id, image_id, dist, batch) of all batches so far."""
    return _rows(spark, out, f"{FOUND}, batch long")
