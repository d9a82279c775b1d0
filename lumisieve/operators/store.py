"""A resident haystack: hashes stored once, with a band index that is never shuffled again.

Under one path lie the hashes themselves (what a scan with few needles reads), and the index: a
row for each of the 16 bands of each hash, bucketed by (band, key, salt) as Spark buckets
tables, so that a join on these keys reads it in place and only the needles' probes move.
Batches are appended with a number of their own, which a last small write makes visible:
an append that fails in between shows nothing.

How many rows each (band, key) has is counted with every batch (at most 16 x 65536 numbers).  They
say how many pairs a set of probes will meet, which decides between scan and index, and a
key with more than HOT rows in a batch is spread over several salts; probes of such keys
ask for all of them.
"""

from __future__ import annotations

import copy
import hashlib
import uuid
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expr import WORDS

BANDS, BAND_BITS = 16, 16
#: Rows of one (band, key) in one batch that share a salt.
HOT = 50_000
#: Index rows of one bucket, about.
BUCKET_ROWS = 1_000_000
KEYS = ("band", "key", "salt")


def band(words: list[Column], k: int) -> Column:
    """Sixteen bits of a hash, band 0 most significant."""
    return F.shiftright(words[k // 4], 48 - 16 * (k % 4)).bitwiseAND(0xFFFF).cast("int")


def banded(rows: DataFrame, words: list[Column]) -> DataFrame:
    """Sixteen rows for each, with ``band`` and ``key``."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), band(words, k).alias("key")) for k in range(BANDS))))
    return rows.withColumn("b", each).select(*rows.columns, "b.band", "b.key")


class HashStore:
    def __init__(self, spark: SparkSession, path: str):
        """Opens the store at a path that :meth:`create` has made."""
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/meta").first()
        self.buckets, self.indexed = meta["buckets"], meta["indexed"]
        self.name = "lumisieve_store_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (hash_id BIGINT, w0 BIGINT, w1 BIGINT, w2 BIGINT, w3 BIGINT, batch BIGINT, band INT, key INT, salt INT) USING parquet "
            f"CLUSTERED BY (band, key, salt) INTO {self.buckets} BUCKETS LOCATION '{self.path}/bands'"
        )

    @classmethod
    def create(cls, spark: SparkSession, path: str, hashes: DataFrame | None = None, buckets: int | None = None, indexed: bool = True) -> HashStore:
        """A new store; buckets for about ten times the given hashes if not named, 16 at least.  Without an index, which is
        sixteen times larger than the hashes, needles are always scanned for."""
        if buckets is None:
            buckets = 16 if not indexed else max(16, 10 * BANDS * (hashes.count() if hashes is not None else 0) // BUCKET_ROWS)
        spark.range(1).select(F.lit(int(buckets)).alias("buckets"), F.lit(indexed).alias("indexed")).write.parquet(f"{path.rstrip('/')}/meta")
        store = cls(spark, path)
        if hashes is not None:
            store.append(hashes)
        return store

    def append(self, hashes: DataFrame) -> None:
        """Adds rows (hash_id, w0..w3)."""
        batch = uuid.uuid4().int >> 65
        # files of hash_id ranges, so that a search in order of hash_id reads only the first of them
        ranged = hashes.select("hash_id", *WORDS).repartitionByRange("hash_id").sortWithinPartitions("hash_id")
        ranged.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.path}/hashes")
        mine = self.spark.read.schema(f"{self._columns()}, batch long").parquet(f"{self.path}/hashes").where(F.col("batch") == batch)
        if self.indexed:
            self._index(mine, batch)
        n, lo, hi = mine.agg(F.count(F.lit(1)), F.min("hash_id"), F.max("hash_id")).first()
        kinds = {"batch": batch, "n": n, "lo": lo, "hi": hi}
        self.spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in kinds.items())).write.mode("append").parquet(f"{self.path}/batches")
        self.spark.catalog.refreshTable(self.name)
        for known in ("_batches", "rows", "bounds"):
            self.__dict__.pop(known, None)

    def _index(self, mine: DataFrame, batch: int) -> None:
        rows = banded(mine, [F.col(w) for w in WORDS])
        counts = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / HOT).cast("int"))
        counts.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.path}/counts")
        hot = self.spark.read.parquet(f"{self.path}/counts").where((F.col("batch") == batch) & (F.col("salts") > 1)).select("band", "key", "salts")
        salt = F.pmod(F.xxhash64("hash_id"), F.coalesce("salts", F.lit(1))).cast("int")
        rows = rows.join(F.broadcast(hot), ["band", "key"], "left").select("hash_id", *WORDS, "batch", "band", "key", salt.alias("salt"))  # at most as many as there are keys
        rows.repartition(self.buckets, *KEYS).write.insertInto(self.name)

    @staticmethod
    def _columns() -> str:
        return "hash_id long, " + ", ".join(f"{w} long" for w in WORDS)

    @cached_property
    def _batches(self) -> dict[int, tuple[int, int | None, int | None]]:
        from pyspark.errors import AnalysisException

        try:
            return {r.batch: (r.n, r.lo, r.hi) for r in self.spark.read.schema("batch long, n long, lo long, hi long").parquet(f"{self.path}/batches").collect()}  # a row for each append
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}

    def only(self, batches: Iterable[int]) -> HashStore:
        """The same store with no batches but these; what is appended later is not seen."""
        view = copy.copy(self)
        for known in ("rows", "bounds"):
            view.__dict__.pop(known, None)
        view.__dict__["_batches"] = {b: self._batches[b] for b in batches}
        return view

    @cached_property
    def rows(self) -> int:
        return sum(n for n, *_ in self._batches.values())

    @cached_property
    def bounds(self) -> tuple[int, int] | None:
        """Least and greatest hash_id; None for a store without rows."""
        ends = [(lo, hi) for _, lo, hi in self._batches.values() if lo is not None]
        return (min(lo for lo, _ in ends), max(hi for _, hi in ends)) if ends else None

    def _visible(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("batch").isin(list(self._batches)))

    def _read(self, what: str, schema: str) -> DataFrame:
        if not self._batches:
            return self.spark.createDataFrame([], schema)
        return self._visible(self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{what}"))

    def hashes(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """(hash_id, w0..w3) of all batches; of a range of hash_id, whose other files are passed over by their statistics."""
        rows = self._read("hashes", self._columns()).select("hash_id", *WORDS)
        return rows if first is None else rows.where(F.col("hash_id").between(first, last))

    def bands(self) -> DataFrame:
        """(hash_id, w0..w3, band, key, salt), bucketed by the last three."""
        if not self.indexed:
            raise ValueError(f"the store at {self.path} has no index")
        return self._visible(self.spark.table(self.name)).select("hash_id", *WORDS, *KEYS)

    def counts(self) -> DataFrame:
        """(band, key, n, salts): rows of each key, and over how many salts they are spread."""
        return self._read("counts", "band int, key int, n long, salts int").groupBy("band", "key").agg(F.sum("n").alias("n"), F.max("salts").alias("salts"))

    def salted(self, probes: DataFrame) -> DataFrame:
        """Probes (band, key, ...), once for each salt of their key; keys that no row has are left out."""
        keys = self.counts().select("band", "key", "salts")
        return probes.join(F.broadcast(keys), ["band", "key"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
