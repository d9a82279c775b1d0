"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it back, so a lost executor costs
a re-read, never a re-computation of all that came before.
"""

from __future__ import annotations

import atexit
import functools
import gc
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.runtime import batch_rows, shared_dir, ship

#: Rows in one Arrow batch; documents can be long, and a batch is held whole by a worker.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Makes workers ready: ships the package, and keeps Arrow batches of whole texts small (a smaller setting stays)."""
    ship(spark)
    batch_rows(spark, BATCH_ROWS)


#: Where new scratches are noted while a pipeline stage runs; and the tables that stages have left, by session and input folder.
_NOTED: ContextVar[list[Scratch] | None] = ContextVar("noted", default=None)
_LEFT: dict[tuple[str, str, str], tuple[str, list[Scratch]]] = {}
#: Which run the stages belong to, if one runs them all.
_RUN: ContextVar[str] = ContextVar("run", default="")


@contextmanager
def one_run():
    """Stages called in here touch the tables of each other only."""
    token = _RUN.set(uuid.uuid4().hex)
    try:
        yield
    finally:
        _RUN.reset(token)


def stage(f):
    """A pipeline stage, whose tables go when another stage begins on the same input folder: its result has been written by then.

    A stage's result therefore is written before the next stage of that folder is asked for; pipelines over other
    folders, of other sessions or in a :func:`one_run` of their own do not touch it, and tables that the next stage's input still reads stay.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, _RUN.get())
        last, left = _LEFT.pop(key, ("", []))
        read = docs.inputFiles() if left else []
        still = [s for s in left if last == f.__name__ or any(f"/{s.name}/" in x for x in read)]
        for s in left:
            if s not in still:
                s.forget()
        mine: list[Scratch] = []
        token = _NOTED.set(mine)
        try:
            return f(spark, docs, sf_dir)
        finally:
            _NOTED.reset(token)
            _LEFT[key] = (f.__name__, [*still, *mine])

    return run


class Scratch:
    """A folder of tables for one call of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.dir, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.where: dict[int, str] = {}
        if (noted := _NOTED.get()) is not None:
            noted.append(self)
        atexit.register(self._quiet)

    @property
    def name(self) -> str:
        return self.dir.rpartition("/")[2]

    def forget(self) -> None:
        """Deletes everything now."""
        atexit.unregister(self._quiet)
        self._quiet()

    def table(self, df: DataFrame, tidy: bool = True) -> DataFrame:
        """Writes df and reads it back; not tidy leaves shuffle files to a later call, for small tables."""
        self.n += 1
        path = f"{self.dir}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.where[id(back)] = path
        if not tidy:
            return back
        gc.collect()
        for _ in range(2):  # lets Spark delete the shuffle files of what is written now; the first only finds them
            self.spark.sparkContext._jvm.System.gc()
        return back

    def settle(self) -> None:
        """Gives Spark the time to delete the shuffle files of what is written: listeners hold on to them for a moment."""
        for _ in range(3):
            time.sleep(1)
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    def counted(self, df: DataFrame, tidy: bool = True) -> tuple[DataFrame, int]:
        """The table, and its number of rows, counted while it is written."""
        seen = Observation()
        back = self.table(df.observe(seen, F.count(F.lit(1)).alias("n")), tidy)
        return back, seen.get["n"]

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that nothing needs any more."""
        path = self.where.pop(id(df), None)
        if path:
            self._delete(path)

    def close(self) -> None:
        self._delete(self.dir)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _quiet(self) -> None:
        try:
            self.close()
        except Exception:  # the session is gone at exit
            pass
