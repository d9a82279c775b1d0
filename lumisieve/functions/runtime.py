"""What Python workers need: this package, and batches of bounded size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OURS: dict[str, int] = {}
#: Folders that :func:`stored` has made, where they are noted.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def ship(spark: SparkSession) -> None:
    """Sends this package to Python workers, once for each Spark context."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="lumisieve-code-")) / "lumisieve.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Keeps Arrow batches to so many rows; a smaller setting that is not from here stays."""
    key, app = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.sparkContext.applicationId
    have = int(spark.conf.get(key, "10000"))
    if have == _OURS.get(app) or have <= 0 or have > rows:
        spark.conf.set(key, str(rows))
        _OURS[app] = rows


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder only in local mode, where it may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumisieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path there, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file(spark, path)
    return system.exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        system, target = _file(spark, path)
        system.delete(target, True)
    except Exception:  # the session is gone at exit
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back, so that what uses it several times does not make it again."""
    path = folder(df.sparkSession, label)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """What is :func:`stored` in here is deleted at the end, not when the interpreter ends."""
    token = _MADE.set(made := [])
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            _delete(spark, path)
