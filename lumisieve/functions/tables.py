"""Hashes of frames as SQL table functions.

    SELECT image_id, h.* FROM frames, LATERAL pdq_dihedrals(pixels, fmt, width, height) h

pdq_hash gives one row for a frame, pdq_dihedrals eight, with the columns of :data:`ROW`; pixels that are
no frame of the given size give no hash (one row of nulls, or eight).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.hashing import Made, _hashes
from .constants import MODES
from .runtime import ship

ROW = "ord int, w0 long, w1 long, w2 long, w3 long, threshold double, margin double, quality double"


class _Hash:
    ords = (0,)

    def eval(self, pixels: bytes, fmt: str, width: int, height: int, mode: str = "variant"):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
        one = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([pixels], pa.binary()), pa.array([fmt], pa.string()), pa.array([width], pa.int32()), pa.array([height], pa.int32())], ["image_id", "pixels", "fmt", "width", "height"])
        for batch in _hashes(mode, self.ords, False, ())(iter([one])):
            yield from zip(*(c.to_pylist() for c in batch.columns[1:]))


class _Dihedrals(_Hash):
    ords = tuple(range(8))


def register_made(spark: SparkSession, name: str, made: Made, mode: str = "variant") -> None:
    """Makes ``name`` a table function of the session: the eight hashes of the frame that is made of its arguments, the columns of made.rows."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    ship(spark)
    make, schema = made.make, to_arrow_schema(made.rows.schema)

    class Handler:
        def eval(self, *row):
            one = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], names=schema.names)
            for batch in _hashes(mode, _Dihedrals.ords, False, ())(make(iter([one]))):
                yield from zip(*(c.to_pylist() for c in batch.columns[1:]))

    spark.udtf.register(name, udtf(Handler, returnType=ROW))


def register(spark: SparkSession) -> list[str]:
    """Makes pdq_hash and pdq_dihedrals table functions of the session."""
    ship(spark)
    for name, handler in (("pdq_hash", _Hash), ("pdq_dihedrals", _Dihedrals)):
        spark.udtf.register(name, udtf(handler, returnType=ROW))
    return ["pdq_dihedrals", "pdq_hash"]
