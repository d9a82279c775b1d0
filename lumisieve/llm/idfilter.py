"""A bit map of ids: a necessary condition of bounded size, before an exact join.

It spares the shuffle of rows that the join would drop.  It grows with the number of ids
up to MOST_BITS; beyond that it fills and spares less.  Results never depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as T

LEAST_BITS, MOST_BITS = 20, 26
SLICES = 64


def _cell(ids: np.ndarray, size: int) -> np.ndarray:
    """A slice by the lowest bits of the id, and a place in it."""
    u = ids.astype(np.int64).view(T.U)
    part = T.U(size // SLICES)
    return (u & T.U(SLICES - 1)) * part + (T.mix(u) & (part - T.U(1)))


def _mark(size: int):
    def run(batches):
        have = np.zeros(size, bool)
        for batch in batches:
            have[_cell(np.asarray(batch.column(0)), size)] = True
        parts = np.split(np.packbits(have, bitorder="little"), SLICES)
        some = [i for i, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["slice", "bits"])

    return run


def bitmap(ids: DataFrame, count: int) -> bytes:
    """The map of a one-column frame of non-null longs, about ``count`` of them: 8 MB at most."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (8 * count).bit_length()))
    name = ids.columns[0]
    out = bytearray(size // 8)
    part = len(out) // SLICES
    # rows of a slice meet in one task, so a task sends few slices
    dealt = ids.repartition(SLICES, F.col(name).bitwiseAND(F.lit(SLICES - 1)))
    for r in dealt.mapInArrow(_mark(size), "slice int, bits binary").collect():
        have = np.frombuffer(bytes(out[r.slice * part : (r.slice + 1) * part]), np.uint8) | np.frombuffer(bytes(r.bits), np.uint8)
        out[r.slice * part : (r.slice + 1) * part] = have.tobytes()
    return bytes(out)


def maybe(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """False only for ids that were not given."""
    c = _cell(ids, 8 * len(bits))
    return (np.frombuffer(bits, np.uint8)[c >> T.U(3)] >> (c & T.U(7)).astype(np.uint8)) & 1 == 1
