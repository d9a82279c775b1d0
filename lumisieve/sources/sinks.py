"""Output encodings of hashes, and writers: text by Spark, any format by the record sink (:mod:`.splittable`)."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from ..functions.constants import DIHEDRALS, pack_matrix
from ..functions.expr import hex_to_bits
from ..functions.runtime import ship

FORMATS = ("raw", "q+raw", "hex", "HEX", "q+hex", "q+HEX", "bin", "BIN", "q+bin", "base64", "diagnostic")
SEPARATORS = {"nl": "\n", "lf": "\n", "crlf": "\r\n", "cr": "\r", "nul": "\0"}


def parse(spec: str) -> tuple[str, str]:
    """Format and separator of e.g. ``q+hex+crlf``; the separator is empty if none is named."""
    head, plus, last = spec.rpartition("+")
    kind, sep = (head, SEPARATORS[last]) if plus and last in SEPARATORS else (spec, "")
    if kind not in FORMATS:
        raise ValueError(f"unknown output format {spec!r}; one of {', '.join(FORMATS)}, with +{', +'.join(SEPARATORS)}")
    return kind, sep


def encode(hashed: Column, quality: Column, spec: str) -> Column:
    """Text of a hash (64 hex digits) in a text format, separator included."""
    kind, sep = parse(spec)
    prefix, plain = ("q+", kind[2:]) if kind.startswith("q+") else ("", kind)
    if plain in ("raw", "diagnostic"):
        raise ValueError(f"{kind} is not a text encoding of a hash")
    body = {"hex": F.lower(hashed), "HEX": F.upper(hashed), "bin": hex_to_bits(hashed), "BIN": hex_to_bits(hashed), "base64": F.base64(F.unhex(hashed))}[plain]
    parts = ([F.format_string("%.3f:", quality * 100)] if prefix else []) + [body] + ([F.lit(sep)] if sep else [])
    return F.concat(*parts)


def raw_bytes(hashed: Column) -> Column:
    """The 32 bytes of a hash."""
    return F.unhex(hashed)


def diagnostic(variants: DataFrame) -> DataFrame:
    """(image_id, ord, report) of each variant (image_id, ord, pdqf, threshold, quality, hash): its name, number, quality in
    per cent, threshold, bits, and coefficients, 16 to a line, with a star where they exceed the threshold of the image's first variant."""
    first = F.first_value("threshold").over(Window.partitionBy("image_id").orderBy("ord"))
    rows = variants.withColumn("first", first)
    rows = rows.withColumn("cells", F.transform("pdqf", lambda v: F.concat(F.when(v > F.col("first"), "*").otherwise(""), F.format_string("%.5f", v))))
    # written out: inside a function over lines, all cells would be made for each line
    table = F.concat_ws("\n", *(F.array_join(F.slice("cells", 16 * r + 1, 16), "\t") for r in range(16)))
    packed = F.element_at(F.array(*(F.lit(pack_matrix(m)).cast("long") for _, _, m, _ in DIHEDRALS)), F.col("ord") + 1)
    name = F.when(F.col("ord") == 0, '["original"]').otherwise(F.format_string("[Dihedrals { packed: %d }]", packed))
    head = F.format_string("\nIndex: %d\nQuality: %.3f\nThreshold: %.7f\nHash:\n", F.col("ord"), F.col("quality") * 100, F.col("threshold"))
    return rows.select(*[c for c in variants.columns if c in ("image_id", "ord", "path", "frame_idx")], F.concat(name, head, hex_to_bits(F.col("hash")), F.lit("\nPDQF:\n"), table, F.lit("\n")).alias("report"))


@F.pandas_udf(BinaryType())
def _little_endian(quality: pd.Series) -> pd.Series:
    """The four bytes of 32-bit floats."""
    raw = quality.to_numpy(np.dtype("<f4")).tobytes()
    return pd.Series([raw[i : i + 4] for i in range(0, len(raw), 4)])


def records(hashes: DataFrame, spec: str) -> DataFrame:
    """Adds ``record``: the bytes of each hash in any format, separator included (diagnostic needs ``pdqf``)."""
    kind, sep = parse(spec)
    ship(hashes.sparkSession)
    if kind == "diagnostic":
        return diagnostic(hashes).withColumn("record", F.encode(F.concat("report", F.lit(sep)), "UTF-8"))
    if kind in ("raw", "q+raw"):
        parts = ([_little_endian("quality")] if kind == "q+raw" else []) + [raw_bytes(F.col("hash"))] + ([F.encode(F.lit(sep), "UTF-8")] if sep else [])
        return hashes.withColumn("record", F.concat(*parts))
    return hashes.withColumn("record", F.encode(encode(F.col("hash"), F.col("quality"), spec), "UTF-8"))


def write_records(hashes: DataFrame, path: str, spec: str, order: tuple[str, ...] = ("image_id", "ord"), batch: int | None = None) -> None:
    """Appends the records in order, as one batch; under a number of its own, a batch is written once only."""
    from .splittable import SINK, register

    register(hashes.sparkSession)
    out = records(hashes, spec).orderBy(*order).select("record").write.format(SINK).mode("append").option("path", path)
    (out if batch is None else out.option("batch", batch)).save()


def write_text(hashes: DataFrame, path: str, spec: str = "hex+nl") -> None:
    """One file for each partition, in order of image_id and ord within it."""
    kind, sep = parse(spec)
    rows = hashes.sortWithinPartitions("image_id", "ord").select(encode(F.col("hash"), F.col("quality"), kind).alias("value"))
    rows.write.option("lineSep", sep or "\n").text(path)


def raw_record(hashed: str, quality: float | None = None) -> bytes:
    """Bytes of ``raw``, or of ``q+raw`` with a little-endian 32-bit quality before them."""
    return (b"" if quality is None else struct.pack("<f", quality)) + bytes.fromhex(hashed)
