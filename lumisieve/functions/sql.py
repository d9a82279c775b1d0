"""The native expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .constants import LUMA, QUALITY_DIVISOR

_WORD = "conv(substring({h}, {at}, 16), 16, -10)"
_DISTANCE = " + ".join(f"bit_count(cast({_WORD.format(h='a', at=16 * k + 1)} as bigint) ^ cast({_WORD.format(h='b', at=16 * k + 1)} as bigint))" for k in range(4))
FUNCTIONS = {
    "luma": ("red DOUBLE, green DOUBLE, blue DOUBLE", "DOUBLE", f"red * {LUMA[0]}D + green * {LUMA[1]}D + blue * {LUMA[2]}D"),
    "hash_distance": ("a STRING, b STRING", "INT", _DISTANCE),
    "hash_bits": ("h STRING", "STRING", "concat(" + ", ".join(f"lpad(conv(substring(h, {8 * k + 1}, 8), 16, 2), 32, '0')" for k in range(8)) + ")"),
    "hash_word": ("h STRING, k INT", "BIGINT", "cast(conv(substring(h, 16 * k + 1, 16), 16, -10) as bigint)"),
    "lower_median": ("p ARRAY<DOUBLE>", "DOUBLE", "element_at(array_sort(p), cast(size(p) / 2 as int))"),
    "gradient_quality": ("gradient DOUBLE", "DOUBLE", f"least(gradient / {QUALITY_DIVISOR}D, 1D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS temporary functions of the session."""
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return sorted(FUNCTIONS)
