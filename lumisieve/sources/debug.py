"""Debug views: a matrix as a picture, and where its threshold cuts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.expr import lower_median


def ppm(matrix: np.ndarray) -> bytes:
    """A matrix as a binary colour picture (P6), scaled from its least to its greatest value."""
    low, high = float(matrix.min()), float(matrix.max())
    gray = np.round((matrix - low) / ((high - low) or 1.0) * 255).astype(np.uint8)
    return f"P6\n{matrix.shape[1]} {matrix.shape[0]}\n255\n".encode() + np.repeat(gray[..., None], 3, axis=2).tobytes()


def threshold_view(coefs: DataFrame, threshold: str = "threshold") -> DataFrame:
    """(image_id, i, v, class) of rows (image_id, pdqf, threshold): how each coefficient's bit compares with the median's.

    class: median (the value itself), correct, over (a bit that the median would not set) or under.
    """
    rows = coefs.select("image_id", F.col(threshold).alias("t"), lower_median(F.col("pdqf")).alias("m"), F.posexplode("pdqf").alias("i", "v"))
    kind = F.when(F.col("v") == F.col("m"), "median").when((F.col("v") > F.col("t")) == (F.col("v") > F.col("m")), "correct").when(F.col("v") > F.col("t"), "over").otherwise("under")
    return rows.select("image_id", "i", "v", kind.alias("class"))
