"""Frames to coefficients to hashes.

Pixels cross to Python once, as Arrow batches of few frames, where matrix products give the
coefficients; pixels are projected away there.  Everything after that - quality,
threshold, variants, bits - can be had as native expressions from stored coefficients, or
from the same Arrow pass when hashes are all that is wanted.

Frames have 512 x 512 pixels unless columns ``width`` and ``height`` say otherwise.  Other sizes are
scaled by a triangle filter that is folded into the projection, (A R) X (A R')', so a picture is
projected at its own size.  A row whose pixels are missing, or are not as many as its
size says, keeps its place with null results.

Bits are certain for frames of 512 x 512: they are those of the whole-number product D' T D'', with T the tent
sums of the pixels and D' the cosines in units of 2**-32.  Double precision decides wherever the
gap at the threshold exceeds what it can be wrong by (DOUBT); the few other frames are
computed again in whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as C, expr as X
from ..functions.runtime import batch_rows, ship

#: Frames in one Arrow batch: 8 MB of luma bytes.
FRAMES = 32
BYTES = {"luma8": 1, "rgb8": 3, "rgba8": 4}
#: Twice the most by which a coefficient in double precision differs from the whole-number product: each cosine is off
#: by 2**-33, of 127 x 127 tent means of up to 255, against cosines whose absolute values sum to 10.3 a row.
DOUBT = 2 * (2 * 2**-33 * 127 * 255 * 10.3) + 1e-7
#: Whole numbers in place of the luma weights, and their sum.
LUMA_PARTS, LUMA_WHOLE = np.array([299, 587, 114]), 1000


@dataclass(frozen=True)
class Made:
    """Frames that are made from narrow rows by the pass that reads them, so that pixels stay in the worker that made them.

    make: batches of rows to batches (image_id, pixels, fmt, width, height).
    """

    rows: DataFrame
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

    #: Columns of the frames.
    kinds = {"image_id": "long", "pixels": "binary", "fmt": "string", "width": "int", "height": "int"}

    @property
    def sparkSession(self) -> SparkSession:
        return self.rows.sparkSession

    def among(self, ids: DataFrame) -> Made:
        """Those whose image_id is among ids (image_id); no pixels move."""
        return Made(self.rows.join(ids, "image_id", "left_semi"), self.make)

    def frames(self) -> DataFrame:
        """The frames as rows, for what needs them as such."""
        ship(self.sparkSession), batch_rows(self.sparkSession, FRAMES)
        return self.rows.mapInArrow(self.make, ", ".join(f"{c} {kind}" for c, kind in self.kinds.items()))


def _passed(frames: DataFrame | Made, kernel, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a kernel makes of frames."""
    ship(frames.sparkSession), batch_rows(frames.sparkSession, FRAMES)
    if not isinstance(frames, Made):
        return shaped(frames, keep).mapInArrow(kernel, schema)
    make, columns = frames.make, [*frames.kinds, *keep]

    def run(batches):
        made = make(few(batches))
        return kernel(pa.RecordBatch.from_arrays([b.column(c) for c in columns], [str(k) for k in range(len(columns))]) for b in made)

    return frames.rows.mapInArrow(run, schema)


def few(batches):
    """Batches of at most FRAMES rows, whatever the session sends."""
    for batch in batches:
        for at in range(0, len(batch), FRAMES):
            yield batch.slice(at, FRAMES)


def shaped(frames: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the kernels read: image_id, pixels, fmt, width, height, and columns to pass through."""
    size = [F.col(c).cast("int").alias(c) if c in frames.columns else F.lit(C.SIZE).alias(c) for c in ("width", "height")]
    return frames.select("image_id", "pixels", "fmt", *size, *(F.col(c).alias(f"kept{k}") for k, c in enumerate(keep)))


class Planes:
    """The frames of one batch, by shape; rows that are no frames belong to none."""

    def __init__(self, batch: pa.RecordBatch):
        self.raw, self.n = batch.column(1), len(batch)
        self.shapes: dict[tuple[int, int, str], list[int]] = {}
        for i, (w, h, fmt) in enumerate(zip(*(batch.column(k).to_pylist() for k in (3, 4, 2)))):
            raw = self.raw[i]
            if raw.is_valid and fmt in BYTES and w and h and w > 0 and h > 0 and len(raw.as_buffer()) == w * h * BYTES[fmt]:
                self.shapes.setdefault((w, h, fmt), []).append(i)

    def pixels(self, i: int, shape: tuple[int, int, str]) -> np.ndarray:
        w, h, fmt = shape
        return np.frombuffer(self.raw[i].as_buffer(), np.uint8).reshape(h, w, BYTES[fmt])

    def whole(self, i: int, fmt: str) -> tuple[np.ndarray, int]:
        """Luma of a 512 x 512 frame in whole numbers, and the number that stands for one."""
        px = self.pixels(i, (C.SIZE, C.SIZE, fmt))
        return (px[..., 0].astype(np.float64), 1) if fmt == "luma8" else (px[..., :3].astype(np.float64) @ LUMA_PARTS, LUMA_WHOLE)


def _tents(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of rows under the tent 1 2 3 2 1 about the given ones, in whole numbers."""
    out = np.add(x[at - 1], x[at + 1], dtype=np.promote_types(x.dtype, np.uint16))
    out *= out.dtype.type(2)
    out += x[at] * out.dtype.type(3)
    out += x[at - 2]
    out += x[at + 2]
    return out


def tent(px: np.ndarray, mode: str) -> np.ndarray:
    """Sums of a 512 x 512 frame of bytes (colours last) under the tent, down and across: 127 x 127 whole numbers, of 81 * 255 at most for luma; for colours, of luma weights of LUMA_WHOLE."""
    at = C.places(mode)
    down = _tents(px.reshape(C.SIZE, -1), at)
    if px.shape[2] > 1:  # colours are mixed in the 127 rows that are left
        down = down.reshape(C.COARSE, C.SIZE, -1)
        down = sum(down[..., k] * np.int32(w) for k, w in enumerate(LUMA_PARTS))
    return _tents(np.ascontiguousarray(down.T), at).T


def _planes(planes: Planes, rows: list[int], fmt: str, mode: str) -> np.ndarray:
    """Filtered planes (n, 127, 127) of frames of 512 x 512."""
    out = np.empty((len(rows), C.COARSE, C.COARSE))
    for x, i in zip(out, rows):
        x[:] = tent(planes.pixels(i, (C.SIZE, C.SIZE, fmt)), mode)
    out /= 81.0 * (1 if fmt == "luma8" else LUMA_WHOLE)
    return out


def _square(planes, mode: str) -> np.ndarray:
    """Coefficients (n, 16, 16) of luma planes of 512 x 512."""
    s, d = C.sampler(mode), C.dct_matrix()
    return d @ np.stack([tent(x[..., None], mode) / 81.0 if x.dtype == np.uint8 else s @ x @ s.T for x in planes]) @ d.T


def coefficients(planes: Planes, mode: str) -> np.ndarray:
    """(n, 256); not-a-number for rows that are no frames."""
    out = np.full((planes.n, C.ORDER, C.ORDER), np.nan)
    for (w, h, fmt), rows in planes.shapes.items():
        if (w, h) == (C.SIZE, C.SIZE):
            out[rows] = C.dct_matrix() @ _planes(planes, rows, fmt, mode) @ C.dct_matrix().T
        else:
            down, across = C.scaled_projection(mode, h), C.scaled_projection(mode, w)
            for i in rows:
                px = planes.pixels(i, (w, h, fmt))
                rowwise = (down @ px.reshape(h, -1)).reshape(C.ORDER, w, -1)  # 16 rows, before colours are mixed
                out[i] = (rowwise[..., 0] if fmt == "luma8" else rowwise[..., :3] @ np.array(C.LUMA)) @ across.T
    return out.reshape(planes.n, 256)


def whole_coefficients(planes: Planes, i: int, fmt: str, mode: str) -> np.ndarray:
    """The 256 coefficients of a 512 x 512 frame in whole numbers, in units of which no one needs to know the size."""
    d = C.whole_dct()
    t = tent(planes.pixels(i, (C.SIZE, C.SIZE, fmt)), mode).astype(np.float64)
    high = np.floor(t / 4096)
    u = (d @ high).astype(np.int64).astype(object) * 4096 + (d @ (t - 4096 * high)).astype(np.int64).astype(object)
    return (u @ d.T.astype(np.int64).astype(object)).ravel()


class Certain:
    """Bits of frames and their variants, certain for 512 x 512."""

    def __init__(self, planes: Planes, mode: str):
        self.planes, self.mode = planes, mode
        self.known: dict[int, np.ndarray] = {}
        self.fmt = {i: fmt for (w, h, fmt), rows in planes.shapes.items() if (w, h) == (C.SIZE, C.SIZE) for i in rows}

    def above(self, p: np.ndarray, s: np.ndarray, source: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """p > its lower median s[:, 127], for coefficients that were moved from ``source`` and changed in sign: of each frame, a row for each row of these."""
        out = p > s[:, 127:128]
        for r in np.flatnonzero(s[:, 128] - s[:, 127] <= DOUBT).tolist():
            i, k = divmod(r, len(source))
            if i not in self.fmt:
                continue
            if i not in self.known:
                self.known[i] = whole_coefficients(self.planes, i, self.fmt[i], self.mode)
            v = self.known[i][source[k]] * sign[k].astype(object)
            out[r] = v > np.sort(v)[127]
        return out


def quality_of(p: np.ndarray) -> np.ndarray:
    m = p.reshape(-1, 16, 16)
    gradient = np.abs(np.diff(m, axis=1)).sum(axis=(1, 2)) + np.abs(np.diff(m, axis=2)).sum(axis=(1, 2))
    return np.minimum(gradient / C.QUALITY_DIVISOR, 1.0)


def pack_bits(above: np.ndarray) -> np.ndarray:
    """(n, 32) bytes, coefficient 255 in the first bit."""
    return np.packbits(above[:, ::-1], axis=1)


def _column(values: np.ndarray, good: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values), mask=None if good.all() else ~good)


def _pdqf(mode: str):
    def run(batches):
        for batch in few(batches):
            p = coefficients(Planes(batch), mode)
            good = ~np.isnan(p[:, 0])
            s = np.partition(p, (127, 128), axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * 256, mask=np.append(~good, False)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, *(_column(x, good) for x in (s[:, 127], s[:, 128] - s[:, 127], quality_of(p)))], ["image_id", "pdqf", "threshold", "margin", "quality"])

    return run


def pdqf(frames: DataFrame | Made, mode: str = "variant") -> DataFrame:
    """(image_id, pdqf, threshold, margin, quality, algo) of frames (image_id, pixels, fmt, and width and height if not 512)."""
    C.sampler(mode)
    out = _passed(frames, _pdqf(mode), "image_id long, pdqf array<double>, threshold double, margin double, quality double")
    return out.withColumn("algo", F.lit(mode))


_HASHED = "image_id long, ord int, w0 long, w1 long, w2 long, w3 long, threshold double, margin double, quality double"


def _hashes(mode: str, ords: tuple[int, ...], with_pdqf: bool, keep: tuple[str, ...]):
    source, sign = (np.stack(x) for x in zip(*(C.dihedral_index(o) for o in ords)))
    k = len(ords)

    def run(batches):
        for batch in few(batches):
            planes = Planes(batch)
            base = coefficients(planes, mode)
            n, certain = len(base), Certain(planes, mode)
            good = np.repeat(~np.isnan(base[:, 0]), k)
            p = (base[:, source] * sign).reshape(n * k, 256)  # a frame's variants follow each other
            s = np.partition(p, (127, 128), axis=1)
            w = pack_bits(certain.above(p, s, source, sign)).view(">i8").astype(np.int64)
            more = [pa.ListArray.from_arrays(pa.array(np.arange(n * k + 1, dtype=np.int32) * 256, mask=np.append(~good, False)), pa.array(p.ravel()))] if with_pdqf else []
            own = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(np.tile(np.array(ords, np.int32), n)), *(_column(x, good) for x in (*w.T, s[:, 127], s[:, 128] - s[:, 127], quality_of(p))), *more, *(c.take(own) for c in batch.columns[5:])], ["image_id", "ord", *X.WORDS, "threshold", "margin", "quality", *(["pdqf"] if with_pdqf else []), *keep])

    return run


def hash_frames(frames: DataFrame | Made, mode: str = "variant", dihedrals: bool = False, with_pdqf: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, ord, hash, w0..w3, threshold, margin, quality, algo): one row a frame, or eight.

    with_pdqf adds the coefficients of each in the same pass; keep names columns of the frames that pass through.
    """
    C.sampler(mode)
    ords = tuple(range(8)) if dihedrals else (0,)
    more = [*(["pdqf"] if with_pdqf else []), *keep]
    kinds = {"pdqf": "array<double>"} | {c: frames.kinds[c] if isinstance(frames, Made) else frames.schema[c].dataType.simpleString() for c in keep}
    out = _passed(frames, _hashes(mode, ords, with_pdqf, keep), ", ".join([_HASHED, *(f"{c} {kinds[c]}" for c in more)]), keep)
    return out.select("image_id", "ord", X.words_to_hex([F.col(w) for w in X.WORDS]).alias("hash"), *X.WORDS, "threshold", "margin", "quality", *more, F.lit(mode).alias("algo"))


def _modes(batches):
    each = [_hashes(mode, (0,), False, ()) for mode in C.MODES]
    for batch in few(batches):
        got = [next(run(iter([batch]))) for run in each]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(x.column(w) for x in got for w in X.WORDS)], ["image_id", *(f"{c}{w}" for c in ("", "p") for w in X.WORDS)])


def hash_modes(frames: DataFrame | Made) -> DataFrame:
    """(image_id, w0..w3, pw0..pw3): fast and precise hashes of frames, in one pass over their pixels."""
    return _passed(frames, _modes, "image_id long, " + ", ".join(f"{c}{w} long" for c in ("", "p") for w in X.WORDS))


def confident(hashes: DataFrame, least: float = 0.5) -> DataFrame:
    """The same rows, with a null hash (and words) where the quality is not above ``least``."""
    return hashes.withColumns({c: F.when(F.col("quality") > least, F.col(c)) for c in ("hash", *X.WORDS) if c in hashes.columns})


def quantize(coefs: DataFrame) -> DataFrame:
    """Adds threshold, margin and hash to rows with an array column ``pdqf``, natively."""
    out = coefs.withColumn("threshold", X.lower_median(F.col("pdqf"))).withColumn("margin", X.margin(F.col("pdqf")))
    return out.withColumn("hash", X.pack(F.col("pdqf"), F.col("threshold")))


def dihedrals(coefs: DataFrame) -> DataFrame:
    """Eight rows for each row with ``pdqf``: ord, dihedral, packed, pdqf of the variant, threshold, margin, quality, hash."""
    rest = [c for c in coefs.columns if c not in ("pdqf", "threshold", "margin", "quality", "hash")]
    made = [F.struct(F.lit(o).alias("ord"), F.lit(name).alias("dihedral"), F.lit(C.pack_matrix(m)).cast("long").alias("packed"), X.dihedral(F.col("pdqf"), o).alias("pdqf")) for o, name, m, _ in C.DIHEDRALS]
    out = coefs.select(*rest, F.explode(F.array(*made)).alias("d")).select(*rest, "d.*")
    return quantize(out).withColumn("quality", X.quality(X.gradient_sum(F.col("pdqf"))))


def dihedral_table(spark) -> DataFrame:
    rows = [(o, name, *m, C.pack_matrix(m)) for o, name, m, _ in C.DIHEDRALS]
    return spark.createDataFrame(rows, "ord int, dihedral string, xx int, xy int, yx int, yy int, packed long")


def describe(mode: str = "variant") -> str:
    """A name for the algorithm, kept with every hash."""
    C.sampler(mode)
    return f"lumisieve-{mode}-f64"


def plane_quality(x: np.ndarray) -> float:
    """Quality by the gradients of the filtered plane itself, in shares of white: their sum over 90, one at most."""
    return min(1.0, (np.abs(np.diff(x, axis=0)).sum() + np.abs(np.diff(x, axis=1)).sum()) / 255 / 90)


def _filtered(planes: Planes, rows: list[int], shape: tuple[int, int, str], mode: str):
    """Filtered planes of frames of one shape."""
    w, h, fmt = shape
    if (w, h) == (C.SIZE, C.SIZE):
        return _planes(planes, rows, fmt, mode)
    down, across = C.scaled_sampler(mode, h), C.scaled_sampler(mode, w)
    all_ = (planes.pixels(i, shape) for i in rows)
    return (down @ (px[..., 0] if fmt == "luma8" else px[..., :3] @ np.array(C.LUMA)) @ across.T for px in all_)


def _plane_stats(mode: str):
    def run(batches):
        for batch in few(batches):
            planes, sums = Planes(batch), np.full((len(batch), 4), np.nan)
            for (w, h, fmt), rows in planes.shapes.items():
                for i, x in zip(rows, _filtered(planes, rows, (w, h, fmt), mode)):
                    sums[i] = x.sum(), x.min(), x.max(), plane_quality(x)
            good = ~np.isnan(sums[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_column(x, good) for x in sums.T)], ["image_id", "plane_sum", "plane_min", "plane_max", "plane_quality"])

    return run


def plane_stats(frames: DataFrame | Made, mode: str = "variant") -> DataFrame:
    """(image_id, plane_sum, plane_min, plane_max, plane_quality) of the filtered 127 x 127 plane."""
    C.sampler(mode)
    return _passed(frames, _plane_stats(mode), "image_id long, plane_sum double, plane_min double, plane_max double, plane_quality double")
