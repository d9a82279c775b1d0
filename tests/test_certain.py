"""Certain bits, and pictures of any size."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from lumisieve.functions import constants as C
from lumisieve.operators import hashing as H
from lumisieve.sources import frames as S


def near_ties(rng: np.random.Generator) -> list[np.ndarray]:
    """Planes whose coefficients tie or nearly tie at the threshold."""
    x = np.arange(512)
    flat = np.full((512, 512), 77)
    one = flat.copy()
    one[256, 256] = 78
    half = np.where(x[None, :] < 256, 10, 200) + np.zeros((512, 1), int)
    mirrored = rng.integers(0, 256, (512, 256))
    mirrored = np.concatenate([mirrored, mirrored[:, ::-1]], axis=1)
    return [flat, one, half, half.T, mirrored, (x[:, None] + x[None, :]) // 4, rng.integers(0, 256, (512, 512)), np.zeros((512, 512), int), 100 + (x[:, None] // 64 + x[None, :] // 64) % 2]


def exact_bits(plane: np.ndarray, mode: str, unit: int = 1) -> int:
    """The hash from whole numbers of any size, straight from the definition."""
    d = [[int(v) for v in row] for row in np.rint(C.dct_matrix() * 2.0**32)]
    s = np.rint(C.sampler(mode) * (9 if mode == "variant" else 36)).astype(np.int64)
    t = (s @ plane.astype(np.int64) @ s.T).tolist()
    u = [[sum(a * row[j] for a, row in zip(dk, t)) for j in range(127)] for dk in d]
    v = [sum(a * b for a, b in zip(uk, dl)) for uk in u for dl in d]
    cut = sorted(v)[127]
    return sum(1 << i for i, x in enumerate(v) if x > cut)


@pytest.mark.parametrize("mode", C.MODES)
@pytest.mark.parametrize("fmt", ["luma8", "rgb8"])
def test_bits_equal_whole_numbers(spark, mode, fmt):
    planes = near_ties(np.random.default_rng(5))
    if fmt == "luma8":
        raw, whole = [p.astype(np.uint8).tobytes() for p in planes], planes
    else:
        colours = [np.stack([p, 255 - p, p // 2], axis=-1).astype(np.uint8) for p in planes]
        raw, whole = [c.tobytes() for c in colours], [c.astype(np.int64) @ [299, 587, 114] for c in colours]
    rows = spark.createDataFrame([(i, fmt, b) for i, b in enumerate(raw)], "image_id long, fmt string, pixels binary")
    got = {r.image_id: (int(r.hash, 16), r.margin) for r in H.hash_frames(rows, mode).collect()}
    assert sum(margin <= H.DOUBT for _, margin in got.values()) >= 5
    assert {i: h for i, (h, _) in got.items()} == {i: exact_bits(p, mode) for i, p in enumerate(whole)}


def test_doubt_covers_the_difference():
    """Double precision never differs from the whole-number product by more than half of DOUBT."""
    rng = np.random.default_rng(2)
    for plane in (rng.integers(0, 256, (512, 512)), np.full((512, 512), 255), rng.integers(0, 2, (512, 512)) * 255):
        s, d = C.whole_sampler("variant"), C.whole_dct()
        t = s @ plane.astype(float) @ s.T
        exact = ((d.astype(np.int64).astype(object) @ t.astype(np.int64).astype(object) @ d.T.astype(np.int64).astype(object)) / (81 * 2**64)).astype(float)
        assert np.abs(H._square(plane[None].astype(np.uint8), "variant")[0] - exact).max() <= H.DOUBT / 2


def scaled(plane: np.ndarray) -> np.ndarray:
    """512 x 512 by a triangle filter, pixel by pixel."""
    def weights(size):
        out = np.zeros((512, size))
        for o in range(512):
            step = size / 512
            wide, centre = max(step, 1), (o + 0.5) * step
            for q in range(size):
                out[o, q] = max(0, 1 - abs((q + 0.5 - centre) / wide))
            out[o] /= out[o].sum()
        return out

    return weights(plane.shape[0]) @ plane @ weights(plane.shape[1]).T


@pytest.mark.parametrize("mode", C.MODES)
def test_other_sizes_equal_scaling_first(spark, mode):
    rng = np.random.default_rng(9)
    planes = [rng.integers(0, 256, shape).astype(np.uint8) for shape in ((300, 200), (64, 700), (1, 1), (512, 513))]
    rows = spark.createDataFrame([(i, "luma8", p.tobytes(), p.shape[1], p.shape[0]) for i, p in enumerate(planes)], "image_id long, fmt string, pixels binary, width int, height int")
    got = {r.image_id: np.array(r.pdqf) for r in H.pdqf(rows, mode).collect()}
    for i, p in enumerate(planes):
        assert np.abs(got[i] - H._square(scaled(p.astype(float))[None], mode).ravel()).max() < 1e-8


def test_rows_that_are_no_frames_keep_their_place(spark):
    rows = [(1, "luma8", None, 512, 512), (2, "luma8", b"abc", 512, 512), (3, "luma8", bytes(range(200)), 20, 10), (4, "cmyk", bytes(400), 20, 20), (5, "luma8", b"", 0, 0), (6, None, b"x", None, 1)]
    frames = spark.createDataFrame(rows, "image_id long, fmt string, pixels binary, width int, height int")
    got = {r.image_id: r for r in H.hash_frames(frames, dihedrals=True, with_pdqf=True, keep=("width",)).where("ord = 3").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and {i for i, r in got.items() if r.hash} == {3}
    assert all(got[i][c] is None for i in (1, 2, 4, 5, 6) for c in ("w0", "threshold", "margin", "quality", "pdqf")) and got[3].width == 20
    assert {r.image_id for r in H.pdqf(frames).where("pdqf is null").collect()} == {1, 2, 4, 5, 6}
    assert H.plane_stats(frames).where("plane_sum is null").count() == 5


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_of_any_size(spark, tmp_path):
    rng = np.random.default_rng(1)
    shapes = {"a.png": (300, 200, 3), "b.png": (512, 512, 3), "c.png": (40, 90), "d.png": (700, 600, 3)}
    pictures = {n: rng.integers(0, 256, s).astype(np.uint8) for n, s in shapes.items()}
    for n, p in pictures.items():
        (tmp_path / n).write_bytes(png(p))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    got = S.read_images(spark, str(tmp_path))
    hashes = {r.path.rsplit("/", 1)[1]: r for r in H.hash_frames(got, keep=("path", "error", "width", "height")).collect()}
    assert set(hashes) == {*shapes, "bad.png"}
    assert hashes["bad.png"].hash is None and hashes["bad.png"].error.startswith("not a picture")
    for n, p in pictures.items():
        luma = p.astype(float) @ np.array(C.LUMA) if p.ndim == 3 else p.astype(float)
        want = H._square(scaled(luma)[None], "variant").reshape(1, 256)
        assert (hashes[n].height, hashes[n].width) == p.shape[:2] and hashes[n].error is None
        assert int(hashes[n].hash, 16) == int(H.pack_bits(want > np.sort(want)[:, 127:128])[0].tobytes().hex(), 16), n
