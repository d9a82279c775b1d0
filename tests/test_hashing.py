"""Constants, coefficients, quantization and variants against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisieve.functions import constants as C, expr as X
from lumisieve.operators import hashing as H
from lumisieve.sources import frames as S

#: The published hash of the frequency-modulated stripes.
STRIPES = "92b27d5d38087d5d38087d5d381a7d7d92a26d5d38186d5d38186d5d38187d5d"


def stripes() -> np.ndarray:
    one = np.float32
    step, out = one(4) / one(512), np.zeros((512, 512))
    f = one(4)
    for r in range(512):
        for j in range(512):
            f = one(f + step)
            out[r, j] = np.sin(one(one(j) * one(2) * one(np.pi) * f) / one(512)) * one(127) + one(128)
    return out


def smooth(seed: int) -> np.ndarray:
    """A plane like a photograph: noise whose amplitude falls with frequency, without symmetry or period."""
    rng = np.random.default_rng(seed)
    f = np.hypot(np.fft.fftfreq(1024)[:, None], np.fft.fftfreq(1024)[None, :])
    f[0, 0] = 1
    z = np.fft.ifft2(np.fft.fft2(rng.normal(size=(1024, 1024))) / f).real[:512, :512]
    return (z - z.min()) / (z.max() - z.min()) * 255


def coefficients(planes: np.ndarray, mode: str = "variant") -> np.ndarray:
    return H._square(planes, mode).reshape(-1, 256)


def hash_of(plane: np.ndarray, mode: str = "variant") -> int:
    return packed(coefficients(plane[None], mode))


def packed(p: np.ndarray) -> int:
    return int(H.pack_bits(p > np.sort(p, axis=1)[:, 127:128])[0].tobytes().hex(), 16)


def test_published_hash():
    p = coefficients(stripes()[None])
    assert f"{hash_of(stripes()):064x}" == STRIPES
    assert H.quality_of(p)[0] == 1.0
    assert np.allclose(p[0, :4], [18.5, 0.1, 12.2, 12.9], atol=0.06)


def test_median_hash_has_half_its_bits():
    assert hash_of(smooth(1)).bit_count() == 128


@pytest.mark.parametrize("ord_", range(8))
def test_variants_match_moved_images(ord_):
    moves = [lambda a: a, np.fliplr, lambda a: np.rot90(a, 2), np.flipud, lambda a: a.T, lambda a: np.rot90(a, 1), lambda a: np.rot90(a, 1)[:, ::-1], lambda a: np.rot90(a, -1)]
    # order 4 to 7: transpose; turned left; turned left or right and flopped; turned right
    moves[6] = lambda a: np.rot90(a, 2).T
    plane = smooth(3)
    src, sign = C.dihedral_index(ord_)
    got = packed(coefficients(plane[None])[:, src] * sign)
    assert (got ^ hash_of(np.ascontiguousarray(moves[ord_](plane)))).bit_count() <= 24


def test_modes_are_near_and_unknown_ones_refused():
    assert 0 < (hash_of(smooth(5)) ^ hash_of(smooth(5), "precise")).bit_count() <= 16
    with pytest.raises(ValueError):
        C.sampler("quick")


def test_native_expressions_agree_with_arrow(spark):
    frames = S.random_frames(spark, 3, seed=7).union(S.random_frames(spark, 2, "luma8", 9))
    coefs = H.pdqf(frames).withColumn("image_id", F.monotonically_increasing_id())
    eight = H.dihedrals(coefs.select("image_id", "pdqf")).orderBy("image_id", "ord").collect()
    fused = H.hash_frames(frames, dihedrals=True).collect()
    assert sorted(r.hash for r in eight) == sorted(r.hash for r in fused)
    assert np.allclose(sorted(r.quality for r in eight), sorted(r.quality for r in fused))


def test_words_and_bits(spark):
    h = "8000000000000001ffffffffffffffff00000000000000007fffffffffffffff"
    row = spark.range(1).select(*X.words(F.lit(h)), X.hex_to_bits(F.lit(h)).alias("b"), X.bits_to_hex(X.hex_to_bits(F.lit(h))).alias("back")).first()
    assert (row.w0, row.w1, row.w2, row.w3) == (-(2**63) + 1, -1, 0, 2**63 - 1)
    assert row.b == f"{int(h, 16):0256b}" and row.back == h


def test_constant_image_has_no_quality(spark):
    flat = spark.createDataFrame([(1, "luma8", bytes([90]) * 262144)], "image_id long, fmt string, pixels binary")
    assert H.pdqf(flat).first().quality < 1e-6


def test_luma(spark):
    px = bytes([255, 0, 0, 128, 0, 255, 0, 128, 0, 0, 255, 128, 255, 255, 255, 128] * (262144 // 4))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([px]), pa.array(["rgba8"]), pa.array([512]), pa.array([512])], list("abcde"))
    got, one = H.Planes(batch).whole(0, "rgba8")
    assert np.allclose(got.ravel()[:4] / one, [76.245, 149.685, 29.07, 255], atol=1e-9)
    plane = np.resize([76.245, 149.685, 29.07, 255], (1, 512, 512))
    assert np.abs(H.coefficients(H.Planes(batch), "variant") - coefficients(plane)).max() < 1e-8


def test_raw_files_and_their_ends(spark, tmp_path):
    one = bytes(262144)
    for name, data in (("a", one * 2), ("b", one + bytes(512)), ("c", one + bytes(7)), ("d", b"")):
        (tmp_path / name).write_bytes(data)
    got = S.read_raw(spark, str(tmp_path), permissive=True)
    assert got.where("pixels is not null").count() == 4
    assert [r.error[-1] for r in got.where("error is not null").select("error").distinct().collect()] == ["c"]
    with pytest.raises(Exception, match="unexpected end"):
        S.read_raw(spark, str(tmp_path / "c")).count()
    with pytest.raises(ValueError):
        S.read_raw(spark, str(tmp_path), "cmyk")


def test_streamed_files(spark, tmp_path):
    from lumisieve.streaming import pipe

    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(0)
    (tmp_path / "in/x").write_bytes(rng.bytes(262144 * 3))
    pipe.write(pipe.pipe(S.stream_raw(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "log"), "q+hex+nl").awaitTermination()
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 3 and all(len(x.split(":")[1]) == 64 for x in lines)


def test_packed_dihedral_constants():
    """Published values of the eight matrices, as four signed bytes."""
    want = {0: 0x01000001, 1: 0xFF000001, 2: 0xFF0000FF, 3: 0x010000FF, 4: 0x00FFFF00, 5: 0x00010100, 6: 0x00FF0100, 7: 0x0001FF00}
    assert {o: C.pack_matrix(m) & 0xFFFFFFFF for o, _, m, _ in C.DIHEDRALS} == want


def test_tent_sums_equal_the_projection():
    rng = np.random.default_rng(3)
    bytes_ = rng.integers(0, 256, (3, 512, 512)).astype(np.uint8)
    a = C.projection("variant")
    want = (a @ bytes_.astype(float) @ a.T).reshape(3, 256)
    assert np.abs(coefficients(bytes_) - want).max() < 1e-8
    assert np.abs(coefficients(bytes_.astype(float)) - want).max() < 1e-8


def test_confident_hashes(spark):
    rows = spark.createDataFrame([(1, "ab", 0.5), (2, "cd", 0.51)], "image_id long, hash string, quality double")
    assert {r.image_id: r.hash for r in H.confident(rows).collect()} == {1: None, 2: "cd"}


def test_ramp_of_the_demo():
    """Values 0, 1, 2, ... and the same plus one: a constant changes no coefficient, and only those of one direction differ from zero."""
    ramp = np.arange(512.0 * 512).reshape(512, 512)
    one, two = coefficients(ramp[None]), coefficients(ramp[None] + 1)
    assert np.allclose(one, two, atol=1e-6) and np.abs(one).max() < 1e-6  # no frequency of both directions is zero


def test_quality_in_the_image_domain():
    rng = np.random.default_rng(0)
    x = rng.random((127, 127))
    want = sum(abs(x[i + 1, j] - x[i, j]) for i in range(126) for j in range(127)) + sum(abs(x[i, j + 1] - x[i, j]) for i in range(127) for j in range(126))
    assert abs(H.plane_quality(x) - want / 255 / 90) < 1e-9 and H.plane_quality(x * 255) == 1.0


def test_a_threshold_is_worked_out_once_a_row(spark):
    """Not once for each coefficient: a random one decides all bits of a row alike."""
    rows = spark.range(40).select(F.array_repeat(F.lit(0.5), 256).alias("pdqf"))
    got = {r.bits for r in rows.select(X.bits(F.col("pdqf"), F.rand(3)).alias("bits")).collect()}
    assert got == {"0" * 256, "1" * 256}


def test_cells_of_a_report_are_made_once(spark, sf):
    """Not once for each of its sixteen lines."""
    from lumisieve.plans import queries as Q

    plan = Q.queries()["format_diagnostic"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(cells#" in plan
