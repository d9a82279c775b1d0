"""Frames that are made where they are read, and sums under the tent."""

from __future__ import annotations

import numpy as np
import pytest

from lumisieve.functions import constants as C
from lumisieve.operators import hashing as H
from lumisieve.plans import queries as Q
from lumisieve.sources import frames as S

SIZES = ((512, 512), (40, 30), (31, 64))


def plain(k: int, s: int, fmt: str, w: int, h: int) -> bytes:
    r, c = np.arange(h)[:, None], np.arange(w)[None, :]
    v = ((r * (3 + s % 7)) // 32 + k) % 8 * (((c * (5 + k % 11)) // 24 + s) % 19) + (((r + k) * (1 + k % 5)) // 16) % 8 * ((((c + 3 * s) * (2 + s % 5)) // 20) % 19)
    return np.stack([v, 255 - v, v // 2, np.full_like(v, 128)][: H.BYTES[fmt]], axis=-1).astype(np.uint8).tobytes()


@pytest.mark.parametrize("fmt", list(H.BYTES))
def test_synthetic_frames_are_their_formula(spark, fmt):
    parts = [(k, k % 50 + 1) for k in range(1, 71)]
    got = S.synthetic_frames(spark.createDataFrame(parts, "p_partkey long, p_size int"), fmt, SIZES).collect()
    sizes = dict(parts)
    assert len(got) == len(parts)
    for r in got:
        w, h = SIZES[r.image_id % 3]
        assert (r.width, r.height, r.fmt) == (w, h, fmt)
        assert bytes(r.pixels) == plain(r.image_id, sizes[r.image_id], fmt, w, h)


@pytest.mark.parametrize("dihedrals", [False, True])
def test_made_and_given_frames_have_the_same_hashes(spark, dihedrals):
    parts = spark.createDataFrame([(k, k % 50 + 1) for k in range(1, 71)], "p_partkey long, p_size int")
    made = H.hash_frames(S.synthetic(parts, sizes=SIZES), dihedrals=dihedrals, keep=("width",))
    given = H.hash_frames(S.synthetic_frames(parts, sizes=SIZES), dihedrals=dihedrals, keep=("width",))
    assert made.schema == given.schema
    key = lambda r: (r.image_id, r.ord)
    assert sorted(made.collect(), key=key) == sorted(given.collect(), key=key)


@pytest.mark.parametrize("name", ["hash_image", "hash_rgba", "tent_compress", "jarosz_precise", "pdqf_image", "dihedral_hashes", "hash_resized", "random_source"])
def test_pixels_stay_in_the_worker(spark, sf, name):
    plan = Q.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "pixels" not in plan


@pytest.mark.parametrize("mode", C.MODES)
def test_tent_sums_are_the_sampler(mode):
    rng = np.random.default_rng(3)
    for depth in (1, 3, 4):
        for px in (rng.integers(0, 256, (512, 512, depth), np.uint8), np.full((512, 512, depth), 255, np.uint8)):
            luma, one = (px[..., 0].astype(float), 1) if depth == 1 else (px[..., :3] @ H.LUMA_PARTS.astype(float), H.LUMA_WHOLE)
            want = 81 * C.sampler(mode) @ luma @ C.sampler(mode).T
            got = H.tent(px, mode)
            assert got.dtype.kind in "iu" and np.abs(got - want).max() < 1e-6 * one


def test_candidates_are_picked_before_frames_are_made(spark):
    """A second pass joins narrow rows, never pixels."""
    from lumisieve.functions.expr import WORDS
    from lumisieve.operators.matching import filter_then_verify

    parts = spark.createDataFrame([(k, k % 50 + 1) for k in range(1, 41)], "p_partkey long, p_size int")
    made = S.synthetic(parts)
    plan = made.among(parts.selectExpr("p_partkey AS image_id")).rows._jdf.queryExecution().optimizedPlan().toString()
    assert "pixels" not in plan and "MapInArrow" not in plan
    need = H.hash_frames(made, "precise").selectExpr("image_id AS needle_id", *WORDS)
    pairs = lambda f: sorted(filter_then_verify(f, need).collect())
    assert pairs(made) == pairs(S.synthetic_frames(parts))


def test_table_function_makes_its_frames(spark, sf):
    """pdq_dihedrals over made frames, without pixels in the plan."""
    from lumisieve.functions import tables
    from lumisieve.operators import hashing
    from lumisieve.plans import queries

    made = queries.images(spark, sf)
    tables.register_made(spark, "made_dihedrals", made)
    made.rows.createOrReplaceTempView("made_rows")
    got = spark.sql("SELECT image_id, h.ord, h.w0, h.w1, h.w2, h.w3 FROM made_rows, LATERAL made_dihedrals(image_id, p_size) h")
    assert "pixels" not in got._jdf.queryExecution().toString()
    want = hashing.hash_frames(made, dihedrals=True).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        tables.register_made(spark, "no", made, "exact")


def test_both_modes_in_one_pass(spark, sf):
    """Rows that are no frames stay with nulls; nothing is joined."""
    frames = Q.images(spark, sf).frames().unionByName(spark.createDataFrame([(-1, None, "luma8", 512, 512)], "image_id long, pixels binary, fmt string, width int, height int"))
    got = H.hash_modes(frames)
    fast, slow = (H.hash_frames(frames, mode).select("image_id", "w0", "w1", "w2", "w3") for mode in C.MODES)
    want = {r[0]: tuple(r)[1:] for r in fast.collect()}
    for r in slow.collect():
        want[r[0]] += tuple(r)[1:]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and want[-1] == (None,) * 8
    assert "Join" not in Q.queries()["variant_vs_precise_distance"](spark, sf)._jdf.queryExecution().toString()
