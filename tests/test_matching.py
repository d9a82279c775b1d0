"""Matching against planted needles."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisieve.functions.expr import words
from lumisieve.operators import packed
from lumisieve.operators.matching import Matcher
from lumisieve.sources import sinks


def frame(spark, key, values):
    return spark.createDataFrame([(i, f"{v:064x}") for i, v in enumerate(values)], f"{key} long, hash string").select(key, *words(F.col("hash")))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    hay = [rng.getrandbits(256) for _ in range(300)]
    flipped = [(i, k, hay[i] ^ sum(1 << b for b in rng.sample(range(256), k))) for i, k in ((3, 0), (7, 15), (299, 31), (5, 32), (0, 31), (3, 31))]
    expected = {(n, i, k) for n, (i, k, _) in enumerate(flipped) if k <= 31}
    return frame(spark, "hash_id", hay).cache(), frame(spark, "needle_id", [v for *_, v in flipped]), expected


@pytest.mark.parametrize("strategy", ["scan", "packed", "index"])
def test_planted_needles_at_the_boundary(planted, strategy):
    hay, needles, expected = planted
    m = Matcher(needles, 31, strategy)
    assert {tuple(r) for r in m.all(hay).collect()} == expected
    assert m.exists(hay).first().matched
    assert tuple(m.first(hay).first()) == min((i, n, d) for n, i, d in expected)
    assert {r.hash_id for r in m.semi(hay).collect()} == {i for _, i, _ in expected}
    assert m.anti(hay).count() == 300 - len({i for _, i, _ in expected})


@pytest.mark.parametrize("strategy", ["scan", "packed", "index"])
def test_no_match_and_empty_sides(planted, strategy):
    hay, needles, _ = planted
    none = Matcher(needles.where("needle_id = 3"), 31, strategy)
    assert not none.exists(hay).first().matched and none.first(hay).count() == 0
    assert Matcher(needles.where("false"), 31, strategy).all(hay).count() == 0
    assert Matcher(needles, 31, strategy).all(hay.where("false")).count() == 0


def test_bad_arguments(planted):
    with pytest.raises(ValueError):
        Matcher(planted[1], 257)
    with pytest.raises(ValueError):
        Matcher(planted[1], 31, "tree")


def test_formats():
    assert sinks.parse("q+hex+crlf") == ("q+hex", "\r\n") and sinks.parse("bin") == ("bin", "")
    assert sinks.raw_record("00" * 32, 0.5) == b"\x00\x00\x00?" + bytes(32)
    with pytest.raises(ValueError):
        sinks.parse("octal")


def test_top_and_nearest(spark, planted):
    hay, needles, _ = planted
    value = lambda r: [r.w0, r.w1, r.w2, r.w3]
    far = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(value(a), value(b)))
    rows, probes = hay.collect(), needles.collect()
    best = {n.needle_id: sorted((far(n, h), h.hash_id) for h in rows)[:3] for n in probes}
    got = {}
    for r in Matcher(needles, 256, "scan").top(hay, 3).orderBy("needle_id", "rank").collect():
        got.setdefault(r.needle_id, []).append((r.dist, r.hash_id))
    assert got == best
    assert {r.needle_id: (r.dist, r.hash_id) for r in Matcher(needles).nearest(hay).collect()} == {k: v[0] for k, v in best.items()}


def far(a, b):
    return sum(int(x ^ y).bit_count() for x, y in zip(a, b))


@pytest.mark.parametrize("radius", [0, 31, 100, 128, 200, 256])
def test_packed_kernel(radius, monkeypatch):
    rng = np.random.default_rng(radius)
    rows, need = rng.integers(0, 1 << 64, (4, 50), np.uint64), rng.integers(0, 1 << 64, (4, 7), np.uint64)
    rows[:, 3], rows[:, 9] = need[:, 2], need[:, 6] ^ np.array([0, 0, 0, (1 << 31) - 1], np.uint64)
    monkeypatch.setattr(packed, "HITS", 5)
    got = [(int(n), int(i), int(d)) for some in packed.hits(rows, need, radius) for n, i, d in zip(*some)]
    want = [(j, i, far(need[:, j].tolist(), rows[:, i].tolist())) for j in range(7) for i in range(50)]
    assert sorted(got) == [x for x in want if x[2] <= radius]
    assert not list(packed.hits(rows[:, :0], need, radius)) and not list(packed.hits(rows, need[:, :0], radius))


def test_packed_scan_in_blocks_and_with_nulls(spark, planted, monkeypatch):
    hay, needles, expected = planted
    monkeypatch.setattr(packed, "BLOCK", 64)
    none = spark.createDataFrame([(77, None, 0, 0, 0)], "id long, w0 long, w1 long, w2 long, w3 long")
    more = hay.union(none), needles.union(none.withColumn("id", F.lit(9)))
    assert {tuple(r) for r in Matcher(more[1], 31, "packed").all(more[0]).collect()} == expected
    assert Matcher(more[1], 31, "scan").all(more[0]).count() == len(expected)
    wide = Matcher(needles, 256)
    assert wide.all(hay).count() == 6 * 300


def test_packed_is_chosen_by_cost(spark, planted, monkeypatch):
    hay, needles, _ = planted
    many = spark.range(100).select(F.col("id").alias("needle_id"), *(F.hash("id", F.lit(k)).cast("long").alias(f"w{k}") for k in range(4)))
    assert Matcher(many).choose(hay) == "scan"  # a start costs more than so few rows
    from lumisieve.operators import matching

    monkeypatch.setattr(matching, "_rows", lambda _: 10_000_000)
    assert Matcher(many).choose(hay) == "packed" and Matcher(needles).choose(hay) == "scan"
    monkeypatch.setattr(matching, "BROADCAST_NEEDLES", 50)
    assert Matcher(many).choose(hay) == "scan"  # too many to be brought together


@pytest.mark.parametrize("few, members, sent", [(100_000, 1000, 4_000_000), (3, 2, 0)])
def test_rows_with_one_hash_are_compared_once(spark, planted, monkeypatch, few, members, sent):
    """Copies on both sides give all their pairs, but only different hashes are compared."""
    from lumisieve.operators import matching

    hay, needles, expected = planted
    monkeypatch.setattr(matching, "BROADCAST_NEEDLES", few)
    monkeypatch.setattr(matching, "MEMBERS", members)
    monkeypatch.setattr(matching, "SENT_MEMBERS", sent)
    compared = []
    real = Matcher.all
    monkeypatch.setattr(Matcher, "all", lambda self, rows: compared.append((self.count, rows.count())) or real(self, rows))
    copies = lambda t, c, k, step: t.crossJoin(spark.range(k).withColumnRenamed("id", "copy")).select((F.col(c) + step * F.col("copy")).alias(c), *(f"w{i}" for i in range(4)))
    none = spark.createDataFrame([(77, None, 0, 0, 0)], "id long, w0 long, w1 long, w2 long, w3 long")
    big = lambda: matching.all_distinct(copies(needles, "needle_id", 5, 100).union(none), copies(hay, "hash_id", 7, 1000).union(none))
    want = sorted((n + 100 * a, i + 1000 * b, d) for n, i, d in expected for a in range(5) for b in range(7))
    assert sorted(map(tuple, big().collect())) == want and compared == [(6, 300)]
    # the other way round, the fewer are still those brought together
    turned = matching.all_distinct(copies(hay, "hash_id", 7, 1000).withColumnRenamed("hash_id", "needle_id"), copies(needles, "needle_id", 5, 100).withColumnRenamed("needle_id", "hash_id"))
    assert sorted((h, n, d) for n, h, d in turned.collect()) == want and compared == [(6, 300)] * 2


def test_many_needles_are_packed_in_blocks_where_bands_are_alike(spark, monkeypatch):
    from lumisieve.operators import matching

    monkeypatch.setattr(matching, "BROADCAST_NEEDLES", 10)
    monkeypatch.setattr(matching, "START_NS", 0)
    monkeypatch.setattr(matching, "HANDED_NS", 0)
    ways = []
    real = Matcher._scanned
    monkeypatch.setattr(Matcher, "_scanned", lambda self, rows, way="scan": ways.append(way) or real(self, rows, way))
    rows = spark.range(60).select(F.col("id").alias("needle_id"), *(F.expr(f"shiftleft(1L, CAST(id % 30 AS INT)) AS {w}") for w in ("w0", "w1", "w2", "w3")))
    got = matching.all_distinct(rows, rows.withColumnRenamed("needle_id", "hash_id"))
    assert got.count() == 60 * 60 and ways == ["packed"]


def test_equal_hashes_keep_their_ids(spark):
    """An id at two hashes, a null id and a repeated row have the pairs that plain matching gives."""
    from lumisieve.operators import matching

    rows = [(1, 0), (1, 3), (None, 0), (2, 7), (2, 7), (3, -1)]
    need = spark.createDataFrame([(k, w, 0, 0, 0) for k, w in rows], "needle_id long, w0 long, w1 long, w2 long, w3 long")
    key = lambda t: sorted(map(str, map(tuple, t.collect())))
    hay = need.withColumnRenamed("needle_id", "hash_id")
    assert key(matching.all_distinct(need, hay, 2)) == key(Matcher(need, 2, "scan").all(hay))
    assert key(matching.distinct_near(need.limit(2), hay, 2)) == key(Matcher(need.limit(2), 2, "scan").semi(hay))


def test_copies_of_a_frame_are_compared_once(spark, monkeypatch):
    """filter_then_verify compares different hashes, however many frames have them."""
    from lumisieve.operators import matching
    from lumisieve.operators.hashing import hash_frames
    from lumisieve.sources.frames import synthetic_frames

    frames = synthetic_frames(spark.createDataFrame([(k, k % 50 + 1) for k in range(1, 13)], "p_partkey long, p_size int"))
    copies = frames.crossJoin(spark.range(5).withColumnRenamed("id", "copy")).withColumn("image_id", F.col("image_id") + 100 * F.col("copy")).drop("copy")
    need = lambda t: hash_frames(t, "precise").selectExpr("image_id AS needle_id", "w0", "w1", "w2", "w3")
    one = matching.filter_then_verify(frames, need(frames)).collect()
    sides, real = [], matching.Matcher.all
    monkeypatch.setattr(matching.Matcher, "all", lambda self, rows: sides.append(max(self.count, rows.count())) or real(self, rows))
    got = matching.filter_then_verify(copies, need(copies)).collect()
    assert sorted(map(tuple, got)) == sorted((i + 100 * a, n + 100 * b, d) for i, n, d in one for a in range(5) for b in range(5))
    assert one and sides and max(sides) <= 12
