"""The resident haystack, the choice between scan and index, and rings."""

from __future__ import annotations

import random
import re

import pytest
from test_matching import frame

from lumisieve.functions.expr import WORDS
from lumisieve.operators import matching, store as stores
from lumisieve.operators.matching import Matcher
from lumisieve.operators.store import HashStore


def flipped(rng, value: int, bits: int) -> int:
    return value ^ sum(1 << b for b in rng.sample(range(256), bits))


@pytest.fixture(scope="module")
def values():
    rng = random.Random(11)
    hay = [rng.getrandbits(256) for _ in range(400)]
    hay[100:160] = [hay[7] & ~0xFFFF | rng.getrandbits(16) for _ in range(60)]  # many share fifteen bands
    need = [flipped(rng, rng.choice(hay), rng.choice([0, 3, 15, 16, 20, 31, 31, 32, 45])) for _ in range(60)]
    return hay, need


def pairs(hay, need, radius, first=0):
    return {(n, h + first, d) for n, x in enumerate(need) for h, y in enumerate(hay) if (d := (x ^ y).bit_count()) <= radius}


def got(df):
    rows = [tuple(r) for r in df.select("needle_id", "hash_id", "dist").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def haystack_exchanges(df) -> int:
    """Exchanges above a scan of stored bands in the plan that runs."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = lambda x: len(re.match(r"[\s:+\-|*()0-9]*", x)[0])
    found = 0
    for k, line in enumerate(lines):
        if "lumisieve_store_" not in line:
            continue
        at = depth(line)
        for above in reversed(lines[:k]):
            if depth(above) < at:
                at = depth(above)
                found += "Exchange" in above
    assert any("lumisieve_store_" in x for x in lines)
    return found


@pytest.mark.parametrize("hot", [50_000, 20])
def test_store_answers_batches_without_moving(spark, values, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(stores, "HOT", hot)
    hay, need = values
    store = HashStore.create(spark, str(tmp_path / "s"), frame(spark, "hash_id", hay[:250]), buckets=8)
    more = frame(spark, "hash_id", hay[250:]).selectExpr("hash_id + 250 as hash_id", *WORDS)
    needles = frame(spark, "needle_id", need)
    asked = [needles.where(f"needle_id % 3 = {b}") for b in range(3)]
    before = [got(Matcher(n, 31, "index").all(store)) for n in asked]
    assert set().union(*before) == pairs(hay[:250], need, 31)
    store.append(more)
    assert store.rows == 400 and store.hashes().count() == 400
    found = [Matcher(n, 31, "index").all(store) for n in asked]
    assert set().union(*map(got, found)) == pairs(hay, need, 31)
    assert [haystack_exchanges(f) for f in found] == [0, 0, 0]
    if hot == 20:
        assert store.counts().where("salts > 1").count() > 10
    again = HashStore(spark, str(tmp_path / "s"))  # as another session opens it
    for radius in (0, 15, 31, 47):
        assert got(Matcher(needles, radius, "index").all(again)) == pairs(hay, need, radius)
        assert got(Matcher(needles, radius, "scan").all(again)) == pairs(hay, need, radius)
    m = Matcher(needles, 31, "index")
    hit = {h for _, h, _ in pairs(hay, need, 31)}
    assert {r.hash_id for r in m.semi(again).collect()} == hit and {r.hash_id for r in m.anti(again).collect()} == set(range(400)) - hit
    assert m.exists(again).first().matched and m.first(again).first().hash_id == min(hit)


def test_an_append_that_fails_shows_nothing(spark, values, tmp_path, monkeypatch):
    hay, need = values
    store = HashStore.create(spark, str(tmp_path / "s"), buckets=4)
    needles = frame(spark, "needle_id", need)
    assert store.rows == 0 and not got(Matcher(needles, 31, "index").all(store)) and not got(Matcher(needles, 31, "scan").all(store))
    rows = frame(spark, "hash_id", hay)

    def fail(self, n):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "range", fail)  # the write that makes a batch visible
        with pytest.raises(OSError):
            store.append(rows)
    assert HashStore(spark, str(tmp_path / "s")).rows == 0
    store.append(rows)
    assert got(Matcher(needles, 31, "index").all(store)) == pairs(hay, need, 31)


def test_choice_by_counts(spark, values, tmp_path, monkeypatch):
    hay, need = (frame(spark, k, v).cache() for k, v in zip(("hash_id", "needle_id"), values))
    assert Matcher(need).choose(hay) == "scan"
    monkeypatch.setattr(matching, "FEW", 10)
    assert Matcher(need).choose(hay) == "scan"  # 24 000 pairs are nothing
    monkeypatch.setattr(matching, "SCAN_NS", 10**9)
    monkeypatch.setattr(matching, "PACKED_NS", 2 * 10**9)
    store = HashStore.create(spark, str(tmp_path / "s"), hay, buckets=4)
    for h in (hay, store):
        m = Matcher(need)
        costs = m.costs(h)
        assert m.choose(h) == "index" and costs["index"] < costs["scan"]
        assert got(m.all(h)) == pairs(*values, 31)
    assert Matcher(need, 110).choose(hay) == "scan"
    with pytest.raises(ValueError):
        Matcher(need, 110, "index")


def test_index_probes_with_the_fewer(spark, values):
    hay, need = values
    assert got(Matcher(frame(spark, "needle_id", hay), 31, "index").all(frame(spark, "hash_id", need))) == {(h, n, d) for n, h, d in pairs(hay, need, 31)}


def test_scan_in_blocks(spark, values, monkeypatch):
    monkeypatch.setattr(matching, "BROADCAST_NEEDLES", 40)
    hay, need = values
    m = Matcher(frame(spark, "needle_id", need), 31, "scan")
    assert got(m.all(frame(spark, "hash_id", hay))) == pairs(hay, need, 31)
    plan = m.all(frame(spark, "hash_id", hay))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    hit = {h for _, h, _ in pairs(hay, need, 31)}
    assert {r.hash_id for r in m.semi(frame(spark, "hash_id", hay)).collect()} == hit
    assert got(Matcher(frame(spark, "needle_id", need), 31, "scan").all(frame(spark, "hash_id", hay[:20]))) == pairs(hay[:20], need, 31)


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("kind", ["scan", "index", "store"])
def test_nearest_at_any_distance(spark, values, tmp_path, monkeypatch, k, kind):
    hay, need = values
    rng = random.Random(2)
    need = need[:30] + [rng.getrandbits(256)]
    want = {(n, h, d, r + 1) for n, x in enumerate(need) for r, (d, h) in enumerate(sorted(((x ^ y).bit_count(), h) for h, y in enumerate(hay))[:k])}
    rows = frame(spark, "hash_id", hay)
    where = HashStore.create(spark, str(tmp_path / "s"), rows, buckets=4) if kind == "store" else rows
    m = Matcher(frame(spark, "needle_id", need), strategy="scan" if kind == "scan" else "index")
    assert {tuple(r) for r in m.nearest(where, k).select("needle_id", "hash_id", "dist", "rank").collect()} == want
    if k == 1 and kind != "scan":
        assert [x[0] for x in m.compared] == ["radius 15", "radius 31", "radius 47", "scan"] and m.compared[-1][1] == 1
        assert sum(x[2] for x in m.compared) < len(hay) * len(need) / 2
    assert not Matcher(frame(spark, "needle_id", need), strategy=m.strategy).nearest(rows.where("false"), k).collect()


def test_a_store_without_an_index(spark, values, tmp_path, monkeypatch):
    monkeypatch.setattr(matching, "FEW", 1)
    hay, need = values
    store = HashStore.create(spark, str(tmp_path / "s"), frame(spark, "hash_id", hay), indexed=False)
    m = Matcher(frame(spark, "needle_id", need))
    assert m.choose(store) == "scan" and got(m.all(store)) == pairs(hay, need, 31)
    assert m.nearest(store).count() == len(need)
    with pytest.raises(ValueError):
        Matcher(frame(spark, "needle_id", need), 31, "index").all(store)


def test_the_first_match_ends_the_search(spark, tmp_path):
    """Files of later ranges are not read: they are destroyed here."""
    from pathlib import Path

    rng = random.Random(8)
    hay = [rng.getrandbits(256) for _ in range(4000)]
    rows = frame(spark, "hash_id", hay).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = HashStore.create(spark, str(tmp_path / "s"), rows, indexed=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.bounds == (0, 3999)
    need = frame(spark, "needle_id", [flipped(rng, hay[3500], 3), flipped(rng, hay[150], 31), flipped(rng, hay[150], 9)])
    m = Matcher(need)
    files = {f: spark.read.parquet(str(f)).agg({"hash_id": "min"}).first()[0] for f in Path(tmp_path / "s/hashes").glob("*.parquet")}
    assert len(files) > 1
    for f, least in files.items():
        if least > 1000:
            data = bytearray(f.read_bytes())
            data[4 : len(data) * 3 // 4] = bytes(len(data) * 3 // 4 - 4)  # pages are lost, statistics stay
            f.write_bytes(data)
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert [tuple(r) for r in m.first(store).collect()] == [(150, 1, 31)] and m.searched[-1][1] < 1000
    with pytest.raises(Exception):
        Matcher(need.where("needle_id = 0")).first(store).collect()


def test_first_match_in_a_store_of_several_batches(spark, values, tmp_path):
    hay, need = values
    store = HashStore.create(spark, str(tmp_path / "s"), frame(spark, "hash_id", hay[:100]).selectExpr("hash_id - 50 as hash_id", *WORDS), indexed=False)
    store.append(frame(spark, "hash_id", hay[100:]).selectExpr("hash_id + 50 as hash_id", *WORDS))
    want = min((h - 50, n, d) for n, h, d in pairs(hay, need, 31))
    assert tuple(Matcher(frame(spark, "needle_id", need)).first(store).first()) == want
    none = Matcher(frame(spark, "needle_id", [0]), 3)
    assert none.first(store).count() == 0 and none.searched[0][0] == -50 and none.searched[-1][1] == 349
    empty = HashStore.create(spark, str(tmp_path / "e"))
    assert empty.bounds is None and none.first(empty).count() == 0
