"""Rates and soak of streams, screening in a stream, SQL table functions."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisieve.functions import tables
from lumisieve.functions.expr import WORDS
from lumisieve.operators.hashing import hash_frames
from lumisieve.sources import frames as S, splittable as P
from lumisieve.streaming import pipe, watch
from lumisieve.streaming.stats import FrameRates, soak


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    at = tmp_path_factory.mktemp("raw")
    (at / "a").write_bytes(np.random.default_rng(3).bytes(262144 * 5))
    return str(at)


def test_rates_of_a_stream(spark, raw, tmp_path):
    with FrameRates(spark) as rates:
        q = pipe.write(hash_frames(P.stream_frames(spark, raw)), str(tmp_path / "out"), str(tmp_path / "log"), "hex+nl")
        q.awaitTermination()
        end = time.time() + 10
        while str(q.runId) not in rates.ended and time.time() < end:
            time.sleep(0.1)
    found = rates.total(str(q.runId))
    assert found.frames == 5 and found.seconds > 0 and found.per_second > 0 and rates.ended[str(q.runId)] is None
    text = b"".join(Path(p).read_bytes() for p in P.record_files(str(tmp_path / "out"))).decode().split()
    assert len(text) == 5 and all(len(x) == 64 for x in text)


def test_soak(spark):
    found = soak(spark, seconds=6, per_second=20)
    assert found.frames >= 20 and found.batch >= 1


@pytest.mark.parametrize("few", [True, False])
def test_screening_a_stream(spark, raw, tmp_path, monkeypatch, few):
    from lumisieve.operators import matching

    hashes = hash_frames(P.read_frames(spark, raw)).collect()
    need = spark.createDataFrame([(k, r.w0 ^ 0b111, r.w1, r.w2, r.w3) for k, r in enumerate(hashes[:2])], "needle_id long, " + ", ".join(f"{w} long" for w in WORDS))
    if not few:  # more needles than may be broadcast
        monkeypatch.setattr(matching, "BROADCAST_NEEDLES", 1)
    found = pipe.screen(P.stream_frames(spark, raw), need)
    q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("needle_id", "hash_id", "dist").collect()}
    assert got == {(k, r.image_id, 3) for k, r in enumerate(hashes[:2])}


def test_repeats_in_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "b")]
    spark.createDataFrame(rows, "at string, hash string").select(F.to_timestamp("at").alias("at"), "hash").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, hash string").parquet(str(tmp_path / "in"))
    q = pipe.drop_repeats(stream, "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_table_functions(spark):
    assert tables.register(spark) == ["pdq_dihedrals", "pdq_hash"]
    frames = S.random_frames(spark, 3).withColumns({"width": F.lit(512), "height": F.lit(512)}).union(spark.range(1).selectExpr("9L", "0L", "'luma8'", "cast('x' as binary)", "512", "512"))
    frames.createOrReplaceTempView("test_frames")
    want = hash_frames(frames, dihedrals=True).select("image_id", "ord", *WORDS, "threshold", "margin", "quality")
    got = spark.sql("SELECT image_id, h.* FROM test_frames, LATERAL pdq_dihedrals(pixels, fmt, width, height) h")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(got) == key(want) and got.count() == 32
    one = spark.sql("SELECT image_id, h.* FROM test_frames, LATERAL pdq_hash(pixels, fmt, width, height, 'precise') h")
    assert key(one) == key(hash_frames(frames, "precise").select("image_id", "ord", *WORDS, "threshold", "margin", "quality"))
    with pytest.raises(Exception, match="unknown mode"):
        spark.sql("SELECT h.* FROM test_frames, LATERAL pdq_hash(pixels, fmt, width, height, 'quick') h").collect()


def _watched(spark, at, **kinds):
    q = watch.watch(P.stream_frames(spark, str(at / "in")), str(at / "book"), str(at / "out"), str(at / "log"), **kinds)
    q.awaitTermination()
    return {tuple(r) for r in watch.found(spark, str(at / "out")).select("needle_id", "image_id", "dist").collect()}


def _needles(spark, rows):
    return spark.createDataFrame([(k, r.w0 ^ 0b11, r.w1, r.w2, r.w3) for k, r in rows], "needle_id long, " + ", ".join(f"{w} long" for w in WORDS))


@pytest.mark.parametrize("few", [True, False])
def test_needles_that_change(spark, tmp_path, monkeypatch, few):
    """Needles added or retired while a stream rests or is tried again reach later frames only."""
    from lumisieve.operators import matching

    if not few:  # the index, whatever it costs
        for name, value in (("FEW", 0), ("SCAN_NS", 10**9), ("PACKED_NS", 10**9)):
            monkeypatch.setattr(matching, name, value)
    (tmp_path / "in").mkdir()
    data = np.random.default_rng(8).bytes(262144 * 6)
    (tmp_path / "in" / "a").write_bytes(data[: 262144 * 3])
    book = watch.NeedleBook.create(spark, str(tmp_path / "book"), buckets=4)
    assert _watched(spark, tmp_path) == set()  # a book without needles
    every = spark.createDataFrame([(k, data[262144 * k : 262144 * (k + 1)], "luma8") for k in range(6)], "image_id long, pixels binary, fmt string")
    h = sorted(hash_frames(every).collect(), key=lambda r: r.image_id)

    book.add(_needles(spark, [(0, h[0]), (3, h[3]), (4, h[4])]))
    (tmp_path / "in" / "b").write_bytes(data[262144 * 3 : 262144 * 5])
    got = _watched(spark, tmp_path)
    assert {k for k, *_ in got} == {3, 4} and {d for *_, d in got} == {2}  # frame 0 went by before its needle came

    # needle 4 goes, 5 comes, and a batch is lost after its version was written down; what changes then is not seen by it
    book.retire(spark.createDataFrame([(4,)], "needle_id long"))
    book.add(_needles(spark, [(5, h[5])]))
    (tmp_path / "in" / "c").write_bytes(data[262144 * 4 :])
    with monkeypatch.context() as m:
        m.setattr(watch.NeedleBook, "match", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            _watched(spark, tmp_path)
    other = watch.NeedleBook(spark, str(tmp_path / "book"))
    other.retire(spark.createDataFrame([(5,)], "needle_id long"))
    other.add(_needles(spark, [(6, h[5])]))
    again = _watched(spark, tmp_path)
    assert {k for k, *_ in again - got} == {5} and got < again
    assert _watched(spark, tmp_path) == again  # nothing new

    (tmp_path / "in" / "d").write_bytes(data[262144 * 5 :])
    assert {k for k, *_ in _watched(spark, tmp_path) - again} == {6}
    with pytest.raises(ValueError, match="another checkpoint"):
        watch.watch(P.stream_frames(spark, str(tmp_path / "in")), str(tmp_path / "book"), str(tmp_path / "out"), str(tmp_path / "new"))


def test_views_of_a_store(spark, tmp_path):
    from lumisieve.operators.store import HashStore

    row = lambda k: spark.createDataFrame([(k, k, 0, 0, 0)], "hash_id long, " + ", ".join(f"{w} long" for w in WORDS))
    store = HashStore.create(spark, str(tmp_path / "s"), row(1), buckets=2)
    first = list(store._batches)
    store.append(row(2))
    view = store.only(first)
    assert (view.rows, view.bounds) == (1, (1, 1)) and [r.hash_id for r in view.hashes().collect()] == [1]
    assert (store.rows, store.bounds) == (2, (1, 2)) and store.only([]).rows == 0


def test_a_book_groups_equal_hashes_when_all_rows_cost_more(spark, tmp_path, monkeypatch):
    """Pairs are those of plain matching, retired needles are left out, and nothing that was stored for it stays."""
    from lumisieve.functions.runtime import passing
    from lumisieve.operators import matching

    book = watch.NeedleBook.create(spark, str(tmp_path / "book"), buckets=4)
    words = "CAST(id % 3 AS LONG) AS w0, 0L AS w1, 0L AS w2, 0L AS w3"
    book.add(spark.sql(f"SELECT id AS needle_id, {words} FROM range(40)"))
    book.retire(spark.createDataFrame([(4,), (5,)], "needle_id long"))
    batch, now = spark.sql(f"SELECT id AS image_id, {words} FROM range(70)"), book.version()
    key = lambda: sorted(map(tuple, book.match(batch, now, 1).select("needle_id", "image_id", "dist").collect()))
    want, compared, real = key(), [], matching.all_distinct
    monkeypatch.setattr(watch, "all_distinct", lambda *x: compared.append(x) or real(*x))
    for name in ("GROUP_NS", "GROUPS_NS"):
        monkeypatch.setattr(matching, name, 0)
    with passing(spark):
        assert key() == want and compared and not {4, 5} & {n for n, *_ in want}
