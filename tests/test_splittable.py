"""Splittable frame files and the transactional record sink."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisieve.__main__ import main
from lumisieve.operators.hashing import hash_frames
from lumisieve.sources import frames as S, sinks, splittable as P
from lumisieve.streaming import pipe

FRAME = 262144


def write_frames(path: Path, n: int, seed: int, tail: bytes = b"", append: bool = False) -> None:
    with path.open("ab" if append else "wb") as f:
        f.write(np.random.default_rng(seed).bytes(FRAME * n) + tail)


def content(path: str) -> bytes:
    return b"".join(Path(p).read_bytes() for p in P.record_files(path))


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    write_frames(tmp_path / "a", 11, 1, bytes(512))
    write_frames(tmp_path / "b", 2, 2)
    (tmp_path / "_log").write_bytes(b"no frames")
    rows = P.read_frames(spark, str(tmp_path), partition_bytes=3 * FRAME)
    assert rows.rdd.getNumPartitions() == 5
    got = {(r.path.rsplit("/", 1)[1], r.frame_idx): bytes(r.pixels) for r in rows.collect()}
    for name, n in (("a", 11), ("b", 2)):
        raw = (tmp_path / name).read_bytes()
        assert {i: got[name, i] for i in range(n)} == {i: raw[i * FRAME : (i + 1) * FRAME] for i in range(n)}
    assert len(got) == 13
    whole = S.read_raw(spark, str(tmp_path / "a"))
    assert sorted(r.hash for r in hash_frames(rows.where("path like '%a'")).collect()) == sorted(r.hash for r in hash_frames(whole).collect())


def test_ends_of_files(spark, tmp_path):
    for name, n, tail in (("a", 2, b""), ("b", 1, bytes(512)), ("c", 1, bytes(7)), ("d", 0, b"")):
        write_frames(tmp_path / name, n, 3, tail)
    got = P.read_frames(spark, str(tmp_path), permissive=True)
    assert got.where("pixels is not null").count() == 4
    assert [r.error[-1] for r in got.where("error is not null").collect()] == ["c"]
    with pytest.raises(Exception, match="unexpected end"):
        P.read_frames(spark, str(tmp_path / "c")).count()
    with pytest.raises(ValueError):
        P.read_frames(spark, str(tmp_path), "cmyk")
    with pytest.raises(Exception, match="none"):
        P.read_frames(spark, str(tmp_path / "none")).count()


def test_stream_of_growing_files_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda: pipe.write(hash_frames(P.stream_frames(spark, str(tmp_path / "in"), partition_bytes=2 * FRAME)), out, log, "raw").awaitTermination()
    write_frames(tmp_path / "in/a", 5, 1, b"half a frame")
    run()
    assert len(content(out)) == 5 * 32
    want = [r.hash for r in hash_frames(P.read_frames(spark, str(tmp_path / "in/a"), permissive=True).where("pixels is not null"), keep=("frame_idx",)).orderBy("frame_idx").collect()]
    assert content(out).hex() == "".join(want)
    run()  # nothing new
    assert len(content(out)) == 5 * 32
    raw = (tmp_path / "in/a").read_bytes()
    (tmp_path / "in/a").write_bytes(raw[: 5 * FRAME])
    write_frames(tmp_path / "in/a", 3, 9, append=True)  # the file grows
    write_frames(tmp_path / "in/b", 1, 4)
    run()
    assert len(content(out)) == 9 * 32 and content(out).hex().startswith("".join(want))


def test_a_batch_that_was_published_is_not_written_again(spark, tmp_path):
    """As when the query is killed after the files are in place and before Spark notes it."""
    (tmp_path / "in").mkdir()
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda: pipe.write(hash_frames(P.stream_frames(spark, str(tmp_path / "in"))), out, log, "q+raw").awaitTermination()
    for n in range(2):
        write_frames(tmp_path / f"in/{n}", 2, n)
        run()
    before = content(out)
    for p in (tmp_path / "log/commits").iterdir():
        if p.name in ("1", ".1.crc"):
            p.unlink()
    run()
    assert content(out) == before and len(before) == 4 * 36
    assert not list((tmp_path / "out/_temporary").iterdir())


def test_records_equal_an_encoder(spark, tmp_path):
    write_frames(tmp_path / "raw", 3, 5)
    frames = P.read_frames(spark, str(tmp_path / "raw"))
    hashes = hash_frames(frames, dihedrals=True, with_pdqf=True, keep=("frame_idx",)).withColumn("quality", F.round("quality", 3)).persist()
    rows = hashes.orderBy("frame_idx", "ord").collect()
    want = {
        "raw": b"".join(bytes.fromhex(r.hash) for r in rows),
        "q+raw+nl": b"".join(struct.pack("<f", r.quality) + bytes.fromhex(r.hash) + b"\n" for r in rows),
        "q+HEX+crlf": "".join(f"{r.quality * 100:.3f}:{r.hash.upper()}\r\n" for r in rows).encode(),
        "bin+nul": "".join(f"{int(r.hash, 16):0256b}\0" for r in rows).encode(),
        "diagnostic": "".join(_diagnostic(rows[k - k % 8], r) for k, r in enumerate(rows)).encode(),
    }
    for spec, data in want.items():
        path = str(tmp_path / ("as_" + spec.replace("+", "_")))
        sinks.write_records(hashes, path, spec, ("frame_idx", "ord"), batch=0)
        sinks.write_records(hashes, path, spec, ("frame_idx", "ord"), batch=0)  # a second time, as by a driver that was restarted
        assert content(path) == data, spec
    sinks.write_records(hashes.where("frame_idx = 1"), path, "diagnostic", ("frame_idx", "ord"))
    assert content(path) == want["diagnostic"] + "".join(_diagnostic(rows[8], r) for r in rows[8:16]).encode()
    hashes.unpersist()


def _diagnostic(first, r) -> str:
    packed = [0x01000001, 0xFF000001, 0xFF0000FF, 0x010000FF, 0x00FFFF00, 0x00010100, 0x00FF0100, 0x0001FF00][r.ord]
    name = '["original"]' if r.ord == 0 else f"[Dihedrals {{ packed: {packed} }}]"
    cells = [("*" if v > first.threshold else "") + f"{v:.5f}" for v in r.pdqf]
    table = "".join("\t".join(cells[16 * k : 16 * k + 16]) + "\n" for k in range(16))
    return f"{name}\nIndex: {r.ord}\nQuality: {r.quality * 100:.3f}\nThreshold: {r.threshold:.7f}\nHash:\n{int(r.hash, 16):0256b}\nPDQF:\n{table}"


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.encode(F.lit("x"), "UTF-8")).cast("binary").alias("record"))
    P.register(spark)
    with pytest.raises(Exception, match="broken"):
        rows.write.format(P.SINK).mode("append").save(str(tmp_path / "out"))
    assert content(str(tmp_path / "out")) == b""


def test_overwrite(spark, tmp_path):
    P.register(spark)
    for word in ("one", "two"):
        spark.range(1).select(F.encode(F.lit(word), "UTF-8").alias("record")).write.format(P.SINK).mode("overwrite").save(str(tmp_path / "out"))
    assert content(str(tmp_path / "out")) == b"two"


def test_command_line_raw(spark, tmp_path):
    write_frames(tmp_path / "a", 2, 8)
    main(["pipe", str(tmp_path / "a"), str(tmp_path / "out"), "--output-format", "q+raw", "--dihedrals"])
    assert len(content(str(tmp_path / "out"))) == 16 * 36
