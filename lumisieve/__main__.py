"""Command line: pipe, random-stream, bench, busyloop, describe.

    python -m lumisieve pipe INPUT OUTPUT [--format luma8] [--output q+hex+nl] [--mode variant] [--dihedrals] [--stream LOG]
    python -m lumisieve random-stream OUTPUT [--frames 100] [--format luma8] [--seed 0]
    python -m lumisieve bench [--frames 1000]
    python -m lumisieve busyloop [--seconds 10] [--rate 200]
    python -m lumisieve describe
"""

from __future__ import annotations

import argparse
import time
from contextlib import nullcontext

from pyspark.sql import SparkSession

from .functions.constants import MODES
from .operators.hashing import BYTES, describe, hash_frames
from .sources import frames as S, sinks
from .sources.splittable import read_frames, stream_frames
from .streaming import pipe
from .streaming.stats import FrameRates, soak


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumisieve", description="Perceptual hashes of frames.")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("pipe", help="hash raw frames to records of any format")
    p.add_argument("input"), p.add_argument("output")
    p.add_argument("--format", default="luma8", choices=sorted(BYTES)), p.add_argument("--output-format", default="hex+nl")
    p.add_argument("--mode", default=MODES[0], choices=MODES), p.add_argument("--dihedrals", action="store_true")
    p.add_argument("--stream", metavar="LOG", help="take new frames only, with progress kept in LOG")
    p.add_argument("--stats", action="store_true", help="say frames a second of each batch of a stream")
    r = sub.add_parser("random-stream", help="write files of seeded random frames")
    r.add_argument("output"), r.add_argument("--frames", type=int, default=100), r.add_argument("--seed", type=int, default=0)
    r.add_argument("--format", default="luma8", choices=sorted(BYTES))
    b = sub.add_parser("bench", help="frames hashed in a second")
    b.add_argument("--frames", type=int, default=1000), b.add_argument("--mode", default=MODES[0], choices=MODES)
    y = sub.add_parser("busyloop", help="hash random frames that arrive at a rate")
    y.add_argument("--seconds", type=float, default=10), y.add_argument("--rate", type=int, default=200), y.add_argument("--mode", default=MODES[0], choices=MODES)
    sub.add_parser("describe", help="names of the algorithms")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "describe":
        print("\n".join(describe(m) for m in MODES))
        return
    spark = SparkSession.builder.appName("lumisieve").getOrCreate()
    if a.command == "pipe":
        kind, _ = sinks.parse(a.output_format)
        keep = ("path", "frame_idx")
        if a.stream:
            with FrameRates(spark, say=True) if a.stats else nullcontext():
                pipe.write(hash_frames(stream_frames(spark, a.input, a.format), a.mode, a.dihedrals), a.output, a.stream, a.output_format).awaitTermination()
        else:
            hashes = hash_frames(read_frames(spark, a.input, a.format), a.mode, a.dihedrals, with_pdqf=kind == "diagnostic", keep=keep)
            sinks.write_records(hashes, a.output, a.output_format, (*keep, "ord"))
    elif a.command == "random-stream":
        S.random_frames(spark, a.frames, a.format, a.seed).select("image_id", "pixels").write.parquet(a.output)
    elif a.command == "busyloop":
        found = soak(spark, a.seconds, a.rate, a.mode)
        print(f"{found.frames} frames in {found.batch} batches, {found.per_second:.1f} a second")
    else:
        began = time.time()
        hash_frames(S.random_frames(spark, a.frames), a.mode).write.format("noop").mode("overwrite").save()
        print(f"{a.frames / (time.time() - began):.1f} frames a second")


if __name__ == "__main__":
    main()
