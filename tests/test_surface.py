"""SQL functions, debug views and the command line."""

from __future__ import annotations

import numpy as np
import pytest

from lumisieve.__main__ import main
from lumisieve.functions import sql
from lumisieve.operators.hashing import pdqf
from lumisieve.sources import debug, frames


def test_sql_functions(spark):
    assert "hash_distance" in sql.register(spark)
    a, b = f"{1:064x}", f"{(1 << 255) + 3:064x}"
    row = spark.sql(f"SELECT hash_distance('{a}', '{b}') d, hash_bits('{b}') s, hash_word('{b}', 0) w, luma(255, 0, 0) l, lower_median(array(4D, 1D, 3D, 2D)) m, gradient_quality(90D) q").first()
    assert (row.d, row.s, row.w, row.m, row.q) == (2, f"{(1 << 255) + 3:0256b}", -(2**63), 2.0, 0.5) and row.l == pytest.approx(76.245)


def test_debug_views(spark):
    assert debug.ppm(np.array([[0.0, 1.0]])) == b"P6\n2 1\n255\n" + bytes([0, 0, 0, 255, 255, 255])
    coefs = pdqf(frames.random_frames(spark, 2))
    got = {r["class"]: r["count"] for r in debug.threshold_view(coefs).groupBy("class").count().collect()}
    assert got == {"median": 2, "correct": 510}


def test_command_line(spark, tmp_path, capsys):
    main(["describe"])
    assert "precise" in capsys.readouterr().out
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a").write_bytes(np.random.default_rng(1).bytes(262144 * 2))
    main(["pipe", str(tmp_path / "raw"), str(tmp_path / "out"), "--output-format", "HEX+nl", "--dihedrals"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 16 and all(x == x.upper() and len(x) == 64 for x in lines)
    with pytest.raises(ValueError):
        main(["pipe", str(tmp_path / "raw"), str(tmp_path / "no"), "--output-format", "octal"])
