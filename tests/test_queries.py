"""Every registered query of the engine runs, and equals its SQL where it has one."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lumisieve.plans import queries as Q


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].copy()
    for c in cols:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(4) + 0.0
    return cols, sorted(map(tuple, frame.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, con, name):
    got = Q.queries()[name](spark, sf).toPandas()
    if name in Q.oracle_sql():
        assert rows(got) == rows(con.execute(Q.oracle_sql()[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    """With its folder deleted, the other queries are all there."""
    import shutil
    import subprocess
    import sys

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "lumisieve", tmp_path / "lumisieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (top / name).exists():
            shutil.copy(top / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr
    assert set(said.stdout.split()) == set(Q.queries())
