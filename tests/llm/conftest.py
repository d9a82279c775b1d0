from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SENTENCE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="session")
def small(spark):
    """The first texts of the smallest table, with edits of them that are near copies: {doc_id: text}."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    out = {r.doc_id: r.text for r in rows}
    for n, r in enumerate(rows[:30]):
        w = r.text.split(" ")
        w[len(w) // 2] = "changed"
        out[10_000 + n] = " ".join(w)
    return out


@pytest.fixture(scope="session")
def edges():
    """Null, empty, blank, symbol, very long, tied and repeated texts: {doc_id: text}."""
    return {1: None, 2: "", 3: " \n\t ", 4: "!!! ... ###", 5: SENTENCE, 6: SENTENCE, 7: SENTENCE.upper(), 8: "one", 9: "one", 10: "word " * 40_000, 11: SENTENCE + "\n" + SENTENCE, 12: "x" * 200_000, 13: "Été ÉTÉ 12 ½ 中文 \u0301", 14: "<|endoftext|> it's"}


@pytest.fixture(scope="session")
def table(spark):
    """Makes documents of {doc_id: text}, with further columns whose names the operators use themselves."""

    def make(texts, **more):
        rows = [(i, t, "en", "src0", len(t or ""), 1, "x", 2, 3, 4) for i, t in texts.items()]
        schema = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, n long, u long, row long"
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
