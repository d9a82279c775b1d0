"""Pipeline stages one by one against plain Python, clashing names, interleaved pipelines, repeated ids."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from lumisieve.llm import chat, decontaminate, jaccard, langid, packing

SF = "/root/testdata/sf0.001"


def collected(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def staged(spark):
    """What each stage took and gave: {name: (texts before, rows after)}."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES:
        before, after = collected(docs), stage(spark, docs, SF)
        rows = after.toPandas()
        if name != "packing":
            assert after.columns == docs.columns
            docs = spark.createDataFrame(rows, after.schema)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        out[name] = before, rows
    return out


def texts(rows) -> dict:
    return dict(zip(rows.doc_id, rows.text))


def test_language_stage(spark, staged):
    before, rows = staged["language_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert texts(rows) == {d: t for d, t in before.items() if judged[d].lang_pred != langid.UND and judged[d].score >= langid.LEAST_SCORE}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d, r in judged.items() if r.held_out and truth[d]]
    assert sum(judged[d].lang_pred == truth[d] for d in held) >= 0.95 * len(held)


def test_line_stage(spark):
    """Only lines alike to an earlier one go, and nine tenths of those that have one."""
    rng = np.random.default_rng(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    lines = [x for t in collected(docs).values() for x in t.split("\n") if 20 <= len(" ".join(brute.alnum(x))) <= 160][:90]
    before = {k: "\n".join(lines[5 * k : 5 * k + 5]) for k in range(len(lines) // 5)}
    for k, x in enumerate(lines):  # one letter, or one word, of each is another
        w = x.split(" ")
        w[len(w) // 2] = "zq" if k % 2 else w[len(w) // 2][:-1] + "7"
        before[1000 + k] = f"only here {rng.integers(1 << 60):x} {rng.integers(1 << 60):x}\n" + " ".join(w)
    frame = spark.createDataFrame([(d, t, len(t)) for d, t in before.items()], "doc_id long, text string, n_chars long")
    after = collected(C.lines(spark, frame, SF))
    norm = lambda x: " ".join(brute.alnum(x))
    order = [(d, norm(x)) for d in sorted(before) for x in before[d].split("\n") if norm(x)]
    distinct = sorted({n for _, n in order}, key=len)
    group = brute.Groups(distinct)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if 5 * (len(b) - len(a)) > len(b):
                break
            counts = [np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=256) for x in (a, b)]
            if 5 * max((counts[0] - counts[1]).clip(0).sum(), (counts[1] - counts[0]).clip(0).sum()) <= len(b.encode()) and 5 * brute.edit_distance(a, b) <= len(b):
                group.join(a, b)
    seen, stay = set(), {}
    for d, n in order:
        if group.top(n) not in seen:
            seen.add(group.top(n))
            stay.setdefault(d, []).append(n)
    kept = {d: [norm(x) for x in t.split("\n") if norm(x)] for d, t in after.items()}
    due = sum(len(before[d].split("\n")) for d in before) - sum(map(len, stay.values()))
    left = sum(map(len, kept.values())) - sum(map(len, stay.values()))
    assert due >= 85 and 0 <= left <= 0.1 * due
    assert all(set(x) <= set(kept.get(d, [])) for d, x in stay.items())


def test_jaccard_stage(staged):
    before, rows = staged["ngram_jaccard"]
    groups = brute.jaccard_groups(before)
    assert texts(rows) == {d: t for d, t in before.items() if groups[d][1] == d}


def test_decontamination_stage(spark, staged):
    before, rows = staged["decontamination"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = brute.contamination(before, items)
    after = texts(rows)
    for d, t in before.items():
        n, hit, _ = found[d]
        if not hit:
            assert after[d] == t
        elif len(hit) == n:
            assert d not in after
        else:
            assert brute.alnum(after[d]) == [w for i, w in enumerate(brute.alnum(t)) if i not in hit], d
    assert any(hit for _, hit, _ in found.values())


def test_packing_stage(staged):
    from tokenizers import Tokenizer

    before, got = staged["packing"]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    assert set(got.doc_id) == set(before)
    for d, mine in got.groupby("doc_id"):
        ids = np.array([*tok.encode(before[d], add_special_tokens=False).ids, 1], "<u4")
        mine = mine.sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.start == mine.length.cumsum() - mine.length).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine.itertuples())
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_names_that_stages_once_used_themselves(spark, small):
    rows = [(i, t, "en" if i % 2 else "fr", 1, "m", True, 5) for i, t in list(small.items())[:60]] + [(999, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _touched long, _mark string, same boolean, row long")
    items = spark.createDataFrame([(1, small[3])], "item_id long, text string")
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns and 3 not in collected(out) and len(collected(out)) >= 50
    assert langid.keep_known(docs).columns == docs.columns and langid.keep_known(docs).count() > 30


def test_interleaved_pipelines(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folders = []
    for k in range(2):
        folders.append(str(tmp_path / str(k)))
        docs.where(F.col("doc_id") % 2 == k).write.parquet(f"{folders[k]}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folders[k]}/benchmark.parquet")
    mine = [spark.read.parquet(f"{f}/documents.parquet") for f in folders]
    first = C.language(spark, mine[0], folders[0])
    other = C.language(spark, mine[1], folders[1])
    later = C.near_duplicates(spark, spark.createDataFrame(other.toPandas(), other.schema), folders[1])
    packed = C.run(spark, folders[1])
    assert first.count() > 50 and later.count() > 50 and packed.count() > 50


def test_jaccard_of_rows_that_repeat_an_id(spark):
    a = [f"w{i}" for i in range(60)]
    b = [f"z{i}" for i in range(60)]
    near = " ".join([*a[:30], "changed", *a[31:]])
    for rows in ([(1, " ".join(a)), (1, " ".join(b)), (2, near), (None, " ".join(a)), (None, None), (3, None), (2, near)], [(1, " ".join(b)), (1, " ".join(a)), (2, near), (5, "x y")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()), key=str)
        size = lambda t: len(brute.shingles(t))
        want = sorted(((d, size(t), None if d is None else 1 if d in (1, 2) else d) for d, t in rows), key=str)
        assert got == want
    assert [r.class_id for r in jaccard.join(spark.createDataFrame([(7, "x y"), (4, "x y"), (5, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [4, 5, 4]


def test_chat_rows_that_repeat_a_node_stay_whole(spark):
    rows = [(1, 1, None, "user", "hello", 0.0), (1, 5, None, "user", "other root", 0.0), (1, 7, 5, "assistant", "A", 0.0), (1, 7, 1, "assistant", "B", 0.0)]
    for some in (rows, rows[::-1]):
        frame = spark.createDataFrame(some, "tree long, node long, parent long, role string, text string, score double")
        out = chat.format_trees(frame, paths=9).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
        assert {r.leaf: [t.text for t in r.turns] for r in out} == {7: ["hello", "B"], 5: ["other root"]}


def test_rows_without_an_id_are_judged_and_teach_nothing(spark, small):
    from lumisieve.llm import toxicity

    rows = [(i, t, "en" if i % 2 else "fr") for i, t in list(small.items())[:40]]
    docs = spark.createDataFrame([*rows, (None, "zzqx only here", "xx"), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, *_ in rows] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (langid.identify(docs), toxicity.judge(docs, labels)):
        got = out.collect()
        assert len(got) == 42 and [r.held_out for r in got if r.doc_id is None] == [None, None]
    assert {r.lang_pred for r in langid.identify(docs).collect()} <= {"en", "fr", langid.UND}
