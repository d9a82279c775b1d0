"""Each operator against brute force, an exact round trip or held-out accuracy, and on hard rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import alnum, contamination, deduped_lines, edit_distance, jaccard_groups, lower, words

from pyspark.sql import functions as F

from lumisieve.llm.scratch import Scratch
from lumisieve.llm import chat, decontaminate, edits, jaccard, langid, linededup, lmscore, packing, quality, queries, textvec as T, toxicity, urlrules

SF = "/root/testdata/sf0.001"


def simhash(norm: str) -> int:
    total = [0] * 64
    w = norm.split(" ")
    for x in w:
        data, offs = T.buffers(pa.array([x]))
        h = int(T.span_hashes(data, offs[:-1], offs[1:])[0])
        for k in range(64):
            total[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * total[k] > len(w))


def records(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}



@pytest.mark.parametrize("case", ["small", "edges"])
def test_jaccard(case, request, table):
    texts = request.getfixturevalue(case)
    assert records(jaccard.join(table(texts)), "doc_id", "n_shingles", "component_id") == jaccard_groups(texts)


def test_jaccard_of_a_large_group_of_near_copies(table):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(150):
        w = list(base)
        w[int(rng.integers(120))] = f"z{d}"
        texts[d] = " ".join(w)
    got = records(jaccard.join(table(texts)), "doc_id", "n_shingles", "component_id")
    assert got == jaccard_groups(texts)


@pytest.mark.parametrize("case", ["small", "edges"])
def test_line_dedup(case, request, table):
    texts = request.getfixturevalue(case)
    if case == "edges":
        texts = {k: v for k, v in texts.items() if k not in (10, 12)}  # plain Python is too slow for these two
    got = records(linededup.dedup(table(texts), radius=linededup.RADIUS), "doc_id", "text", "n_removed")
    expected = deduped_lines(texts, simhash)
    assert {d: t for d, (t, _) in got.items()} == expected
    assert all((n > 0) == (texts[d] != t) for d, (t, n) in got.items())


def test_line_dedup_finds_edits_that_move_simhash(small, table):
    """One character is added to a word, or a tenth of the characters change: nearly all such copies go."""
    rng = np.random.default_rng(5)
    lines = sorted({x for t in small.values() for x in (t or "").split("\n") if 20 <= len(x) <= 400})[::12]
    for share, least in ((0.0, 0.99), (0.1, 0.9)):
        texts = dict(enumerate(lines))
        for i, x in enumerate(lines):
            chars = list(x)
            for at in rng.choice(len(x), max(1, int(share * len(x))), replace=False) if share else ():
                chars[at] = "q"
            texts[10_000 + i] = "".join(chars) if share else x.replace(" ", "q ", 1)
        got = records(linededup.dedup(table(texts)), "doc_id", "n_removed")
        alone = [i for i in range(len(lines)) if not got[i][0]]
        assert len(alone) > 0.7 * len(lines)
        assert sum(got[10_000 + i][0] for i in alone) >= least * len(alone)


def test_line_dedup_against_edit_similarity_alone(small, edges, table):
    """Every pair of an edit similarity of 0.8, by word or letter edits and line length; no line goes without one."""
    rng = np.random.default_rng(7)
    lines = sorted({" ".join(w) for t in small.values() for x in (t or "").split("\n") if (w := alnum(x))})[::9]
    first = dict(enumerate(lines))
    made = {}
    for i, x in enumerate(lines):
        w = x.split(" ")
        at = int(rng.integers(len(w)))
        made[100_000 + i] = (i, " ".join([*w[:at], "zzq"[: 1 + at % 3], *w[at + 1 :]]))
        letter = int(rng.integers(len(x)))
        made[200_000 + i] = (i, x[:letter] + "y" + x[letter + 1 - i % 2 :])
    texts = first | {k: x for k, (_, x) in made.items()}
    got = records(linededup.dedup(table(texts)), "doc_id", "n_removed")
    similar = lambda a, b: 5 * edit_distance(" ".join(alnum(a)), " ".join(alnum(b))) <= max(len(" ".join(alnum(a))), len(" ".join(alnum(b))))
    groups = defaultdict(lambda: [0, 0])
    for k, (i, x) in made.items():
        if similar(x, lines[i]):
            cell = groups[k // 100_000, min(4, len(x.split(" ")) // 10)]
            cell[0] += 1
            cell[1] += got[k][0]
    assert sum(n for n, _ in groups.values()) > len(lines)
    assert all(hit >= 0.9 * n for n, hit in groups.values()), dict(groups)
    gone = [i for i in first if got[i][0]]
    assert all(any(similar(lines[i], x) for k, x in texts.items() if k < i) or any(similar(lines[i], y) for y in texts.values() if y != lines[i]) for i in gone[:20])


def test_grouping_in_turns_finds_what_union_find_finds(spark, table):
    """Large buckets of several groups: every line has its near copies, and no other."""
    rng = np.random.default_rng(8)
    phrase = "a passage that very many lines of all groups have in common as it is"
    texts, group = {}, {}
    for g in range(40):
        own = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(14)]
        for k in range(5):
            w = list(own)
            w[k] = f"other{k}"
            texts[g * 10 + k], group[g * 10 + k] = " ".join([*w[:7], phrase, *w[7:]]), g
    got = records(linededup.dedup(table(texts)), "doc_id", "n_removed")
    assert {i for i in texts if not got[i][0]} == {g * 10 for g in range(40)}


def test_large_buckets_are_compared_in_tasks_once_for_each_pair(spark, small):
    """In parts and by passes, each pair that shares keys is found once, and no row is made for those that do not hold."""
    rng = np.random.default_rng(12)
    lines = sorted({" ".join(w) for t in small.values() for x in (t or "").split("\n") if 40 <= len(x) <= 120 and (w := alnum(x))})[:12]
    texts = [*lines, *(x[:-1] + "q" for x in lines), *("y" + x[1:] for x in lines)]
    keys = [sorted(rng.choice(5, int(rng.integers(1, 5)), replace=False).tolist()) for _ in texts]
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)], "node long, norm string, size int")
    rows = spark.createDataFrame([(k, i, len(x), i, 36, 36 * 100) for i, x in enumerate(texts) for k in keys[i]], "key long, node long, size int, comp long, many long, bytes long")
    expected = {(i, j) for i in range(len(texts)) for j in range(i) if set(keys[i]) & set(keys[j]) and 5 * edit_distance(texts[i], texts[j]) <= max(len(texts[i]), len(texts[j]))}
    members = linededup.MEMBERS
    for most, passes in ((members, 1), (10, 3)):
        linededup.MEMBERS = most
        try:
            scratch = Scratch(spark, "together")
            got = [(max(r), min(r)) for found in linededup._together(rows, docs, linededup._sketched(docs), scratch, passes) for r in found.collect()]
            scratch.close()
        finally:
            linededup.MEMBERS = members
        assert len(got) == len(set(got)) and set(got) == expected


def test_line_filters_lose_no_pair_and_leave_out_most_others(small):
    """Edits of a fifth pass the letter pairs of short lines; promising pairs pass the cells of others, and strange ones do not."""
    rng = np.random.default_rng(11)
    lines = sorted({" ".join(w) for t in small.values() for x in (t or "").split("\n") if (w := alnum(x))})
    short = [x for x in lines if 5 <= len(x) < 64] + ["été 中文 zwölf ñandú", "aaaaaaaaaa", "ababababab"]
    changed = []
    for x in short:
        for _ in range(len(x) // 5):
            at, kind = int(rng.integers(len(x))), int(rng.integers(3))
            x = x[:at] + ("é", "", "q" + x[at])[kind] + x[at + 1 :]
        changed.append(x)
    most = np.array([max(len(x), len(y)) // 5 * 2 for x, y in zip(short, changed)])
    a, b = (linededup.letter_pairs(pa.array(t, pa.string())) for t in (short, changed))
    assert all((np.bitwise_count(p & ~q).sum(axis=0) <= most).all() for p, q in ((a, b), (b, a)))

    long = [x for x in lines if 100 <= len(x) < 2000][:300]
    phrase = " a passage that is in all of them "
    one = [x[:50] + phrase + x[50:] for x in long]
    near = []
    for x in one:
        chars = list(x)
        for at in rng.choice(len(x), len(x) // int(rng.integers(6, 12)), replace=False):
            chars[at] = "q"
        near.append("".join(chars))
    for two, share in ((near, 1.0), (one[1:] + one[:1], 0.2)):
        size = np.array([[len(t) for t in x] for x in (one, two)])
        (x, m), (y, n) = (linededup.gram_cells(*T.buffers(pa.array(t, pa.string())), s) for t, s in zip((one, two), size))
        ids = np.arange(len(one))
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, ids, *size, m, n)] + [pa.array([r.tobytes() for r in c], pa.binary()) for c in (x, y)], list("uvmnxyab"))
        kept = np.asarray(next(linededup._may_share([batch])).column(0))
        fit = 5 * abs(size[0] - size[1]) <= size.max(axis=0)
        hope = edits.promising(pa.array(one), pa.array(two), size.max(axis=0))
        assert set(ids[hope & fit]) <= set(kept)
        assert len(kept) <= max(share * len(ids), 1.5 * hope.sum())


def test_block_layouts_lose_no_pair():
    rng = np.random.default_rng(1)
    for nodes in (10, 10**4, 10**7, 10**9):
        masks = linededup.layout(nodes)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("case", ["small", "edges"])
def test_decontamination(case, request, spark, table):
    texts = dict(request.getfixturevalue(case))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()} | {900: None, 901: "", 902: "eleven TWELVE", 903: "one two three four five six seven eight nine ten eleven"}
    texts[777] = "Zz, " + (items[0] or "") + " yy"
    frame = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = contamination(texts, items)
    digest = lambda x: hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest()
    want = {d: (n, len(h), len(f), digest(f), bool(h)) for d, (n, h, f) in expected.items()}
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert records(decontaminate.report(table(texts), frame), *columns) == want
    blocks = decontaminate.spans(table(texts), frame, block_bytes=2000)
    assert {d: sum(e - b for b, e in zip(begins, ends)) for d, (begins, ends) in records(blocks, "doc_id", "begins", "ends").items()} == {d: w[1] for d, w in want.items()}
    cleaned = records(decontaminate.clean(table(texts), frame), "doc_id", "text")
    for d, (n, hit, _) in expected.items():
        left = [w for i, w in enumerate(alnum(texts[d])) if i not in hit]
        assert (d not in cleaned) if hit and not left else alnum(cleaned[d][0]) == left
        assert hit or cleaned[d][0] == texts[d]


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    doc = [rng.integers(0, 6, n).astype(np.uint64) for n in (200, 0, 1, 57, 400)]
    flat, bounds = np.concatenate(doc), np.cumsum([0, *map(len, doc)])
    index = decontaminate.FMIndex(flat, bounds)
    phrases = [rng.integers(0, 7, n).astype(np.uint64) for n in rng.integers(1, 6, 80)]
    start = np.cumsum([0, *map(len, phrases)])
    found, lo, hi = index.search(np.concatenate(phrases), start[:-1], np.diff(start))
    which, place = index.locate(lo, hi)
    got = defaultdict(set)
    for w, p in zip(found[which].tolist(), place.tolist()):
        got[w].add(p)
    for i, ph in enumerate(phrases):
        want = {int(b) + k for b, d in zip(bounds, doc) for k in range(len(d) - len(ph) + 1) if (d[k : k + len(ph)] == ph).all()}
        assert got[i] == want


@pytest.mark.parametrize("case", ["small", "edges"])
def test_packing_round_trip(case, request, table):
    from tokenizers import Tokenizer

    texts = request.getfixturevalue(case)
    got = packing.pack(table(texts), bin_pieces=100).toPandas()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == d].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert (mine.start == mine.length.cumsum() - mine.length).all()
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    rows = got.sort_values(["sequence_id", "offset"])
    assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
    window, offset = packing.best_fit(lengths, 100)
    room: list[int] = []
    for x, w, o in zip(lengths, window, offset):
        fits = [r for r in room if r >= x]
        if w == len(room):
            assert not fits
            room.append(100)
        else:
            assert room[w] == min(fits)
        assert o == 100 - room[w]
        room[w] -= x


def test_language_of_held_out_texts(spark):
    got = queries.op4_word_backoff_langid(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    assert (docs.held_out == docs.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = docs[docs.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and docs.score.between(0, 1).all()


def test_language_edge_cases(table, edges):
    got = records(langid.identify(table(edges)), "doc_id", "lang_pred", "score")
    assert all(got[d] == ("und", 0.0) for d in (1, 2, 3, 4))
    assert got[5][0] == got[13][0] == "en" and len(got) == len(edges)
    assert {r.doc_id for r in langid.keep_known(table(edges)).collect()} == set(edges) - {1, 2, 3, 4}


def test_language_tables_keep_every_count(spark, table):
    """More words than any bound of old, each seen once: the last of them is known, in its own language."""
    from lumisieve.llm.scratch import Scratch

    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(" ".join(name(i) for i in range(lo, lo + 1000)), "aa") for lo in range(0, 210_000, 1000)] + [("zzzz " * 3, "bb")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), Scratch(spark, "langid"))
    assert model.langs == ["aa", "bb"] and model.tables[0].count() == 210_001
    got = records(langid.predict(table({1: name(5), 2: name(209_999), 3: "zzzz", 4: None}), model, Scratch(spark, "langid")), "doc_id", "lang_pred")
    assert got == {1: ("aa",), 2: ("aa",), 3: ("bb",), 4: ("und",)}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(order, table, small, edges, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 60_000)
    texts = small | {d + 50_000: t for d, t in edges.items()}
    tok = {d: [*words(lower(t)), None] for d, t in texts.items()}
    train = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d in texts}
    count = Counter(w for d in texts if train[d] for w in tok[d])
    total, kinds = sum(count.values()), len(count)
    got = records(lmscore.score(table(texts), langid.fold(10) != 0, order), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for d, w in tok.items():
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        assert got[d][:3] == (len(w), sum(count[x] > 0 for x in w), total)
        assert got[d][3] == pytest.approx(base) and got[d][4] < 0
    held = [d for d in small if not train[d]]
    assert sum(got[d][4] for d in held) > sum(got[d][3] for d in held)


def test_language_model_counts_come_without_searches(monkeypatch):
    """Counts of n-grams and contexts, starts and empty texts included, are those of plain Python; no token is searched for."""
    monkeypatch.setattr(T, "lookup", None)
    texts = ["a b a b c", "", "b A b", "a"]
    table = pa.table({"text": texts, "chunk": pa.array([3] * 4), "train": [True, True, False, True], "deleted": [False, False, False, True]})
    answers = lmscore._answer(lmscore._ask(3, 1, (1, 2, 3))(table))
    answers = answers.filter(pa.array(np.asarray(answers.column("chunk")) >= 0))
    rows = [["^", "^", *t.lower().split(), "$"] for t in texts]
    for minus in (False, True):
        seen = Counter()
        for row, learned in zip(rows, [1, 1, 0, 0 if minus else 1]):
            for i in range(2, len(row)):
                seen.update({tuple(row[i - k : i + 1]): learned for k in range(3)})
            seen.update({("^",): learned, ("^", "^"): learned})
        _, _, unigram, ratios, _ = lmscore._estimates(table, answers, 3, minus)
        at = [(row, i) for row in rows for i in range(2, len(row))]
        assert unigram.tolist() == [seen[(row[i],)] for row, i in at]
        for k, ratio in enumerate(ratios, 1):
            assert ratio.tolist() == [seen[tuple(row[i - k : i + 1])] / max(1, seen[tuple(row[i - k : i])]) for row, i in at]


def test_language_model_estimates():
    """Interpolated estimates sum to one over the vocabulary and one unknown word, in every context seen."""
    docs = ["a b a c", "b a b", "c"]
    data, offs = T.buffers(pa.array(docs))
    tok, cut = lmscore.tokens(data, offs)
    grams, vocabulary = lmscore.grams(tok, cut, 2), np.unique(tok)
    context = lmscore.context(tok, cut, 2, grams)
    for c in np.unique(context):
        after = tok[context == c]
        shares = [np.mean(after == v) for v in vocabulary]
        mix = 0.2 / (len(vocabulary) + 1) + 0.3 * np.array([np.mean(tok == v) for v in vocabulary]) + 0.5 * np.array(shares)
        assert mix.sum() + 0.2 / (len(vocabulary) + 1) == pytest.approx(1)
    assert len(np.unique(context)) == len({(x,) for x in "ab"} | {("c",), ("<s>",)})


def test_quality(table, small, edges):
    texts = small | {d + 50_000: t for d, t in edges.items()}
    got = records(quality.judge(table(texts)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t in texts.items():
        w = words(t)
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        rows = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        assert got[d][:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(rows) - len(set(rows)), len(cover), failed), d
        assert not (failed and got[d][6])
    plain = [d for d in small if not got[d][5] and got[d][2] == got[d][3] == 0 and small[d] == small[d].replace("|", "")]
    assert sum(got[d][6] for d in plain) > 0.97 * len(plain)


def test_chi_squared_quantile():
    assert quality.chi2_quantile(0.05, 6) == pytest.approx(12.5916, abs=1e-3) and quality.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2))


def test_mcd_resists_outliers(spark):
    rng = np.random.default_rng(0)
    inner, outer = rng.normal(size=(800, 6)), rng.normal(size=(150, 6)) + 15
    rows = spark.createDataFrame([(1, *map(float, x)) for x in np.concatenate([inner, outer])], "g long, " + ", ".join(f"{v} double" for v in quality.VECTOR))
    fits, groups = quality.mcd(rows, Scratch(spark, "test"))
    (fit,) = fits.collect()
    cov = quality._matrices(np.array([fit.c]))[0]
    assert groups == 1 and fit.n == 950
    assert np.abs(fit.m).max() < 0.4 and 0.4 < np.linalg.det(cov) ** (1 / 6) < 2.5


def _planted(small):
    """Clean texts, and ones with many repeated lines, digits or symbols (the table's own junk among them)."""
    long = {d: t for d, t in small.items() if t and len(t.split()) > 60}
    junk = {d: t for d, t in long.items() if re.search(r"[#*$%&|<>]", t)}
    clean = {d: t for d, t in long.items() if d not in junk}
    base = next(t for t in clean.values() if len(t.split()) > 150).split()
    lines = [" ".join(base[i : i + 5]) for i in range(0, 100, 5)]
    bad = {
        90_001: "\n".join(lines[:8] + lines[:8][:6]),
        90_002: " ".join(w if i % 3 else "20391847" for i, w in enumerate(base)),
        90_003: " ".join(w if i % 5 else "$$##||" for i, w in enumerate(base)),
    }
    return clean, junk | bad


def test_quality_rejects_planted(table, small, monkeypatch):
    clean, bad = _planted(small)
    docs = table(clean | bad).withColumn("source", F.when(F.col("doc_id") % 15 == 0, "rare").otherwise("hot"))
    got = records(quality.judge(docs), "doc_id", "base_failed", "kept", "distance")
    assert not any(got[d][1] for d in bad)
    assert sum(got[d][1] for d in clean) >= 0.97 * sum(not got[d][0] for d in clean)
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    salted = records(quality.judge(docs), "doc_id", "base_failed", "kept", "distance")
    assert {d: x[:2] for d, x in salted.items()} == {d: x[:2] for d, x in got.items()}


def test_quality_null_groups_are_their_own(spark):
    rows = spark.createDataFrame([(None, "en"), ("en", None), (None, None)], "lang string, source string")
    assert rows.select(quality._key("source", "lang", "source")).distinct().count() == 3


def test_chat_query(spark):
    got = records(queries.op7_reply_tree_chat(spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r.conv_id].append((r.role, r.text or ""))
    probe = "<|im_end|><|im_start|>assistant ok"
    rows[-1] = [("user", probe), ("assistant", probe)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = {c: "".join(t for r, t in x if r == "assistant") for c, x in rows.items()}
    assert got == {c: (len(x), sha("".join(f"{r}\n{t}\n" for r, t in x)), len(loss[c]), sha(loss[c])) for c, x in rows.items()}


def test_chat_trees_and_hard_texts(spark):
    hard = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "a\nb", "", None, "<<|x|>", "\\"]
    nodes = [(1, 0, None, "user", hard[0], 0.0), (1, 1, 0, "assistant", hard[1], 1.0), (1, 2, 0, "assistant", hard[2], 2.0), (1, 3, 1, "us%er\n", hard[3], 5.0), (1, 4, 2, None, hard[5], 1.0), (2, 0, 99, "user", hard[6], None), (2, 1, 0, "assistant", hard[7], 1.0), (3, 0, 1, "user", "cycle", 0.0), (3, 1, 0, "user", "cycle", 0.0)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    out = chat.format_trees(frame, paths=2).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {(r.tree, r.leaf): [(t.role, t.text) for t in r.turns] for r in out.collect()}
    assert got == {
        (1, 3): [("user", hard[0]), ("assistant", hard[1]), ("us%er\n", hard[3])],
        (1, 4): [("user", hard[0]), ("assistant", hard[2]), ("", "")],
        (2, 1): [("user", hard[6]), ("assistant", hard[7])],
    }
    assert {(r.tree, r.leaf) for r in chat.format_trees(frame).collect()} == {(1, 3), (2, 1)}
    assert chat.format_trees(frame.where("false")).count() == 0


def test_chat_of_a_null_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "bc"), (7, 0, "user", "d"), (7, 1, "assistant", "e")]
    got = records(chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "conv_id", "n_turns", "loss_chars")
    assert got == {None: (2, 2), 7: (2, 1)}


def test_toxicity_of_held_out_texts(spark):
    got = queries.op8_nb_char_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (held.toxic == held.predicted).mean() > 0.9 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all() and len(got) == 1000


def test_toxicity_edge_cases(spark, table, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.judge(table(edges), none).collect()} == {0.5}
    some = spark.createDataFrame([(d, 1, d % 2) for d in edges] + [(999, 1, 1)], "doc_id long, quality int, toxic int")
    got = records(toxicity.judge(table(edges), some), "doc_id", "score")
    assert len(got) == len(edges) and got[1] == got[2] == got[3] == got[4]


def test_urls(spark):
    urls = [None, "no host", "http://Example.COM/en/7?x", "https://a.b.example.com/en/8#f", "x://com/en/", "http://xcom/en/1", "http://example.net/de/81", "http://m.net/de/8", "http://org?/es/", "http://a.org/es/1", "http://bad.spam.io/buy/1"]
    urls += ["http://bad.spam.io/buy/2"] * 40 + ["http://good.site.io/read/3"] * 40
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if u and "spam" in u else 1, 0) for i, u in enumerate(urls)], "doc_id long, quality int, toxic int")
    got = records(urlrules.judge(pages, labels), "page_id", "host", "path", "rule", "verdict", "mined")
    assert [got[i][:4] for i in range(10)] == [("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/en/7", "example.com/en/7", "allow"), ("a.b.example.com", "/en/8", "com/en/", "block"), ("com", "/en/", "com/en/", "block"), ("xcom", "/en/1", None, "allow"), ("example.net", "/de/81", "example.net/de/8", "block"), ("m.net", "/de/8", "net/de/", "allow"), ("org", "", None, "allow"), ("a.org", "/es/1", "org/es/", "block")]
    assert got[10][3:] == got[50][3:] == ("block", True) and got[51][3:] == ("allow", False)


def test_mined_rules_decide_held_out_pages(spark):
    """Bad numbered hosts among good ones, with a label in ten turned; a fifth of the pages has no label."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        site = int(rng.integers(1, 6))
        rows.append((i, f"https://site{site}.shop.test/item/{i}?ref=x&page=2", site == 3))
    rows += [(600 + i, "https://long.test/" + "/".join(f"part{k}" for k in range(40)), False) for i in range(30)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(b == (rng.random() < 0.1)), 0) for i, _, b in rows if i % 5], "doc_id long, quality int, toxic int")
    got = records(urlrules.judge(pages, labels), "page_id", "verdict")
    held = [(got[i][0] == "block", b) for i, _, b in rows if i % 5 == 0]
    assert all(x == b for x, b in held) and sum(b for _, b in held) > 10


def test_rules_need_a_bound_above_the_share(spark):
    """Without any connexion of tokens and labels nothing is mined; nor from fewer than the least pages."""
    rng = np.random.default_rng(6)
    noise = [(f"https://h{i % 7}.test/{i % 3}", bool(rng.random() < 0.5)) for i in range(700)]
    few = [("https://bad.test/x", True)] * 9 + [("https://good.test/x", False)] * 90
    for rows, rules in ((noise, 0), (few, 0), (few + few[:1], 1)):
        assert urlrules.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == rules


def test_empty_tables(spark, table):
    empty = table({1: "x"}).where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    made = [jaccard.join(empty), linededup.dedup(empty), decontaminate.report(empty, items), packing.pack(empty), langid.identify(empty), lmscore.score(empty, langid.fold(10) != 0), quality.judge(empty), toxicity.judge(empty, labels), urlrules.judge(pages, labels)]
    assert [m.count() for m in made] == [0] * len(made)
    assert decontaminate.report(table({1: "x y"}), items).first().n_hit == 0


def test_repeated_rows(spark, table, edges):
    twice = table(edges).union(table(edges))
    items = spark.createDataFrame([(1, edges[5])], "item_id long, text string")
    assert jaccard.join(twice).count() == linededup.dedup(twice).count() == decontaminate.report(twice, items).count() == 2 * len(edges)
    assert packing.pack(twice).groupBy("doc_id").sum("length").where("sum(length) % 2 = 1").count() == 0
    assert quality.judge(twice).count() == lmscore.score(twice, langid.fold(10) != 0).count() == 2 * len(edges)


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES][0] == "language_id" and len(C.STAGES) == 5 and C.ORACLE_SQL is None
    for _, stage in C.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.toPandas(), after.schema)
    assert C.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count() == C.run(spark, SF).select("doc_id").distinct().count()


def test_toxicity_scores_by_hand(spark, small, edges, table):
    """Scores from given weights, with plain dictionaries."""
    rng = np.random.default_rng(9)
    weights = np.where(rng.random(toxicity.FEATURES) < 0.5, rng.normal(size=toxicity.FEATURES), 0.0)
    texts = dict(list(small.items())[:60]) | {d + 50_000: t for d, t in edges.items()}
    shared = spark.sparkContext.broadcast((weights, -0.25))
    got = records(table(texts).select("doc_id", "text").mapInArrow(toxicity._score(shared), "doc_id long, score double"), "doc_id", "score")
    cells: dict[bytes, set[int]] = {}
    for d, t in texts.items():
        w = re.findall(rb"[0-9a-z\x80-\xff]+", lower(t).encode())
        total = Counter()
        for x, n in Counter(w).items():
            if x not in cells:
                word = pa.array([x], pa.binary()).cast(pa.string())
                cells[x] = {int(h) % toxicity.FEATURES for k in toxicity.ORDERS for h in langid.word_grams(word, k)[1]}
            for c in cells[x]:
                total[c] += n
        z = -0.25 + sum(weights[c] * math.log1p(toxicity.SCALE * n / len(w)) for c, n in total.items())
        assert got[d][0] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9), d


def test_bounded_edit_distances_are_exact_up_to_the_bound():
    """Within the bound they are those of plain dynamic programming, beyond it they are above it; counts lose no pair within it."""
    rng = np.random.default_rng(4)
    one, two = [], []
    for k in range(90):
        x = list(rng.choice(list("abcdeé "[: 3 + k % 5]), int(rng.integers(1, [60, 150, 400][k % 3]))))
        y = list(x)
        for _ in range(int(len(x) * rng.random() * 0.4)):
            p = int(rng.integers(0, len(y)))
            y[p : p + int(rng.integers(0, 2))] = list(rng.choice(list("abcé"), int(rng.integers(0, 2)))) if len(y) > 1 else ["z"]
        one.append("".join(x)), two.append("".join(y[len(y) // 5 :] + y[: len(y) // 5] if k % 7 == 0 else y))
    (a, at), (b, bt) = (T.code_points(pa.array(x)) for x in (one, two))
    want = np.array([edit_distance(x, y) for x, y in zip(one, two)])
    assert edits.distances(a, at, b, bt).tolist() == want.tolist()
    for share in (2, 5, 12):
        most = np.maximum(np.diff(at), np.diff(bt)) // share
        got = edits.distances(a, at, b, bt, most)
        assert (np.where(want <= most, got, most + 1) == np.minimum(want, most + 1)).all() and (got > most)[want > most].all()
        assert edits.counts_allow(np.asarray(a), at, np.asarray(b), bt, most)[want <= most].all()
