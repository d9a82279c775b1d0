"""Substring dedup, the filter interaction audit and periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from lumisieve.llm import audit, periodic, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mini long, skid long, spans string, same long, part string, mask int, least long"


def documents(spark, rows):
    """Rows (doc_id, text, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, 0, 1, 2, "x", 3, "y", 4, 5) for d, t, s in rows], DOCS).repartition(3)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs -------------------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_sequences(letters):
    rng = random.Random(letters)
    for _ in range(150):
        w = [rng.randrange(letters) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):  # plant a run
            a, p = rng.randrange(len(w) + 1), rng.randrange(1, 20)
            w[a:a] = [w[(a + i % p) % len(w)] if w else 0 for i in range(rng.randrange(2, 4) * p + rng.randrange(p))]
        assert periodic.find_runs(np.array(w, np.int64)) == brute.runs(w), w


def test_runs_of_long_structured_sequences():
    fib = ["a", "b"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(7)
    head = "".join(rng.choice("abcdefghij") for _ in range(90))
    for text in (fib[-1], "a" * 500, ("ab" * 3 + "a") * 40, head * 3 + "z" + head, "a" * 11 + "b" + "a" * 12, head + "xy" * 200 + head + "xyx" * 90):
        w = np.unique(list(text), return_inverse=True)[1]
        assert periodic.find_runs(w) == brute.runs(list(text))


def test_a_long_repeated_word_is_one_run():
    assert periodic.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def _altered(doc_id, text):
    w, h = brute.words(text), zlib.crc32(str(doc_id).encode())
    n = len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def _digest(doc_id, text):
    w = _altered(doc_id, text)
    found = brute.runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    most = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    return (len(found), *(most or (None,) * 3), most and 1000 * most[1] // most[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_digest(spark, small, edges):
    texts = {i: t for i, t in small.items() if len(t) < 4000}
    texts |= {20_000 + i: t for i, t in edges.items() if i != 10}
    texts |= {30_000: "one two three " * 9, 30_001: "a b a b a b a b a b a b", 30_002: "a b a b a b a b a b a", None: "x y " * 20}
    rows = [(i, t, "s") for i, t in texts.items()] * 2
    got = periodic.digest(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: _digest(i, t) for i, t in texts.items()}
    assert sum(1 for i in texts if i is not None and zlib.crc32(str(i).encode()) % 10 == 0) > 10
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_runs_and_collapse(spark):
    docs = documents(spark, [(1, "x " + "a b c " * 5 + "y", "s"), (2, None, "s"), (3, "no run here", "s")])
    assert [tuple(r) for r in periodic.runs(docs).collect()] == [(1, 1, 15, 3)]
    assert {r.doc_id: r.text for r in periodic.collapse(docs).collect()} == {1: "x a b c y", 2: "", 3: "no run here"}


# --- substring dedup -----------------------------------------------------------------------


def passages(small):
    """Documents with copies, passages in ever new surroundings, exact window lengths, and repeats inside a document."""
    rng, rows = random.Random(3), [(i, t, "s") for i, t in small.items()]
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "été", "中文", "zeta"]) + str(rng.randrange(400))
    shared = [word() for _ in range(75)]
    for i in range(40):
        a, b = rng.randrange(26), rng.randrange(40, 76)
        rows.append((50_000 + i, "\n".join([*(word() for _ in range(rng.randrange(60))), *shared[a:b], *(word() for _ in range(rng.randrange(60)))]), None))
    rows += [(60_000, " ".join(shared[:50]), "s"), (60_001, " \t".join(shared[:49]), "s"), (60_002, " ".join(shared + shared), "s"), (60_003, "w " * 900, "s"), (60_004, "w " * 700, "s"), (60_005, " ".join(shared), "s"), (60_005, " ".join(shared), "s"), (60_005, " ".join(shared[::-1]), "s"), (60_006, " ".join(shared[::-1]), "s"), (None, " ".join(shared), "s"), (None, None, None), (60_007, None, "s"), (60_008, "", "s"), (60_009, ("x" * 5000 + " ") * 60, "s"), (60_010, ("x" * 5000 + "\n") * 55, "s")]
    return rows


@pytest.mark.parametrize("large", [False, True])
def test_substrings_equal_brute_force(spark, small, monkeypatch, large):
    if large:  # every bucket of more than one string goes by windows
        monkeypatch.setattr(substrings, "BUCKET_STRINGS", 1)
    rows = passages(small)
    want = sorted(((d, *x) for (d, _, _), x in zip(rows, brute.without_passages([r[:2] for r in rows]))), key=str)
    assert sum(x[2] > 0 for x in want) > 60
    docs = documents(spark, rows)
    assert sorted(map(tuple, substrings.remove(docs).collect()), key=str) == want
    if not large:
        got = {(r.doc_id, r.kept_sha256) for r in substrings.digest(docs).collect()}
        assert got == {(d, sha(kept)) for d, _, _, kept in want}


def test_super_kmers_cover_each_window_once():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 49, 50, 51, 700, 3, 1200])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 1 << 63, bounds[-1]).astype(np.uint64)
    hashes[900:] = 5  # one word from there on
    first, count, mini, _ = substrings.super_kmers(hashes, bounds)
    seen = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count)])
    want = np.concatenate([np.arange(a, max(a, b - 49)) for a, b in zip(bounds[:-1], bounds[1:])])
    assert seen.tolist() == want.tolist() and count.max() <= substrings.CUT


def test_words_with_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    starts, ends, _ = substrings.T.spans(data, np.array([0, len(data)]), substrings.T.NOT_SPACE)
    monkeypatch.setattr(substrings.T, "span_hashes", lambda *a: np.zeros(4, np.uint64))
    names = substrings.exact_words(data, starts, ends)
    assert names[0] == names[2] and len(set(names.tolist())) == 3


# --- filter interaction audit ---------------------------------------------------------------


def test_audit_equals_brute_force(spark, small, edges):
    long = " ".join(f"w{i}" for i in range(210))
    rows = [(i, t, f"s{i % 3}") for i, t in small.items()] + [(20_000 + i, t, None) for i, t in edges.items()]
    rows += [(30_000, long, "s0"), (30_001, long, "s1"), (30_002, long.upper(), "s1"), (30_003, long + " #", "s0"), (None, long, "s0"), (30_001, long, "s1"), (30_004, long + " 𝒳é", ""), (30_005, "Aa " * 300, "new")]
    labels = [(i, int(i % 4 > 0), int(i % 7 == 0)) for i in list(small)[::2]] + [(30_001, 0, 1), (30_001, 1, None), (30_002, None, None), (None, 1, 1), (30_003, 1, 0), (30_005, 1, 1)]
    marks = spark.createDataFrame([(*x, "text") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(documents(spark, rows), marks).collect()}
    assert got == brute.audit(rows, labels)


# --- empty tables ----------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = documents(spark, [(1, "x", "s")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not periodic.digest(docs).collect() and not substrings.digest(docs).collect() and not audit.audit(docs, labels).collect()
    assert not substrings.remove(docs).collect() and not periodic.runs(docs).collect()
    one = audit.audit(documents(spark, [(1, "x", "s")]), labels).collect()
    assert len(one) == 600 and sum(r.removed for r in one) == 120
