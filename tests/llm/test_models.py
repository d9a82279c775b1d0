"""Models against plain recomputations, and the branches that only large inputs take."""

from __future__ import annotations

import bisect
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from brute import lower, words
from pyspark.sql import functions as F

from lumisieve.llm import langid, linkage, lmscore
from lumisieve.llm.scratch import Scratch


def interpolated(texts, train, deleted, order):
    """{doc_id: log10 probability} by counts of tuples, and expectation-maximisation on deleted documents, in plain Python."""
    tok = {d: [*words(lower(t)), None] for d, t in texts.items()}

    def events(d, n):
        """(context, gram) of length n - 1 and n at each token."""
        full = ["<s>"] * (n - 1) + tok[d]
        return [(tuple(full[i : i + n - 1]), tuple(full[i : i + n])) for i in range(len(tok[d]))]

    def counts(docs):
        gram, context = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for d in docs:
            for n in range(1, order + 1):
                for c, g in events(d, n):
                    gram[n][g] += 1
                    context[n][c] += 1
                # a context is as frequent as its own n-gram: the end of a text is one that nothing follows
                if n > 1:
                    last = (["<s>"] * n + tok[d])[-(n - 1) :]
                    context[n][tuple(last)] += 1
        return gram, context

    def parts(d, gram, context):
        total, kinds = sum(gram[1].values()), len(gram[1])
        out = []
        for i in range(len(tok[d])):
            p, c = [1 / (kinds + 1), gram[1][events_of[d][1][i][1]] / max(1, total)], 0
            for n in range(2, order + 1):
                c_, g_ = events_of[d][n][i]
                c = context[n][c_]
                p.append(gram[n][g_] / max(c, 1))
            out.append((bisect.bisect_left(lmscore.EDGES, c), p))
        return out

    events_of = {d: {n: events(d, n) for n in range(1, order + 1)} for d in texts}
    learned, rest = [d for d in texts if train[d]], [d for d in texts if train[d] and not deleted[d]]
    few = counts(rest)
    held = [x for d in texts if train[d] and deleted[d] for x in parts(d, *few)]
    size = order + 1
    weights = defaultdict(lambda: [1 / size] * size)
    for _ in range(lmscore.EM_STEPS):
        share = defaultdict(lambda: [1e-3] * size)
        for b, p in held:
            mix = [w * x for w, x in zip(weights[b], p)]
            share[b] = [s + m / sum(mix) for s, m in zip(share[b], mix)]
        new = {b: [x / sum(s) for x in s] for b, s in share.items()}
        moved = max((abs(x - y) for b in new for x, y in zip(new[b], weights[b])), default=0)
        weights.update(new)
        if moved < 1e-4:
            break
    every = counts(learned)
    return {d: sum(math.log10(sum(w * x for w, x in zip(weights[b], p))) for b, p in parts(d, *every)) for d in texts}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_is_deleted_interpolation(spark, table, small, order):
    texts = dict(list(small.items())[:60]) | {50_001: None, 50_002: "", 50_003: "quite unseen wording"}
    docs = table(texts)
    chunk = {r.doc_id: r.c for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(lmscore.DELETED)).alias("c")).collect()}
    train = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d in texts}
    want = interpolated(texts, train, {d: chunk[d] % lmscore.DELETED == 0 for d in texts}, order)
    got = {r.doc_id: r.score for r in lmscore.score(docs, langid.fold(10) != 0, order).collect()}
    assert any(train[d] and chunk[d] == 0 for d in texts)
    assert got == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_components_by_joins_and_in_one_task(spark, monkeypatch, limit):
    """A path, a hub, a ring, loops and repeated edges, and random ones; ids of both signs."""
    monkeypatch.setattr(linkage, "EDGES_IN_TASK", limit)
    rng = random.Random(5)
    names = [rng.getrandbits(63) - (1 << 62) for _ in range(400)]
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[100], names[k]) for k in range(101, 180)]
    edges += [(names[200 + i], names[200 + (i + 1) % 20]) for i in range(20)] + [(names[250], names[251])] * 3 + [(names[251], names[250])]
    edges += [(names[rng.randrange(260, 400)], names[rng.randrange(260, 400)]) for _ in range(90)]
    edges = [e for e in edges if e[0] != e[1]]
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v), near[v].add(u)
    want, left = {}, set(near)
    while left:
        group, front = set(), [next(iter(left))]
        while front:
            x = front.pop()
            if x not in group:
                group.add(x)
                front += near[x]
        want |= dict.fromkeys(group, min(group))
        left -= group
    rows = spark.createDataFrame(edges, "u long, v long")
    got = linkage.components(rows, Scratch(spark, "test"), len(edges)).collect()
    assert {r.node: r.comp for r in got} == want and len(got) == len(want)


def test_language_scores_do_not_depend_on_the_cache(spark, small, table, monkeypatch):
    """Words that are joined have the scores of words that are sent."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    model = langid.train(rows, Scratch(spark, "langid"))
    found = lambda: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(table(small), model, Scratch(spark, "langid")).collect()}
    want = found()
    for kept in (0, 50):
        monkeypatch.setattr(langid, "CACHE_WORDS", kept)
        assert found() == want


def test_large_buckets_lose_no_link(spark):
    """Pairs in one bucket that no pivot brings together are compared too."""
    n, empty = 120, "key long, node long"
    posts = spark.range(n).selectExpr("7L AS key", "id AS node").union(spark.range(n).selectExpr("id + 100 AS key", "id AS node"))

    def verify(nodes):
        return spark.range(n).selectExpr("id AS node", "20 AS size"), lambda pairs: pairs.where("u div 2 = v div 2")

    comp = linkage.gather(posts, lambda nodes, turn: spark.createDataFrame([], empty), verify, lambda a, b: a == b, Scratch(spark, "test"))
    assert sorted((r.node, r.comp) for r in comp.collect()) == [(k, k - k % 2) for k in range(n)]
