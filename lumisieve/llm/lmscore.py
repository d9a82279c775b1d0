"""Language-model scoring by deleted interpolation.

P(w | context) mixes the maximum-likelihood estimates of orders 1 to N and the uniform
one.  The weights depend on the bucket of the context's frequency, and are learned by
expectation-maximisation on deleted documents: the training documents of every
twentieth chunk, whose own counts are taken from the estimates while the weights are fitted.  Final
estimates use the counts of all training documents.

Counts grow with the corpus and are never broadcast.  Documents are dealt to chunks; each
chunk asks for the counts of its distinct n-grams in one block of sorted 64-bit hashes for
each counting task, which adds up the blocks of all chunks and answers each in the order
asked.  So an n-gram, however frequent, costs a chunk one entry, and rows that are
shuffled are blocks, not n-grams.  Orders above 2 are asked for one by one, and chunks are
scored in ROUNDS, so that the disk holds the answers and one order's or round's shuffle.

Tokens are words (white-space separated, A-Z lower-cased) and one end for each text;
contexts at a text's start are padded with a start mark that is never predicted.

Edge cases: null or empty texts are one end token; without training documents all counts
are 0 and the model is uniform; repeated documents count as often as they occur; a
null doc_id is in no fold: its row is scored, its held_out is null and its text is not
learned from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as T
from .scratch import Scratch, bounded_batches

ORDER = 3
#: Rounds of chunks in scoring; each reads the documents again and frees its shuffle.
ROUNDS = 4
#: The training documents of one chunk in so many are deleted for the weights; there are so many chunks at least.
DELETED = 20
#: Upper edges of the buckets of context counts; one more bucket is open.
EDGES = (0, 1, 2, 4, 8, 16, 64, 256, 4096)
EM_STEPS = 12
#: Documents' bytes in one chunk, about.
CHUNK_BYTES = 8 << 20
END = T.mix(np.array([0x5EED0E4D], T.U))[0]
BEGIN = T.mix(np.array([0x5EED0B39], T.U))[0]


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents, ends included, and counts before documents."""
    data = T.LOWER[data]
    starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
    words = T.span_hashes(data, starts, ends)
    docs = len(offs) - 1
    out = np.empty(len(words) + docs, T.U)
    out[np.arange(len(words)) + T.owners(bounds)] = words
    cut = bounds + np.arange(docs + 1)
    out[cut[1:] - 1] = END
    return out, cut


def grams(tok: np.ndarray, cut: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each token, for n = 1 to order."""
    first = np.arange(len(tok)) - cut[T.owners(cut)]
    out, run = [tok], tok
    for n in range(2, order + 1):
        back = np.full(len(tok), BEGIN, T.U)
        k = n - 1
        back[k:] = np.where(first[k:] >= k, tok[:-k], BEGIN)
        run = T.mix(run * T.U(0x9E3779B97F4A7C15) + back)
        out.append(run)
    return out


def context(tok: np.ndarray, cut: np.ndarray, n: int, gram: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-1 tokens before each token, as :func:`grams` has it (a start is the n-1-gram of start marks)."""
    k = n - 1
    start = np.array([BEGIN], T.U)
    for _ in range(2, k + 1):
        start = T.mix(start * T.U(0x9E3779B97F4A7C15) + BEGIN)
    out = np.empty(len(tok), T.U)
    out[1:] = gram[k - 1][:-1]
    out[cut[:-1]] = start[0]
    return out


def _load(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tokens(*T.buffers(table.column("text")))


def _keys(tok: np.ndarray, cut: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: the keys that occur, and the document of each."""
    gram = grams(tok, cut, order)
    own = T.owners(cut)
    out = []
    for n in range(1, order + 1):
        keys, doc = [gram[n - 1]], [own]
        if n < order:  # starts are contexts too, as often as there are documents
            start = context(tok, cut, n + 1, gram)[cut[:-1]]
            keys.append(start), doc.append(np.arange(len(cut) - 1))
        out.append((np.concatenate(keys), np.concatenate(doc)))
    return out


def _ask(order: int, parts: int, wanted: tuple[int, ...]):
    """Blocks of distinct keys of the wanted orders with the chunk's own training and deleted counts."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        tok, cut = _load(table)
        train = np.asarray(table.column("train")).astype(np.int64)
        deleted = np.asarray(table.column("deleted")).astype(np.int64)
        rows = {"part": [], "chunk": [], "n": [], "keys": [], "counts": []}
        for n, (key, doc) in enumerate(_keys(tok, cut, order), 1):
            if n not in wanted:
                continue
            keys, code = np.unique(key, return_inverse=True)
            t = np.bincount(code, train[doc], len(keys)).astype(np.int64)
            d = np.bincount(code, deleted[doc], len(keys)).astype(np.int64) if deleted.any() else np.zeros_like(t)
            edge = np.searchsorted(keys, np.array([(p << 64) // parts for p in range(1, parts)], T.U)) if parts > 1 else np.zeros(0, np.int64)
            edge = np.concatenate([[0], edge, [len(keys)]]).astype(np.int64)
            for p in range(parts):
                a, b = edge[p], edge[p + 1]
                if b > a:
                    rows["part"].append(p), rows["chunk"].append(chunk), rows["n"].append(n)
                    rows["keys"].append(_pack_keys(keys[a:b]))
                    rows["counts"].append(_pack(t[a:b], d[a:b]))
        return pa.table({"part": pa.array(rows["part"], pa.int32()), "chunk": pa.array(rows["chunk"], pa.int64()), "n": pa.array(rows["n"], pa.int32()), "keys": pa.array(rows["keys"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})

    return run


def _pack(*columns: np.ndarray) -> bytes:
    """Counts as compressed 32- or 64-bit integers; most are alike."""
    import zstandard

    kind = "<u8" if any(len(c) and c.max() >= 1 << 32 for c in columns) else "<u4"
    raw = b"".join(np.ascontiguousarray(c.astype(kind)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return kind[2:].encode() + zstandard.compress(raw, 1)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, whose upper bytes are mostly zero."""
    import zstandard

    steps = np.diff(keys, prepend=np.zeros(1, T.U)).astype("<u8")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack_keys(block: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(block), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=T.U)


def _unpack(block: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    size = int(block[:1])
    raw = np.frombuffer(zstandard.decompress(block[1:]), np.uint8).reshape(columns, size, -1)
    return [np.ascontiguousarray(x.T).view(f"<u{size}").ravel().astype(np.int64) for x in raw]


def _answer(table: pa.Table) -> pa.Table:
    """Total counts (training, deleted) of each block's keys, and one row of totals for order 1."""
    out = {"chunk": [], "n": [], "part": [], "keys": [], "counts": []}
    chunk, n, part = (table.column(x).to_pylist() for x in ("chunk", "n", "part"))
    for order in sorted(set(n)):
        at = [i for i, x in enumerate(n) if x == order]
        keys = [_unpack_keys(table.column("keys")[i].as_py()) for i in at]
        own = [_unpack(table.column("counts")[i].as_py(), 2) for i in at]
        every, code = np.unique(np.concatenate(keys), return_inverse=True)
        t = np.bincount(code, np.concatenate([x[0] for x in own]), len(every)).astype(np.int64)
        d = np.bincount(code, np.concatenate([x[1] for x in own]), len(every)).astype(np.int64)
        begin = 0
        for i, k in zip(at, keys):
            c = code[begin : begin + len(k)]
            begin += len(k)
            out["chunk"].append(chunk[i]), out["n"].append(order), out["part"].append(part[i]), out["keys"].append(None), out["counts"].append(_pack(t[c], d[c]))
        if order == 1:
            live = every != BEGIN
            out["chunk"].append(-1), out["n"].append(1), out["part"].append(part[0]), out["keys"].append(None)
            out["counts"].append(np.array([t[live].sum(), (t[live] > 0).sum(), d[live].sum(), ((t - d)[live] > 0).sum()], "<i8").tobytes())
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "part": pa.array(out["part"], pa.int32()), "counts": pa.array(out["counts"], pa.binary())})


def bucket(context_count: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(EDGES), context_count, "left")


def _estimates(table: pa.Table, answers: pa.Table, order: int, minus: bool):
    """Tokens' maximum-likelihood estimates (a column for each order), buckets, counts of order 1, and documents' bounds.

    minus: deleted counts are taken off.
    """
    tok, cut = _load(table)
    part, kind = np.asarray(answers.column("part")), np.asarray(answers.column("n"))
    counts = []  # of each n: at every token, and at the start of every document
    for n, (key, _) in enumerate(_keys(tok, cut, order), 1):
        _, code = np.unique(key, return_inverse=True)
        rows = [i for i in np.flatnonzero(kind == n)[np.argsort(part[kind == n], kind="stable")]]
        both = [_unpack(answers.column("counts")[int(i)].as_py(), 2) for i in rows]
        t, d = (np.concatenate([x[j] for x in both]) for j in range(2))
        counts.append((t - d if minus else t)[code])
    unigram = counts[0][: len(tok)]
    ratios, where = [], None
    for n in range(2, order + 1):
        c = np.empty(len(tok), np.int64)  # of the n-1 tokens before
        c[1:] = counts[n - 2][: len(tok) - 1]
        c[cut[:-1]] = counts[n - 2][len(tok) :]
        ratios.append(counts[n - 1][: len(tok)] / np.maximum(c, 1))
        where = c
    return tok, cut, unigram, ratios, bucket(where if where is not None else np.zeros(len(tok), np.int64))


def _mixture(unigram, ratios, total: int, kinds: int) -> np.ndarray:
    """Columns: uniform over known words and one unknown, order 1, order 2, ..."""
    return np.column_stack([np.full(len(unigram), 1.0 / (kinds + 1)), unigram / max(1, total), *ratios])


def _held(order: int, total: int, kinds: int):
    """Estimates at tokens of deleted documents, alike ones merged."""
    names = [f"p{k}" for k in range(order + 1)]

    def run(_key, table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"b": pa.array([], pa.int32()), **{x: pa.array([], pa.float64()) for x in names}, "w": pa.array([], pa.int64())})
        gone = np.asarray(table.column("deleted")).astype(bool) if len(table) else np.zeros(0, bool)
        if not gone.any():
            return empty
        _, cut, unigram, ratios, b = _estimates(table, answers, order, True)
        take = gone[T.owners(cut)]
        rows = np.column_stack([b, _mixture(unigram, ratios, total, kinds)])[take]
        rows, w = np.unique(rows, axis=0, return_counts=True)
        return pa.table({"b": pa.array(rows[:, 0].astype(np.int32)), **{x: pa.array(rows[:, k + 1]) for k, x in enumerate(names)}, "w": pa.array(w.astype(np.int64))})

    return run


def expectation_maximisation(held: DataFrame, order: int, steps: int = EM_STEPS) -> np.ndarray:
    """Weights by bucket (rows) and component (uniform, order 1, ...); each step is one aggregation."""
    size = order + 1
    weights = np.full((len(EDGES) + 1, size), 1.0 / size)
    for _ in range(steps):
        lam = [F.element_at(F.array(*(F.lit(float(x)) for x in weights[:, k])), F.col("b") + 1) for k in range(size)]
        mix = [lam[k] * F.col(f"p{k}") for k in range(size)]
        whole = sum(mix[1:], mix[0])
        share = held.select("b", "w", whole.alias("whole"), *(m.alias(f"m{k}") for k, m in enumerate(mix)))
        got = share.groupBy("b").agg(*(F.sum(F.col("w") * F.col(f"m{k}") / F.col("whole")).alias(f"s{k}") for k in range(size))).collect()
        new = weights.copy()
        for r in got:
            s = np.array([r[f"s{k}"] for k in range(size)]) + 1e-3  # no weight is ever 0
            new[r.b] = s / s.sum()
        done = np.abs(new - weights).max() < 1e-4
        weights = new
        if done:
            break
    return weights


def _score(order: int, total: int, kinds: int, weights: np.ndarray):
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(_key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({x: pa.array([], pa.float64() if "score" in x else pa.int64()) for x in names})
        _, cut, unigram, ratios, b = _estimates(table, answers, order, False)
        base = np.log10((unigram + 0.1) / (total + 0.1 * (kinds + 1)))
        model = np.log10((weights[b] * _mixture(unigram, ratios, total, kinds)).sum(axis=1))
        add = lambda x: np.add.reduceat(x, cut[:-1])
        return pa.table({"doc_id": table.column("doc_id"), "n_tokens": pa.array(np.diff(cut)), "n_known": pa.array(add((unigram > 0).astype(np.int64))), "base_score": pa.array(add(base)), "score": pa.array(add(model))})

    return run


def score(docs: DataFrame, train: F.Column, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text); ``train`` marks training rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lmscore")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(DELETED, -(-size // CHUNK_BYTES))
    parts = max(1, -(-size // CHUNK_BYTES) // 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("long"))
    gone = F.pmod(F.col("chunk"), F.lit(DELETED)) == 0
    rows = rows.withColumn("deleted", F.col("train") & gone)
    answers = None
    for wanted in [(1, 2), *((n,) for n in range(3, order + 1))]:
        asked = rows.groupBy("chunk").applyInArrow(_ask(order, parts, wanted), "part int, chunk long, n int, keys binary, counts binary")
        some = scratch.table(asked.groupBy("part").applyInArrow(_answer, "chunk long, n int, part int, counts binary"))
        answers = some if answers is None else answers.unionByName(some)
        scratch.settle()  # the next order's shuffle would stand beside this one's
    total = kinds = held_total = held_kinds = 0
    for r in answers.where("chunk < 0").select("counts").collect():
        a = np.frombuffer(bytes(r.counts), "<i8").tolist()
        total, kinds, held_total, held_kinds = total + a[0], kinds + a[1], held_total + a[2], held_kinds + a[3]
    mine = answers.where("chunk >= 0")
    some = rows.where(gone).groupBy("chunk").cogroup(mine.where(gone).groupBy("chunk"))
    held = scratch.table(some.applyInArrow(_held(order, total - held_total, held_kinds), "b int, " + ", ".join(f"p{k} double" for k in range(order + 1)) + ", w long"))
    weights = expectation_maximisation(held, order)
    out = None
    for r in range(ROUNDS):
        turn = F.pmod(F.col("chunk"), F.lit(ROUNDS)) == r
        both = rows.where(turn).groupBy("chunk").cogroup(mine.where(turn).groupBy("chunk"))
        part = scratch.table(both.applyInArrow(_score(order, total, kinds, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double"))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
