"""Language identification by word-first backoff.

Model: for each language, log frequencies of words (lower-cased runs of letters), and of
character n-grams of words (with a boundary mark at both ends), n = 5 to 1.  All training
documents are counted, and every count stays: the tables are written, never collected.

A known word scores by its log frequency in each language.  An unseen word backs off to
its 5-grams; if none of them is known to its 4-grams, and so on.  A document's score is
the posterior of the best language, from mean log scores of its words.

The distinct words of all documents are scored once, by joins with the tables (words that
no table knows by joins of their n-grams).  Scores of the most frequent words, at most
CACHE_WORDS of them, are sent to all tasks; other words are asked for by joins, once for each
batch of documents, and answers meet again by batch.  So results never depend on the cache.

Edge cases: null or empty texts and texts without a letter are ``und`` with score 0;
letters that no table knows leave all languages equal, and the first in order is taken;
ties go to the first language in alphabetical order; training rows with null lang are
left out; with no training rows every text is ``und``; a null doc_id is in no fold: its row is
judged, its held_out is null and its text is not learned from; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textvec as T
from .scratch import Scratch, bounded_batches

ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
#: Words that count as independent evidence in a document's posterior.
EVIDENCE = 20
#: Words whose scores every task has (8 bytes, and 4 for each language); all others are joined.
CACHE_WORDS = 200_000
UND = "und"
#: ASCII letters and all non-ASCII bytes; only words with a letter in them count.
WORDLIKE = T.byte_class([*range(97, 123), *range(128, 256)])


def _words(data: np.ndarray, offs: np.ndarray):
    data = T.LOWER[data]
    starts, ends, bounds = T.spans(data, offs, WORDLIKE)
    return data, starts, ends, bounds, T.span_hashes(data, starts, ends)


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def _count_words(batches):
    for batch in batches:
        tags = batch.column(1).to_pylist()
        for lo, hi, data, offs in T.pieces(batch.column(0)):
            names, code = np.unique(np.array(tags[lo:hi], object).astype(str), return_inverse=True)
            data, starts, ends, bounds, hashes = _words(data, offs)
            lang = code[T.owners(bounds)]
            order = T.order_by_owner(lang, hashes)
            h, l = hashes[order], lang[order]
            head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (l[1:] != l[:-1]))) if len(h) else np.zeros(0, np.int64)
            first = order[head]
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(l[head])), T.strings(data, starts[first], ends[first]).cast(pa.string()), pa.array(np.diff(np.append(head, len(h))))], ["lang", "word", "n"])


def word_grams(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the n-grams of words with a mark at both ends."""
    mark = [pa.scalar(x, pa.large_string()) for x in "<>"]
    marked = pa.compute.binary_join_element_wise(mark[0], words.cast(pa.large_string()), mark[1], pa.scalar("", pa.large_string()))
    points, offs = T.code_points(marked)
    return T.char_ngrams(points, offs, n)


def _count_grams(batches):
    """Table rows (level, lang, key, n): words at level 0, n-grams at level n."""
    for batch in batches:
        names = batch.column(0).unique().to_pylist()
        lang = batch.column(0)
        code = np.asarray(pa.compute.index_in(lang, pa.array(names, lang.type))).astype(np.int64)
        words, n = batch.column(1).cast(pa.large_string()), np.asarray(batch.column(2))
        data, offs = T.buffers(words)
        out = [(0, code, T.span_hashes(data, offs[:-1], offs[1:]), n)]
        for k in ORDERS:
            own, key = word_grams(words, k)
            out.append((k, code[own], key, n[own]))
        for level, c, key, count in out:
            order = T.order_by_owner(c, key)
            c, key, count = c[order], key[order], count[order]
            if not len(key):
                continue
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (c[1:] != c[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), level, np.int32)), pa.array(names, pa.string()).take(pa.array(c[head])), pa.array(key[head].view(np.int64)), pa.array(np.add.reduceat(count, head))], ["level", "lang", "key", "n"])


class Model:
    """Log frequencies: for each level, a table (key, logs) with one value for each language."""

    def __init__(self, langs: list[str], tables: dict[int, DataFrame]):
        self.langs, self.tables = langs, tables


def train(docs: DataFrame, scratch: Scratch) -> Model:
    """A model of docs (text, lang); counts cover all rows."""
    counted = docs.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_count_words, "lang string, word string, n long")
    words = scratch.table(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    grams = scratch.table(words.mapInArrow(_count_grams, "level int, lang string, key long, n long").groupBy("level", "lang", "key").agg(F.sum("n").alias("n")))
    totals = grams.groupBy("level", "lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    langs = sorted({r.lang for r in totals})
    tables = {}
    for level in (0, *ORDERS) if langs else ():
        total = {r.lang: r.n for r in totals if r.level == level}
        kinds = max(1, sum(r.kinds for r in totals if r.level == level))
        logs = [F.log((F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) + SMOOTH) / (total.get(x, 0) + SMOOTH * kinds)).cast("float") for x in langs]
        tables[level] = scratch.table(grams.where(F.col("level") == level).groupBy("key").agg(F.array(*logs).alias("logs")))
    return Model(langs, tables)


def _hash_words(batches):
    for batch in batches:
        data, offs = T.buffers(batch.column(0))
        key = T.span_hashes(data, offs[:-1], offs[1:])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["key", "word", "n"])


def _ask(shared):
    """(batch, key, docs, ids): words of a batch that are not in the cache, with their documents and counts; and one row
    without a key, of the documents: whether they have a letter, how many words, and the sums of cached scores."""
    names = ["batch", "key", "docs", "ids"]

    def run(batches):
        known, logs = shared.value
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                data, starts, ends, bounds, hashes = _words(data, offs)
                rows = hi - lo
                every, code = np.unique(hashes, return_inverse=True)
                mine = np.sort((T.owners(bounds).astype(T.U) << T.U(40)) | code.astype(T.U))
                head = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, np.int64)
                n = np.diff(np.append(head, len(mine)))
                doc, word = (mine[head] >> T.U(40)).astype(np.int64), (mine[head] & T.U((1 << 40) - 1)).astype(np.int64)
                place, found = T.lookup(known, every)
                have = found[word]
                at = place[word[have]]
                sums = np.column_stack([np.bincount(doc[have], n[have] * logs[at, k], rows) for k in range(logs.shape[1])]) if logs.shape[1] else np.zeros((rows, 0))
                letters = np.zeros(rows, np.int8)
                for i in np.flatnonzero(np.diff(bounds) > 0).tolist():
                    # a run of non-ASCII bytes need not hold a letter
                    ascii_letter = bool((data[starts[bounds[i] : bounds[i + 1]]] < 128).any())
                    letters[i] = ascii_letter or has_letter(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
                name = uuid.uuid4().hex
                rest = np.flatnonzero(~have)
                rest = rest[np.argsort(word[rest], kind="stable")]
                pairs = np.column_stack([doc[rest], n[rest]]).astype("<i4").tobytes()
                own = word[rest]
                head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                edge = np.append(head, len(own)) * 8
                docs = [pairs[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(head), pa.string()), pa.array(every[own[head]].view(np.int64)), pa.array(docs, pa.binary()), pa.nulls(len(head), pa.list_(pa.int64()))], names)
                whole = letters.tobytes() + np.diff(bounds).astype("<i8").tobytes() + sums.astype("<f8").tobytes()
                ids = batch.column(0).slice(lo, rows).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.array([whole], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names)

    return run


def _open_grams(k: int):
    def run(batches):
        for batch in batches:
            own, key = word_grams(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(key.view(np.int64))], ["word_key", "key"])

    return run


def word_scores(words: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(key, logs) for distinct words (key, word); words of which nothing is known are left out."""
    known = words.join(model.tables[0], "key", "left")
    known = scratch.table(known)
    out, left = known.where("logs is not null").select("key", "logs"), known.where("logs is null").select("key", "word")
    for k in ORDERS:
        each = left.mapInArrow(_open_grams(k), "word_key long, key long").join(model.tables[k], "key")
        mean = F.array(*(F.avg(F.col("logs")[i]).cast("float") for i in range(len(model.langs))))
        found = each.groupBy(F.col("word_key").alias("key")).agg(mean.alias("logs"))
        both = scratch.table(left.join(found, "key", "left"))
        out, left = out.union(both.where("logs is not null").select("key", "logs")), both.where("logs is null").select("key", "word")
    return out


def _judge(langs: list[str]):
    def run(table: pa.Table) -> pa.Table:
        key, docs, logs = table.column("key"), table.column("docs").to_pylist(), table.column("logs").to_pylist()
        meta = int(np.flatnonzero(np.asarray(key.is_null()))[0])
        ids, whole = table.column("ids")[meta].as_py(), docs[meta]
        letters = np.frombuffer(whole, np.int8, len(ids))
        n = np.frombuffer(whole, "<i8", len(ids), len(ids))
        total = np.frombuffer(whole, "<f8", offset=9 * len(ids)).reshape(len(ids), len(langs)).copy()
        rows = sorted((i for i in range(len(docs)) if i != meta), key=key.to_pylist().__getitem__)  # sums in one order always
        if rows and langs:
            size = np.array([len(docs[i]) // 8 for i in rows])
            pairs = np.frombuffer(b"".join(docs[i] for i in rows), "<i4").reshape(-1, 2).astype(np.int64)
            scores = np.array([logs[i] if logs[i] is not None else [0.0] * len(langs) for i in rows])
            np.add.at(total, pairs[:, 0], np.repeat(scores, size, axis=0) * pairs[:, 1:])
        pred, score = [UND] * len(ids), np.zeros(len(ids))
        if langs:
            least = np.maximum(1, n)[:, None]
            mean = total / least * np.minimum(least, EVIDENCE)
            best = mean.argmax(axis=1)
            post = np.exp(mean - mean.max(axis=1, keepdims=True))
            post = post.max(axis=1) / post.sum(axis=1)
            for i in np.flatnonzero(letters).tolist():
                pred[i], score[i] = langs[best[i]], post[i]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    return run


def _cache(words: DataFrame, scores: DataFrame, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and scores of the most frequent words: those above the least count that at most CACHE_WORDS reach."""
    often = words.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()
    total, least = 0, 64
    for r in sorted(often, key=lambda r: -r.b):
        if total + r["count"] > CACHE_WORDS:
            break
        total, least = total + r["count"], r.b
    hot = words.where(F.col("n") >= F.lit(2.0) ** least).select("key")
    keys = np.sort(np.array([r.key for r in hot.collect()], np.int64).view(T.U))
    logs = np.zeros((len(keys), langs), np.float32)
    found = scores.join(F.broadcast(hot), "key").toArrow() if langs and len(keys) else None
    if found is not None and found.num_rows:
        at = np.searchsorted(keys, found.column("key").to_numpy().view(T.U))
        logs[at] = np.array(found.column("logs").to_pylist(), np.float32)
    return keys, logs


def predict(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """doc_id, lang_pred, score for docs (doc_id, text)."""
    spark = docs.sparkSession
    if model.langs:
        counted = docs.where("text is not null").select("text", F.lit("").alias("lang")).mapInArrow(_count_words, "lang string, word string, n long")
        words = scratch.table(counted.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_hash_words, "key long, word string, n long"))
        scores = word_scores(words.select("key", "word"), model, scratch)
        shared = spark.sparkContext.broadcast(_cache(words, scores, len(model.langs)))
    else:
        scores = spark.createDataFrame([], "key long, logs array<float>")
        shared = spark.sparkContext.broadcast((np.zeros(0, T.U), np.zeros((0, 0), np.float32)))
    asked = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ask(shared), "batch string, key long, docs binary, ids array<long>"))
    both = asked.join(scores, "key", "left")
    return both.groupBy("batch").applyInArrow(_judge(model.langs), "doc_id long, lang_pred string, score double")


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents of folds 0, 1 and 3 of 4."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "langid")
    model = train(docs.where(F.coalesce(fold(4) != 2, F.lit(False))), scratch)
    return predict(docs, model, scratch).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


#: Documents whose best language has less than this posterior go from the pipeline.
LEAST_SCORE = 0.5


def keep_known(docs: DataFrame) -> DataFrame:
    """docs whose text has a language: neither ``und`` nor below LEAST_SCORE."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "langid")
    model = train(docs.where(F.coalesce(fold(4) != 2, F.lit(False))), scratch)
    # a prediction depends on the text alone
    mark = F.xxhash64("text")
    found = predict(docs.select(mark.alias("doc_id"), "text"), model, scratch)
    name = f"mark_{uuid.uuid4().hex}"  # no column of the input has this name
    good = found.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE)).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(scratch.table(good), mark == F.col(name), "left_semi")
