"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are character n-grams of words (boundary marks included), hashed to FEATURES
cells.  A document's value of a cell is the share of its words that hold one of the cell's
n-grams, so long and short texts are alike.  Log-count ratios are taken over all labelled
training rows (one aggregation of bounded size); logistic regression on the scaled features
is then fitted on a bounded sample of labelled rows: at most SAMPLE_ROWS of each class, those
with the least hash of doc_id and text.  Cells of a word are found once and kept from batch
to batch; only ids that have a label send their texts to the join with the labels.

Edge cases: null or empty texts have no features and score by the intercept alone; without
training rows of both classes all texts score 0.5 (predicted 1); rows of labels without a
document are ignored; a document with several labels counts for each; a null doc_id is in
no fold and has no label: its row is scored, and its held_out is null; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as T
from .idfilter import bitmap, maybe
from .langid import fold, word_grams
from .scratch import Scratch, bounded_batches

FEATURES = 1 << 18
ORDERS = (3, 4, 5)
SAMPLE_ROWS = 2_500
#: A text's value of a cell is log(1 + SCALE * share).
SCALE = 1000.0
PENALTY = 1e-2
STEPS = 90
#: Cells of fewer labelled documents have no weight.
LEAST_DOCS = 5
#: Words whose cells a task keeps (about 15 cells of 8 bytes each), and bytes of text taken at once.
KEPT_WORDS, PIECE = 200_000, 1 << 20
WORDLIKE = T.byte_class([*range(48, 58), *range(97, 123), *range(128, 256)])


class Cells:
    """Cells of words, kept between batches; wanted: cells that are kept at all."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = wanted
        self.clear()

    def clear(self) -> None:
        self.words, self.place, self.at, self.cell = np.zeros(0, T.U), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, T.U)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Adds distinct words."""
        new = np.flatnonzero(~T.lookup(self.words, hashes)[1])
        if not len(new):
            return
        if len(self.words) + len(new) > KEPT_WORDS:
            self.clear()
            new = np.arange(len(hashes))
        texts = T.strings(data, starts[new], ends[new])
        own, cell = [], []
        for n in ORDERS:
            o, h = word_grams(texts, n)
            own.append(o), cell.append(h & T.U(FEATURES - 1))
        own, cell = np.concatenate(own), np.concatenate(cell)
        if self.wanted is not None:
            keep = self.wanted[cell]
            own, cell = own[keep], cell[keep]
        pair = np.sort((own.astype(T.U) << T.U(20)) | cell)
        pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
        edge = np.searchsorted(pair >> T.U(20), np.arange(1, len(new) + 1).astype(T.U))
        place = np.arange(len(new)) + len(self.words)
        words = np.concatenate([self.words, hashes[new]])
        order = np.argsort(words)
        self.words, self.place = words[order], np.concatenate([self.place, place])[order]
        self.at = np.concatenate([self.at, self.at[-1] + edge])
        self.cell = np.concatenate([self.cell, pair & T.U(FEATURES - 1)])

    def matrix(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents' values as (document, cell, value), by document and cell; fewer than 2**14 documents."""
        data = T.LOWER[data]
        starts, ends, bounds = T.spans(data, offs, WORDLIKE)
        hashes = T.span_hashes(data, starts, ends)
        every, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        self.learn(data, starts[first], ends[first], every)
        place = self.place[T.lookup(self.words, every)[0]] if len(every) else np.zeros(0, np.int64)
        # occurrences of each word in each document, then of its cells: sorts of whole numbers only
        mine = np.sort((T.owners(bounds).astype(T.U) << T.U(40)) | code.astype(T.U))
        head = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(mine)))
        doc, word = (mine[head] >> T.U(40)), place[(mine[head] & T.U((1 << 40) - 1)).astype(np.int64)]
        many = self.at[word + 1] - self.at[word]
        index = np.arange(many.sum()) + np.repeat(self.at[word] - (np.cumsum(many) - many), many)
        key = np.sort((np.repeat((doc << T.U(50)) | np.minimum(times, (1 << 32) - 1).astype(T.U), many)) | (self.cell[index] << T.U(32)))
        cell = key >> T.U(32)
        head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat((key & T.U((1 << 32) - 1)).astype(np.int64), head) if len(key) else np.zeros(0)
        doc = (cell[head] >> T.U(18)).astype(np.int64)
        return doc, (cell[head] & T.U(FEATURES - 1)).astype(np.int64), np.log1p(SCALE * total / np.maximum(1, np.diff(bounds))[doc])


def _class_counts(batches):
    total, cells = np.zeros((2, FEATURES)), Cells()
    for batch in batches:
        toxic = np.asarray(batch.column(1))
        for lo, hi, data, offs in T.pieces(batch.column(0), PIECE):
            doc, cell, _ = cells.matrix(data, offs)
            for y in (0, 1):
                total[y] += np.bincount(cell[toxic[lo:hi][doc] == y], minlength=FEATURES)
    slices = 32
    parts = np.split(total.astype("<i8"), slices, axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])


def _sum_slices(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def log_count_ratios(labelled: DataFrame) -> np.ndarray:
    """Of each cell, from documents of each class that have it; over all labelled rows (text, toxic)."""
    rows = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(_class_counts, "slice int, counts binary").groupBy("slice").applyInArrow(_sum_slices, "slice int, counts binary").collect()
    if not rows:
        return np.zeros(FEATURES)
    counts = np.concatenate([np.frombuffer(bytes(r.counts), "<i8").reshape(2, -1) for r in sorted(rows, key=lambda r: r.slice)], axis=1) + 1.0
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.where(counts.sum(axis=0) >= LEAST_DOCS + 2, np.log(share[1] / share[0]), 0.0)


def _sample_features(ratios: np.ndarray):
    def run(batches):
        cells = Cells(ratios != 0)
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(0), PIECE):
                doc, cell, value = cells.matrix(data, offs)
                cell, value = cell.astype("<i4"), value.astype("<f4")
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                blobs = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])] for x in (cell, value)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), *(pa.array(x, pa.binary()) for x in blobs)], ["toxic", "cells", "values"])

    return run


def descend(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression with classes of equal weight, by Nesterov's accelerated descent."""
    weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    cut = np.searchsorted(row, np.arange(len(y) + 1))  # rows ascend

    def by_row(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1)
        np.cumsum(x, out=total[1:])
        return total[cut[1:]] - total[cut[:-1]]

    v, top = np.full(size, size**-0.5), 1.0
    for _ in range(12):  # the largest eigenvalue bounds the step
        u = by_row(v[col] * value) * weight
        v = np.bincount(col, u[row] * value, size)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1 / (0.3 * top + penalty + 0.25)
    w, b, pw, pb = np.zeros(size), 0.0, np.zeros(size), 0.0
    for k in range(steps):
        ahead = k / (k + 3)
        yw, yb = w + ahead * (w - pw), b + ahead * (b - pb)
        pw, pb = w, b
        z = by_row(yw[col] * value) + yb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        w = yw - rate * (np.bincount(col, g[row] * value, size) + penalty * yw)
        b = yb - rate * float(g.sum())
    return w, b


def _fit(ratios: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        y = np.asarray(table.column("toxic")).astype(float)
        cells = [np.frombuffer(x, "<i4") for x in table.column("cells").to_pylist()]
        row = np.repeat(np.arange(len(y), dtype=np.int32), [len(c) for c in cells])
        used, col = np.unique(np.concatenate(cells), return_inverse=True)
        value = np.concatenate([np.frombuffer(x, "<f4") for x in table.column("values").to_pylist()]) * ratios.astype(np.float32)[used][col]
        w, b = descend(row, col.astype(np.int32), value, y, len(used))
        return pa.table({"cell": pa.array(used.astype(np.int32)), "w": pa.array(w * ratios[used]), "b": pa.array(np.full(len(used), b))})

    return run


def _with_ids(have: bytes):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe(have, np.asarray(batch.column(0)))))

    return run


def _least(labelled: DataFrame, toxic: int, rows: int) -> DataFrame:
    """The ``rows`` rows of a class with the least hash; rows of one hash are alike, so any of them will do."""
    mark = F.xxhash64("doc_id", "text")
    mine = labelled.where(F.col("toxic") == toxic).select("text", "toxic", mark.alias("h"))
    cut = mine.select("h").orderBy("h").limit(rows).agg(F.max("h").alias("h")).first().h
    return mine.where(F.col("h") <= F.lit(cut)).limit(rows).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weight of each cell and the intercept.  docs: doc_id, text; labels: doc_id, toxic (0 or 1)."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    marks, n_marks = scratch.counted(marks)
    have = bitmap(marks.select("_id"), n_marks)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(_with_ids(have), "doc_id long, text string")
    # always the same plan: texts of labelled ids are dealt by id, at every size
    labelled = scratch.table(some.join(marks.hint("merge"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"))
    ratios_of = {r.toxic for r in labelled.select("toxic").distinct().collect()}
    if len(ratios_of) < 2:
        return np.zeros(FEATURES), 0.0
    ratios = log_count_ratios(labelled)
    sample = _least(labelled, 0, sample_rows).union(_least(labelled, 1, sample_rows))
    rows = sample.select("text", "toxic").mapInArrow(_sample_features(ratios), "toxic int, cells binary, values binary")
    fit = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fit(ratios), "cell int, w double, b double").toArrow()
    weights = np.zeros(FEATURES)
    weights[fit.column("cell").to_numpy()] = fit.column("w").to_numpy()
    return weights, float(fit.column("b")[0].as_py()) if len(fit) else 0.0


def _score(shared):
    def run(batches):
        weights, b = shared.value
        cells = Cells(weights != 0)
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1), PIECE):
                doc, cell, value = cells.matrix(data, offs)
                z = np.bincount(doc, value * weights[cell], hi - lo) + b
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return run


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels of folds 1 to 4 of 5."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "toxicity")
    learn = labels.where(F.coalesce(fold(5) != 0, F.lit(False)))
    shared = spark.sparkContext.broadcast(train(docs, learn, scratch))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), "doc_id long, score double")
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
