"""Benchmark decontamination by an FM-index of each training shard.

Every shard of the corpus (a run of documents of bounded size, inside one task) is
indexed as a sequence of words: suffix array, Burrows-Wheeler transform, wavelet
matrix with rank directories, and suffix positions sampled every 16 words.  The test
phrases are then searched backwards, all at once; occurrences are located by walking
to sampled positions, and merged into spans of words to remove.

Test phrases are the stated query set: every window of ten consecutive words of an
item (a shorter item is one window).  They are sent to executors in blocks of bounded
size; each block is searched against all documents.

Edge cases: null or empty texts have no words and no hits; items without words have no
windows; items that share a window all count, and repeated item_ids count once (there are no other ties); repeated documents each get a row; a
document larger than a shard is indexed in overlapping segments, so no window is lost;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as ST

from . import textvec as T
from .scratch import Scratch, bounded_batches

WINDOW = 10
#: Bytes of item texts in one block of phrases.
BLOCK_BYTES = 16 << 20
#: Words of one shard's index.
SHARD_WORDS = 1 << 20
SHARD_BYTES = 4 << 20
SAMPLE = 16


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Prefix doubling, from three packed symbols on; only suffixes that are still tied are sorted again.

    text: ends in a symbol that occurs once.
    """
    n, bits = len(text), max(1, int(symbols).bit_length())
    first = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for j in range(first):
        key <<= bits
        key[: n - j] |= text[j:]
    order = np.argsort(key, kind="stable")
    tied = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = tied[1:] != tied[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    open_at = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
    step = first
    while len(open_at):
        part = order[open_at]
        key = (rank[part] << 32) | rank[np.minimum(part + step, n - 1)]
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[open_at] = part
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[part] = open_at[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        open_at = open_at[~fresh | np.append(~fresh[1:], False)]
        step *= 2
    return order


class FMIndex:
    """An FM-index of documents of word hashes."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        docs = len(bounds) - 1
        self.alphabet, code = np.unique(words, return_inverse=True)
        self.base = docs
        size = len(words) + docs
        text = np.empty(size, np.int64)
        text[np.arange(len(words)) + T.owners(bounds)] = code + docs
        self.ends = bounds[1:] + np.arange(docs)  # each document ends in a symbol of its own
        text[self.ends] = np.arange(docs)
        order = suffix_array(text, docs + len(self.alphabet))
        last = text[order - 1]
        marked = order % SAMPLE == 0
        self.marked, self.mark_rank, self.sampled = marked, np.cumsum(marked) - 1, order[marked]
        self.less = np.zeros(docs + len(self.alphabet) + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=docs + len(self.alphabet)), out=self.less[1:])
        self.levels = []
        for bit in range(max(1, int(docs + len(self.alphabet)).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1
            rank = np.zeros(size + 1, np.int32)
            np.cumsum(ones, out=rank[1:])
            self.levels.append((bit, rank, size - int(rank[-1])))
            up = ones.astype(bool)
            last = np.concatenate([last[~up], last[up]])
        self.size = size

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs in the transform before each place."""
        at, start = list(places), np.zeros(len(symbol), np.int64)
        for bit, rank, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            move = lambda i: np.where(one, zeros + rank[i], i - rank[i])  # noqa: B023, E731
            at, start = [move(i) for i in at], move(start)
        return [i - start for i in at]

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one word earlier."""
        start, symbol = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for bit, rank, zeros in self.levels:
            below = rank[row]
            one = rank[row + 1] > below
            symbol |= one.astype(np.int64) << bit
            row = np.where(one, zeros + below, row - below)
            start = np.where(one, zeros + rank[start], start - rank[start])
        return self.less[symbol] + row - start

    def search(self, hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases hashes[start : start + length]: (phrase, first row, row after the last) of those found."""
        code, known = T.lookup(self.alphabet, hashes)
        bad = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(~known, out=bad[1:])
        live = np.flatnonzero(bad[start + length] == bad[start])
        lo, hi, done = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64), []
        for j in range(int(length.max(initial=0))):
            over = length[live] == j
            if over.any():
                done.append((live[over], lo[over], hi[over]))
                live, lo, hi = live[~over], lo[~over], hi[~over]
            symbol = code[start[live] + length[live] - 1 - j] + self.base
            a, b = self.rank(symbol, lo, hi)
            lo, hi = self.less[symbol] + a, self.less[symbol] + b
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
        done.append((live, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into lo, index of the word) of all occurrences."""
        many = hi - lo
        which = np.repeat(np.arange(len(lo)), many)
        row = np.arange(len(which)) + np.repeat(lo - (np.cumsum(many) - many), many)
        place, open_at, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(open_at):
            here = self.marked[row]
            place[open_at[here]] = self.sampled[self.mark_rank[row[here]]] + steps
            open_at, row, steps = open_at[~here], row[~here], steps + 1
            row = self.step(row)
        return which, place - np.searchsorted(self.ends, place)


@dataclass
class Phrases:
    """Windows of test items: hashes of words, start and length of each distinct window, and its items."""

    hashes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item_at: np.ndarray
    items: list


def phrases(ids: list, texts: list[str | None], window: int = WINDOW) -> Phrases:
    data, offs = T.buffers(pa.array(texts, pa.large_string()))
    data = T.LOWER[data]
    s, e, bounds = T.spans(data, offs, T.ALNUM)
    hashes = T.span_hashes(data, s, e)
    start, key, own = [], [], []
    at, h = T.windows(hashes, bounds, window)
    start.append(at), key.append(h), own.append(np.searchsorted(bounds, at, "right") - 1)
    length = [np.full(len(at), window)]
    for k in range(1, window):
        short = np.flatnonzero(np.diff(bounds) == k)
        at = bounds[short]
        total = np.zeros(len(at), T.U)
        for j in range(k):
            total = T.mix(total * T.U(31) + hashes[at + j])
        start.append(at), key.append(total + T.U(k)), own.append(short), length.append(np.full(len(at), k))
    start, key, own, length = map(np.concatenate, (start, key, own, length))
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(fresh)
    return Phrases(hashes, start[order][head], length[order][head], np.append(head, len(key)), [ids[i] for i in own])


def _hits(data: np.ndarray, offs: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """Word starts, ends, counts before documents, hit words, items of each document."""
    data = T.LOWER[data]
    starts, ends, bounds = T.spans(data, offs, T.ALNUM)
    words = T.span_hashes(data, starts, ends)
    cover = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set() for _ in range(len(bounds) - 1)]
    reach = int(p.length.max(initial=1)) - 1
    if len(words) <= SHARD_WORDS:
        shards = [(0, bounds)]
    else:  # one long document
        shards = [(b + lo, np.array([0, min(n - lo, SHARD_WORDS + reach)])) for b, n in zip(bounds[:-1].tolist(), np.diff(bounds).tolist()) for lo in range(0, n, SHARD_WORDS)]
    for base, cut in shards:
        if not len(p.start) or cut[-1] == 0:
            continue
        index = FMIndex(words[base : base + cut[-1]], cut)
        found, lo, hi = index.search(p.hashes, p.start, p.length)
        which, place = index.locate(lo, hi)
        found, place = found[which], place + base
        np.add.at(cover, place, 1)
        np.add.at(cover, place + p.length[found], -1)
        doc = np.searchsorted(bounds, place, "right") - 1
        for d, w in np.unique(np.stack([doc, found]), axis=1).T.tolist():
            items[d].update(p.items[p.item_at[w] : p.item_at[w + 1]])
    return starts, ends, bounds, np.cumsum(cover[:-1]) > 0, items


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPANS = "doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>"


def _spans(shared):
    def run(batches):
        p = shared.value
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1), SHARD_BYTES):
                _, _, bounds, hit, items = _hits(data, offs, p)
                begins, ends = [], []
                for i in range(hi - lo):
                    a, b = _runs(hit[bounds[i] : bounds[i + 1]])
                    begins.append(a), ends.append(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array([sorted(map(str, x)) for x in items], pa.list_(pa.string()))], ["doc_id", "n_words", "begins", "ends", "items"])

    return run


def _merged(batches):
    """Spans of several blocks of phrases, merged."""
    for batch in batches:
        begins, ends = [], []
        for b, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x: list[list[int]] = []
            for lo, hi in sorted(zip(b, e)):
                if x and lo <= x[-1][1]:
                    x[-1][1] = max(x[-1][1], hi)
                else:
                    x.append([lo, hi])
            begins.append([i for i, _ in x]), ends.append([i for _, i in x])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), batch.column(4)], batch.schema.names)


def _blocks(items: DataFrame, window: int, limit: int) -> list:
    """Broadcast phrases, in blocks of at most about ``limit`` bytes of item texts."""
    spark = items.sparkSession
    items = items.select(F.col("item_id"), "text")
    n = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-n // limit))
    out = []
    for k in range(count):
        rows = (items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k) if count > 1 else items).collect()
        out.append(spark.sparkContext.broadcast(phrases([r[0] for r in rows], [r[1] for r in rows], window)))
    return out


def spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, begins and ends (word spans to remove), items (ids, sorted as strings).

    docs: doc_id (long), text.  items: item_id, text.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(items, window, block_bytes)
    if len(blocks) == 1:
        return docs.mapInArrow(_spans(blocks[0]), SPANS)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    keyed = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = None
    for b in blocks:  # rows by number, as documents may repeat
        one = scratch.table(keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_spans(b), SPANS))
        found = one if found is None else found.union(one)
    flat = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return flat.mapInArrow(_merged, SPANS).withColumnRenamed("doc_id", "row").join(keyed.select("row", "doc_id"), "row").select("doc_id", "n_words", "begins", "ends", "items")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: how many of its words are hit, by how many items."""
    hit = F.aggregate(F.arrays_zip("begins", "ends"), F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["begins"])
    return spans(docs, items).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("begins") > 0).alias("contaminated"))


def _cut(shared, schema_names: list[str], at: int, mark: str):
    def run(batches):
        for batch in batches:
            column = batch.column(at)
            for lo, hi, data, offs in T.pieces(column, SHARD_BYTES):
                part = batch.slice(lo, hi - lo)
                drop, touched = np.zeros(len(data) + 1, np.int64), np.zeros(hi - lo, bool)
                for block in shared:
                    starts, ends, bounds, hit, _ = _hits(data, offs, block.value)
                    for i in np.flatnonzero(T.sums(hit, bounds) > 0).tolist():
                        a, b = _runs(hit[bounds[i] : bounds[i + 1]])
                        np.add.at(drop, starts[a + bounds[i]], 1)
                        np.add.at(drop, ends[b - 1 + bounds[i]], -1)
                        touched[i] = True
                if touched.any():
                    keep = np.cumsum(drop[:-1]) == 0
                    left = np.zeros(len(data) + 1, np.int64)
                    np.cumsum(keep, out=left[1:])
                    valid = np.asarray(part.column(at).is_valid())
                    text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(left[offs]), pa.py_buffer(data[keep])).cast(pa.string())
                    text = pa.compute.if_else(pa.array(valid), text, pa.scalar(None, pa.string()))
                    part = part.set_column(at, schema_names[at], text)
                yield part.append_column(mark, pa.array(touched))

    return run


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the spans removed from texts (from the first byte of a span's first word to the last of its last).

    A text that has lost all its words goes; texts without hits stay as they are, byte for byte.
    """
    bounded_batches(docs.sparkSession)
    blocks = _blocks(items, window, block_bytes)
    mark = f"touched_{uuid.uuid4().hex}"  # no column of the input has this name
    schema = ST.StructType([*docs.schema.fields, ST.StructField(mark, ST.BooleanType())])
    out = docs.mapInArrow(_cut(blocks, docs.columns, docs.columns.index("text"), mark), schema)
    return out.where(~F.col(mark) | F.coalesce(F.lower("text").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"), F.lit(False))).drop(mark)


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, win, len(win) AS n FROM (SELECT item_id, ws[k + 1 : k + least(10, len(ws))] AS win FROM (SELECT *, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS k FROM i WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, k, n, ws[k + 1 : k + n] AS win FROM (SELECT rid, ws, n, unnest(range(len(ws) - n + 1)) AS k FROM d, sizes WHERE len(ws) >= n)),
met AS (SELECT rid, k, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM met)) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM met) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)"""
