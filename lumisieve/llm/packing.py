"""Packing of tokenized documents by best-fit decreasing.

Tokens are made once for each distinct white-space-separated word of a batch and
laid out by index, which gives the same ids as encoding whole texts: the tokenizer
drops white space, and no token spans ASCII white space (checked in the tests).
Overlong documents are cut into full windows first; what remains goes, largest
first, into the open window with the least room that still fits it, found in a
segment tree indexed by remaining capacity.

Pieces are dealt by a hash of (document, start) into bins of bounded size; every bin
is packed by itself, so no task or driver sees all pieces, and a re-run of a lost
task packs the same way.  Only the last windows of each bin stay partly empty.

Edge cases: null or empty text is the end token alone; repeated documents are packed
each time they occur; other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as T
from .scratch import Scratch, bounded_batches

CAPACITY = 2048
END_ID = 1
#: Pieces packed by one task.
BIN_PIECES = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A control character stands between words that are encoded together.
MARK = "\x01"
#: Words encoded in one text.
TOGETHER = 4096


def word_ids(tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after the other, and how many each has.

    Words are encoded many at a time, with a mark of one known id between them; a word that
    holds the mark, or may hold a special token, is encoded by itself.
    """
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    whole = words.to_pylist()
    odd = np.flatnonzero(np.asarray(pa.compute.match_substring_regex(words, r"\x01|<\|"))).tolist() if len(mark) == 1 else list(range(len(whole)))
    alone = {i: np.array(x.ids, np.uint32) for i, x in zip(odd, tokenizer.encode_batch_fast([whole[i] for i in odd], add_special_tokens=False))}
    for i in alone:
        whole[i] = ""
    gap = f" {MARK} "
    texts = [gap.join(whole[i : i + TOGETHER]) + gap for i in range(0, len(whole), TOGETHER)] if len(mark) == 1 else []
    flat = np.concatenate([np.array(tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts] or [np.zeros(0, np.uint32)])
    ends = np.flatnonzero(flat == mark[0]) if len(mark) == 1 else np.zeros(len(whole), np.int64)
    size = np.diff(np.append(-1, ends)) - 1 if len(mark) == 1 else np.zeros(len(whole), np.int64)
    flat = flat[flat != mark[0]] if len(mark) == 1 else flat
    if alone:
        place = np.repeat((np.cumsum(size) - size)[odd], [len(alone[i]) for i in odd])
        flat = np.insert(flat, place, np.concatenate([alone[i] for i in odd]))
        size[odd] = [len(alone[i]) for i in odd]
    return flat, size


class WordIds:
    """Token ids by word, kept from batch to batch; beyond KEEP words it starts anew."""

    KEEP = 1_000_000

    def __init__(self, path: str):
        self.path = path
        # a tokenizer that lower-cases meets fewer distinct words if A-Z are lower-cased first (special tokens have none)
        self.lower = _tokenizer(path).normalizer is not None and _tokenizer(path).normalizer.normalize_str("AZ") == "az"
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, T.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and their offsets."""
        if self.lower and b"<|" not in data.tobytes():
            data = T.LOWER[data]
        starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
        hashes = T.span_hashes(data, starts, ends)
        keys, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.KEEP:
            self.clear()
        _, known = T.lookup(self.keys, keys)
        new = first[~known]
        if len(new):
            flat, size = word_ids(_tokenizer(self.path), T.strings(data, starts[new], ends[new]))
            at = np.cumsum(size) - size + len(self.ids)
            every = np.concatenate([self.keys, keys[~known]])
            order = np.argsort(every, kind="stable")
            self.keys, self.at, self.size = every[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, flat])
        place, _ = T.lookup(self.keys, keys)
        at, size = self.at[place][code], self.size[place][code]
        before = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        return self.ids[np.arange(before[-1]) + np.repeat(at - before[:-1], size)], before[bounds]


@lru_cache(maxsize=1)
def _words(path: str) -> WordIds:
    """Kept by a worker from task to task."""
    return WordIds(path)


def _cut(path: str, capacity: int):
    def run(batches):
        words, copy = _words(path), 0
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                ids, bounds = words.encode(data, offs)
                ids = ids.astype("<u4", copy=False)
                doc, start, length, crc, total = [], [], [], [], []
                end = np.array([END_ID], "<u4")
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.append(ids[a:b], end)
                    for s in range(0, len(own), capacity):
                        part = own[s : s + capacity]
                        doc.append(i), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes())), total.append(len(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([copy + d for d in doc], pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"])
                copy += hi - lo

    return run


class RoomTree:
    """Open windows by remaining room, in a segment tree that counts windows of each room."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, least: int) -> tuple[int, int]:
        """(room, window) of the tightest window with at least this room; (-1, -1) if there is none."""
        count, i = self.count, least + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i //= 2
            if i <= 1:
                return -1, -1
            i += 1
            while i < self.leaves:
                i *= 2
                if not count[i]:
                    i += 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i //= 2
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length; lengths descend."""
    tree, window, offset, n = RoomTree(capacity), [], [], 0
    for x in lengths:
        room, w = tree.take(x)
        if w < 0:
            room, w, n = capacity, n, n + 1
        window.append(w), offset.append(capacity - room)
        if room > x:
            tree.add(room - x, w)
    return window, offset


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("copy", "ascending")])
        window, offset = best_fit(table.column("length").to_pylist(), capacity)
        first = table.column("bin")[0].as_py() << 32
        return table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array([first + w for w in window], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id (long), text.  path: a tokenizer file that executors can open.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = scratch.table(docs.mapInArrow(_cut(path or tokenizer_path(), capacity), PIECES))
    bins = max(1, -(-cut.count() // bin_pieces))
    dealt = cut.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(bins)))
    return dealt.groupBy("bin").applyInArrow(_pack(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
