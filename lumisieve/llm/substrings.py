"""Substring dedup: passages of 50 words that another document has already, by super-k-mers.

1. Each window of K words has a minimiser: the least hash of its M-word grams.  Consecutive
   windows that share it make a super-k-mer, one light row (document, first word, number
   of windows); equal windows have equal minimisers, so they meet in one bucket.
2. Buckets that hold one document only are dropped by a grouped count, before any text moves.
3. Super-k-mers with equal words (copies, shared passages) are told by a hash; one of
   them, from the least document, travels as a packed string of its words to its bucket.
   There windows are ranked exactly (words by their bytes, then ranks of 2, 4, ... 32 and K
   words by sorting), and each window learns the least document that holds it.
4. A bucket of very many different strings (a short passage in ever new surroundings) is not
   unpacked in one task: its windows are grouped by Spark under 128-bit hashes.
5. Every super-k-mer gets its windows' least documents back by a join; windows whose least
   document is smaller than their own cover the words to remove, all judged on the input.

Edge cases: null or empty texts have no words; texts shorter than a window lose nothing; rows
with a null doc_id lose nothing and take nothing from others; rows that repeat a doc_id are
one document (they take nothing from each other); repeated rows each get a row; super-k-mers are cut
after CUT windows, so a text of one repeated word moves in bounded strings; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from . import textvec as T
from .scratch import Scratch, bounded_batches

K, M = 50, 10
#: Windows in one packed string.
CUT = 256
#: Strings and words in one bucket that a task unpacks; larger buckets are grouped by windows.
BUCKET_STRINGS, BUCKET_WORDS = 2000, 1 << 18
#: Bytes of packed strings that are sorted at once.
SORT_BYTES = 4 << 20
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_kmers(hashes: np.ndarray, bounds: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser, hash of the words) of every super-k-mer of documents of word hashes."""
    at, gram = T.windows(hashes, bounds, m)
    least = np.full(len(hashes), TOP)
    least[at] = gram
    span, left = 1, k - m + 1
    while 2 * span <= left:  # least of 2, 4, ... grams from each place on
        least[: len(least) - span] = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    own = T.owners(bounds)
    n = max(0, len(hashes) - k + 1)
    start = np.flatnonzero(own[:n] == own[k - 1 :]) if n else np.zeros(0, np.int64)
    mini = np.minimum(least[start], least[start + left - span])
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1] + 1) | (mini[1:] != mini[:-1]) | (own[start[1:]] != own[start[:-1]])
    head = np.flatnonzero(fresh)
    index = np.arange(len(start))
    fresh |= (index - head[np.cumsum(fresh) - 1] if len(head) else index) % CUT == 0
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(start)))
    first = start[head]
    return first, count, mini[head], ranges(hashes, first, count + k - 1)


def ranges(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run of words."""
    up, down = T._powers(len(hashes) + 1, False), T._powers(len(hashes) + 1, True)
    total = np.zeros(len(hashes) + 1, T.U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return T.mix((total[start + length] - total[start]) * down[start] + length.astype(T.U))


def window_ranks(words: np.ndarray, k: int) -> np.ndarray:
    """Equal numbers for places with equal k words from there on; places with fewer words left are not meaningful."""
    rank, span = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while span < k:
        step = min(span, k - span)
        later = np.full(len(rank), 0, np.int64)
        later[: len(rank) - step] = rank[step:]
        rank = np.unique((rank << 32) | later, return_inverse=True)[1].astype(np.int64)
        span += step
    return rank


def exact_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal only for equal bytes: hashes whose words are compared with the first that has it."""
    hashes = T.span_hashes(data, starts, ends)
    _, first, name = np.unique(hashes, return_index=True, return_inverse=True)
    model, sizes = first[name], ends - starts
    good = sizes == sizes[model]
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.where(good, sizes, 0), out=offs[1:])
    inside = np.arange(offs[-1])
    mine = np.where(good, sizes, 0)
    differ = data[inside + np.repeat(starts - offs[:-1], mine)] != data[inside + np.repeat(starts[model] - offs[:-1], mine)]
    good &= T.sums(differ, offs) == 0
    if not good.all():  # two words with one hash
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(~good).tolist():
            name[i] = seen.setdefault(data[starts[i] : ends[i]].tobytes(), len(first) + len(seen))
    return name


def _cut(batches):
    """Light rows of texts (doc_id, same, text)."""
    for batch in batches:
        for lo, hi, data, offs in T.pieces(batch.column(2)):
            starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
            first, count, mini, skid = super_kmers(T.span_hashes(data, starts, ends), bounds)
            own = np.searchsorted(bounds, first, "right") - 1
            row = pa.array(lo + own)
            arrays = [pa.array(mini.view(np.int64)), pa.array(skid.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array((first - bounds[own]).astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["mini", "skid", "doc", "same", "start", "n"])


def _packed(batches):
    """Packed strings of rows (doc_id, same, text, start, n, mini, skid, large); the last five are arrays."""
    before = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for lo, hi, data, offs in T.pieces(batch.column(2)):
            starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
            size = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(ends - starts + 1, out=size[1:])
            text, _, _ = T.joined(data, starts, ends, bounds)
            rows = batch.slice(lo, hi - lo)
            fresh = np.array([keys[i] != (keys[i - 1] if i else before) for i in range(lo, hi)])  # repeated rows follow each other
            lists = [rows.column(3 + j) for j in range(5)]
            own = np.repeat(np.arange(hi - lo), lists[0].value_lengths().to_numpy(zero_copy_only=False))
            start, n, mini, skid, large = (x.flatten() for x in lists)
            keep = fresh[own]
            first = (bounds[own] + start.to_numpy())[keep]
            last = first + n.to_numpy()[keep] + K - 1
            mask = pa.array(keep)
            for at in range(0, len(first), 4096):
                some = slice(at, at + 4096)
                packed = T.strings(text, size[first[some]], size[last[some]] - 1).cast(pa.string())
                part = lambda x: x.filter(mask)[at : at + 4096]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part(mini), part(skid), rows.column(0).take(pa.array(own[keep][some])), packed, part(large)], ["mini", "skid", "doc", "packed", "large"])
        before = keys[-1] if keys else before


def _runs_of(least: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int) -> pa.ListArray:
    """Arrays of (first window, last window, least document), one for each row: runs of equal ``least``."""
    fresh = np.ones(len(least), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(least)) - 1
    kids = pa.StructArray.from_arrays([pa.array(place[head].astype(np.int32)), pa.array(place[tail].astype(np.int32)), pa.array(least[head])], ["lo", "hi", "least"])
    offs = np.searchsorted(row[head], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), kids)


LEAST = "mini long, skid long, least array<struct<lo int, hi int, least long>>"


def _unpacked(column: pa.Array) -> tuple:
    """Word bytes, starts, ends, words before each string; then, of each window, its string, its place there and its first word."""
    data, offs = T.buffers(column)
    starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
    n = np.diff(bounds) - K + 1
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return data, starts, ends, bounds, row, place, bounds[row] + place


def _sort_bucket(table: pa.Table) -> pa.RecordBatch:
    """Whole buckets, as rows (mini, skid, doc, packed): the least document of each window of each string."""
    table = table.combine_chunks()
    data, starts, ends, _, row, place, first = _unpacked(table.column(3))
    rank = np.unique(window_ranks(exact_words(data, starts, ends), K)[first], return_inverse=True)[1]
    doc = table.column(2).to_numpy()[row]
    least = np.full(int(rank.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, doc)
    mini, skid = (table.column(k).combine_chunks() for k in (0, 1))
    return pa.RecordBatch.from_arrays([mini, skid, _runs_of(least[rank], row, place, len(table))], ["mini", "skid", "least"])


def _sorted(batches):
    """Strings (mini, skid, doc, packed) in order of mini: whole buckets are sorted together, some megabytes at a time."""
    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += batch.nbytes
        if size < SORT_BYTES:
            continue
        table = pa.Table.from_batches(held)
        mini = table.column(0).to_numpy()
        cut = int(np.flatnonzero(mini != mini[-1])[-1]) + 1 if (mini != mini[-1]).any() else 0
        if cut:
            yield _sort_bucket(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        size = sum(len(b) and b.nbytes for b in held)
    if held:
        yield _sort_bucket(pa.Table.from_batches(held))


def _hashed(batches):
    """Windows of strings (mini, skid, doc, packed): two hashes of each, for buckets that no task unpacks whole."""
    for batch in batches:
        if not len(batch):
            continue
        data, starts, ends, _, row, place, first = _unpacked(batch.column(3))
        hashes = T.span_hashes(data, starts, ends)
        size = np.full(len(first), K)
        both = ranges(hashes, first, size), ranges(T.mix(hashes + T.U(0xA24BAED4963EE407)), first, size)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(place.astype(np.int32)), *(pa.array(h.view(np.int64)) for h in both)], ["mini", "skid", "doc", "j", "h1", "h2"])


def spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, same, spans): spans are arrays of (first, last) word numbers to remove; same tells texts under one doc_id apart."""
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("same"), "text")
    light = scratch.table(texts.mapInArrow(_cut, "mini long, skid long, doc long, same long, start int, n int"))
    shared = light.groupBy("mini").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("mini")
    shared = scratch.table(shared)  # joined as tables, a large bucket can be split
    found = scratch.table(light.join(shared, "mini", "left_semi"))
    scratch.drop(light)
    scratch.drop(shared)
    different = found.groupBy("mini", "skid").agg(F.min(F.struct("doc", "same", "start", "n")).alias("of"))
    different = scratch.table(different.select("mini", "skid", "of.*"))
    large = different.groupBy("mini").agg(F.count(F.lit(1)).alias("strings"), F.sum(F.col("n") + (K - 1)).alias("words")).where((F.col("strings") > BUCKET_STRINGS) | (F.col("words") > BUCKET_WORDS))
    large = scratch.table(large.select("mini", F.lit(True).alias("large")), tidy=False)
    pieces = different.join(large, "mini", "left").groupBy("doc", "same").agg(F.collect_list(F.struct("start", "n", "mini", "skid", F.coalesce("large", F.lit(False)).alias("large"))).alias("p"))
    pieces = pieces.select(F.col("doc").alias("doc_id"), "same", *(F.col(f"p.{c}").alias(c) for c in ("start", "n", "mini", "skid", "large")))
    seen = Observation()
    strings = texts.join(pieces, ["doc_id", "same"]).select("doc_id", "same", "text", "start", "n", "mini", "skid", "large").mapInArrow(_packed, "mini long, skid long, doc long, packed string, large boolean")
    strings = scratch.table(strings.observe(seen, F.count(F.when(F.col("large"), 1)).alias("large")))
    scratch.drop(different)
    row = ("mini", "skid", "doc", "packed")
    least = strings.where("not large").select(*row).repartition("mini").sortWithinPartitions("mini").mapInArrow(_sorted, LEAST)
    if seen.get["large"]:
        wide = scratch.table(strings.where("large").select(*row).mapInArrow(_hashed, "mini long, skid long, doc long, j int, h1 long, h2 long"))
        by = scratch.table(wide.groupBy("h1", "h2").agg(F.min("doc").alias("least")))
        each = wide.join(by, ["h1", "h2"]).select("mini", "skid", F.struct("j", F.col("j").alias("hi"), "least").alias("w"))
        least = least.unionByName(each.groupBy("mini", "skid").agg(F.collect_list("w").cast("array<struct<lo int, hi int, least long>>").alias("least")))
    least = scratch.table(least)
    scratch.drop(strings)
    hit = found.join(least, ["mini", "skid"]).select("doc", "same", "start", F.explode(F.filter("least", lambda r: r["least"] < F.col("doc"))).alias("r"))
    hit = hit.select(F.col("doc").alias("doc_id"), "same", F.struct((F.col("start") + F.col("r.lo")).alias("first"), (F.col("start") + F.col("r.hi") + (K - 1)).alias("last")).alias("span"))
    out = scratch.table(hit.groupBy("doc_id", "same").agg(F.collect_set("span").alias("spans")))
    scratch.drop(found)
    scratch.drop(least)
    return out


def _kept(as_text: bool):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
                column = batch.column(2).slice(lo, hi - lo)
                own = np.repeat(np.arange(hi - lo), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = column.flatten()
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, bounds[own] + flat.field("first").to_numpy(), 1)
                np.subtract.at(edge, bounds[own] + flat.field("last").to_numpy() + 1, 1)
                gone = np.cumsum(edge[:-1]) > 0
                keep = np.flatnonzero(~gone)
                text, first, last = T.joined(data, starts[keep], ends[keep], np.searchsorted(keep, bounds))
                kept = [text[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())]
                out = pa.array([x.decode() for x in kept], pa.string()) if as_text else pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(T.sums(gone, bounds)), out], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _applied(docs: DataFrame, as_text: bool) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    found = spans(docs, Scratch(spark, "substrings"))
    rows = docs.withColumn("same", F.xxhash64("text")).join(found, ["doc_id", "same"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_kept(as_text), "doc_id long, n_words long, n_removed long, kept string")


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without passages that a smaller doc_id has, words joined by one space."""
    return _applied(docs, True)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return _applied(docs, False).withColumnRenamed("kept", "kept_sha256")


SQL = r"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(coalesce(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), []), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') AS win FROM (SELECT *, unnest(range(len(ws) - 49)) AS i FROM w)),
least AS (SELECT win, min(doc_id) AS least FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (win) WHERE least < doc_id),
word AS (SELECT rid, unnest(range(len(ws))) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)"""
