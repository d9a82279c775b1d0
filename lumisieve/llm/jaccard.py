"""N-gram Jaccard join: size-aware heavy-light set similarity join.

Sets of 5-word shingles link when 100*|x & y| >= 80*|x | y|.  After Deng, Tao and
Li (SIGMOD 2018), sets are cut at a size boundary: *small* sets enumerate the
2-subsets of a prefix, so two of them meet only if they share two rare shingles;
*large* sets are found by scanning inverted lists of single prefix shingles.  Both
become buckets (a key, and the sets below it).  Prefixes follow one order of all
shingles, rare first: a linked set x shares at least ceil(0.8|x|) shingles, hence
any two linked sets share at least k of their first |x| - ceil(0.8|x|) + k.

Rarity comes from a count sketch over the whole corpus; an overestimate only moves
a shingle back in the common order, so no link depends on it.  The boundary is
the one of least expected cost: subset rows below it, list rows times expected
list length (from the sketch's second moment) above it.

Identical sets are collapsed first; groups of near copies are connected by
:mod:`linkage` without listing their pairs.

Edge cases: null or empty texts and texts without words have an empty set, size 0,
and are alone; texts of fewer than five words are one shingle; rows that repeat a doc_id
are sets of their own, each with its row; rows with a null doc_id keep their row and size and
are linked with nothing (null component and class); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as T
from .idfilter import bitmap, maybe
from .linkage import connect
from .scratch import Scratch, bounded_batches

WIDTH = 5
SKETCH_BITS = 18
SLICES = 64
#: Counters of a set's signature: how many of its shingles fall into each cell.
CELLS = 256
#: Bits of a set's parity sketch: whether a cell has an odd number of its shingles.
PARITY = 1024
_PARITY = [f"p{k}" for k in range(PARITY // 64)]
#: Sizes above this share one histogram bin; the boundary is always below.
TOP_SIZE = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document, ascending, and counts before documents."""
    data = T.LOWER[data]
    starts, ends, bounds = T.spans(data, offsets, T.NOT_SPACE)
    words = T.span_hashes(data, starts, ends)
    at, hashes = T.windows(words, bounds, width)
    doc = np.searchsorted(bounds, at, "right") - 1
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < width))
    if len(few):
        extra = np.array([int(T.mix(np.array([hash_sequence(words[bounds[i] : bounds[i + 1]])], T.U))[0]) for i in few], T.U)
        doc, hashes = np.concatenate([doc, few]), np.concatenate([hashes, extra])
    order = T.order_by_owner(doc, hashes)
    doc, hashes = doc[order], hashes[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[keep], hashes[keep]
    return hashes, np.searchsorted(doc, np.arange(len(offsets)))


def hash_sequence(words: np.ndarray) -> int:
    total = len(words)
    for w in words.tolist():
        total = (total * 0x9E3779B97F4A7C15 + w) % (1 << 64)
    return total


def _sketch_cell(h: np.ndarray, bits: int) -> np.ndarray:
    return T.mix(h ^ T.U(bits)) >> T.U(64 - bits)


def _sketches(width: int, bits: int):
    def run(batches):
        sketch = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, data, offs in T.pieces(batch.column(0)):
                data = T.LOWER[data]
                starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
                _, h = T.windows(T.span_hashes(data, starts, ends), bounds, width)
                sketch += np.bincount(_sketch_cell(h, bits), minlength=1 << bits)
        if sketch.any():
            parts = [x.astype("<i8").tobytes() for x in np.split(sketch, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    return run


def _add_slices(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8").copy() for x in table.column("counts").to_pylist())
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def expected_list(cells: np.ndarray) -> float:
    """Expected length of an inverted list of a prefix shingle, from a sketch's second moment.

    Cells far above the median hold frequent shingles, which come last in the common order
    and so hardly ever in prefixes; they are left out.
    """
    middle = np.median(cells)
    cells = cells[cells <= middle + 6 * np.sqrt(middle) + 6]
    total = cells.sum()
    return max(1.0, ((cells * cells).sum() - total * total / len(cells)) / total) if total else 1.0


def boundary(sizes: dict[int, int], expected_list: float) -> int:
    """The set size below which subsets are cheaper than lists."""
    best, at, cost = None, 0, sum(n * (s - need(s) + 1) * expected_list for s, n in sizes.items())
    for s in range(2, TOP_SIZE):
        if best is None or cost < best:
            best, at = cost, s
        p = s - need(s) + 2
        cost += sizes.get(s, 0) * (p * (p - 1) / 2 - (p - 1) * expected_list)
    return at


def need(size: int) -> int:
    """ceil(0.8 * size)"""
    return (4 * size + 4) // 5


def _binary(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(hashes).view(np.uint8))]).cast(pa.binary())


def _fixed(cells: np.ndarray, rows: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * CELLS).astype(np.int32)), pa.py_buffer(cells)])


def _prefixes(width: int, bits: int, counts: bytes):
    """Size and fingerprint of each document's set, and its prefix, rare first."""

    def run(batches):
        sketch = np.frombuffer(counts, "<i8")
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                h, b = shingle_sets(data, offs, width)
                cells = np.bincount(T.owners(b) * CELLS + (h & T.U(CELLS - 1)).astype(np.int64), minlength=CELLS * (hi - lo))
                cells = np.minimum(cells, 255).astype(np.uint8)
                odd = np.bincount(T.owners(b) * PARITY + ((h >> T.U(20)) & T.U(PARITY - 1)).astype(np.int64), minlength=PARITY * (hi - lo)) & 1
                odd = np.packbits(odd.astype(np.uint8).reshape(hi - lo, PARITY), axis=1, bitorder="little").view("<i8")
                one, two = T.sums(T.mix(h + T.U(1)), b), T.sums(T.mix(h + T.U(2)), b)
                size, own = np.diff(b), T.owners(b)
                rare = np.minimum(sketch[_sketch_cell(h, bits)], (1 << 24) - 1).astype(T.U)
                h = h[T.order_by_owner(own, (rare << T.U(40)) | (h >> T.U(24)), stable=True)]
                kept = np.minimum(size, size - (4 * size + 4) // 5 + 2)
                prefix = h[np.arange(len(h)) - b[own] < kept[own]]
                at = np.zeros(len(size) + 1, np.int64)
                np.cumsum(kept, out=at[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _binary(prefix, at), _fixed(cells, hi - lo), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(odd.shape[1]))], ["doc_id", "n", "f1", "f2", "prefix", "cells", *_PARITY])

    return run


def _postings(edge: int):
    """Buckets of sets of (id, n, prefix): single shingles of large sets, 2-subsets of small ones."""

    def run(batches):
        for batch in batches:
            ids, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw, at = _bytes(batch.column(2))
            h, b = raw.view(T.U), at // 8
            own = T.owners(b)
            place, kept = np.arange(len(h)) - b[own], np.diff(b)
            s, spare = size[own], (size - (4 * size + 4) // 5)[own]
            single = (place < spare + 1) & (5 * s >= 4 * edge) & (s > 1)
            keys, docs = [h[single]], [own[single]]
            pair = np.flatnonzero((s < edge) & (s > 1))
            for gap in range(1, int(kept[size < edge].max(initial=0))):
                a = pair[place[pair] + gap < kept[own[pair]]]
                keys.append(T.mix(h[a] * T.U(3) ^ h[a + gap] * T.U(0x9E3779B97F4A7C15)))
                docs.append(own[a])
            key, doc = np.concatenate(keys), np.concatenate(docs)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(size[doc].astype(np.int32))], ["key", "node", "n"])

    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw[at[0] : at[-1]]), at - at[0]


def _sets(width: int, wanted: bytes):
    """Sets of the documents whose cell is wanted."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(maybe(wanted, np.asarray(batch.column(0)))))
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                h, b = shingle_sets(data, offs, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _binary(h, b)], ["id", "s"])

    return run


def _alike(batches):
    """Pairs whose signatures differ little enough: 9 * |x ^ y| <= |x| + |y| is needed, and cells cannot differ by more than |x ^ y|."""
    for batch in batches:
        x, y = (_bytes(batch.column(i))[0].reshape(-1, CELLS).astype(np.int16) for i in (2, 3))
        apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
        yield batch.select(["u", "v"]).filter(pa.array(9 * apart <= np.asarray(batch.column(4))))


def _linked(batches):
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, T.U), np.frombuffer(y, T.U)
            both = int(T.lookup(y, x)[1].sum()) if len(y) else 0
            keep.append(both > 0 and 100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def join(docs: DataFrame, width: int = WIDTH, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and class_id (the least doc_id with the same set).

    docs: doc_id (long), text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = every.where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = _joined(docs, width, sketch_bits, scratch)
    else:  # sets go by numbers of their own, of which the least doc_id of a group is found again
        keyed = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
        found = scratch.table(_joined(keyed.select(F.col("row").alias("doc_id"), "text"), width, sketch_bits, scratch).withColumnRenamed("doc_id", "row"))
        known = scratch.table(found.join(keyed.select("row", "doc_id"), "row"))
        for c in ("component_id", "class_id"):
            least = scratch.table(known.groupBy(c).agg(F.min("doc_id").alias("least")))
            known = known.join(least, c).drop(c).withColumnRenamed("least", c)
        out = known.select("doc_id", "n_shingles", "component_id", "class_id")
    alone = every.where("doc_id is null").mapInArrow(_sizes(width), "doc_id long, n_shingles long")
    return out.unionByName(alone.withColumns({c: F.lit(None).cast("long") for c in ("component_id", "class_id")}))


def _sizes(width: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(shingle_sets(data, offs, width)[1]))], ["doc_id", "n_shingles"])

    return run


def _joined(docs: DataFrame, width: int, sketch_bits: int, scratch: Scratch) -> DataFrame:
    """The same for documents (doc_id, text) whose doc_ids differ."""
    slices = docs.select("text").mapInArrow(_sketches(width, sketch_bits), "slice int, counts binary").groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary").collect()
    counts = b"".join(bytes(r.counts) for r in sorted(slices, key=lambda r: r.slice)) or bytes(8 << sketch_bits)
    rows = scratch.table(docs.mapInArrow(_prefixes(width, sketch_bits, counts), "doc_id long, n long, f1 long, f2 long, prefix binary, cells binary, " + ", ".join(f"{x} long" for x in _PARITY)))
    same = ["n", "f1", "f2"]
    classes = scratch.table(rows.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("class_id")))
    sizes = {r.s: r.c for r in classes.groupBy(F.least("n", F.lit(TOP_SIZE)).alias("s")).agg(F.count("*").alias("c")).collect()}
    edge = boundary(sizes, expected_list(np.frombuffer(counts, "<i8").astype(float)))
    unique = rows.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "prefix")
    postings = unique.mapInArrow(_postings(edge), "key long, node long, n int")

    sketches = rows.select(F.col("doc_id").alias("node"), "n", *_PARITY).join(classes.select(F.col("class_id").alias("node")), "node", "left_semi").dropDuplicates(["node"])

    def verify(pairs: DataFrame) -> DataFrame:
        # parities tell small sets apart, counts of cells large ones; both before any set is read
        side = lambda x, name: sketches.select(F.col("node").alias(x), F.struct("n", *_PARITY).alias(name))
        pairs = scratch.table(pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").where(close("x", "y")).select("u", "v"))
        side = lambda x: rows.select(F.col("doc_id").alias(x), F.col("cells").alias(f"c{x}"), F.col("n").alias(f"n{x}")).dropDuplicates([x])
        both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "cu", "cv", (F.col("nu") + F.col("nv")).alias("n"))
        pairs, count = scratch.counted(both.mapInArrow(_alike, "u long, v long"))
        ends = pairs.select(F.explode(F.array("u", "v")).alias("id"))
        sets = docs.mapInArrow(_sets(width, bitmap(ends, 2 * count)), "id long, s binary")
        sets = scratch.table(sets.join(ends.distinct(), "id", "left_semi"))
        full = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
        return full.select("u", "v", "a", "b").mapInArrow(_linked, "u long, v long").distinct()

    def near(a: str, b: str):
        return (F.col(f"{a}.n") * 5 >= F.col(f"{b}.n") * 4) & (F.col(f"{b}.n") * 5 >= F.col(f"{a}.n") * 4)

    def enough(shared, a: str, b: str, large):
        # of a link's 4/9 (|x| + |y|) common shingles, all but those past the shorter-reaching prefix lie in both prefixes
        x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
        past = lambda n: F.floor((4 * n + 4) / 5) - 1
        needed = F.floor((4 * (x + y) + 8) / 9) - F.greatest(past(x), past(y)) - large
        return (F.least(x, y) < edge) | (shared >= needed)

    def close(a: str, b: str):
        # cells of unlike parity cannot outnumber the shingles of one set only, of which a link allows a ninth of both sizes
        apart = [F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in _PARITY]
        return near(a, b) & (9 * sum(apart[1:], apart[0]) <= F.col(f"{a}.n") + F.col(f"{b}.n"))

    comp = connect(postings, near, verify, scratch, enough=enough, detail=sketches.drop("n"), close=close)
    member = rows.select("doc_id", *same).join(classes, same, "left").select("doc_id", "n", "class_id")
    return member.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def representatives(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without all but the least doc_id of each component; documents with an empty set or a null doc_id stay.

    Of rows that repeat a doc_id, all go if one of them has a group with a smaller one.
    """
    links = join(docs, width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(links, "doc_id", "left_anti")


SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i + 1 : i + 5], ' ') AS sh FROM (SELECT rid, ws, unnest(range(greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS u, b.rid AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v, c = x.n AND c = y.n AS same FROM c JOIN n x ON u = x.rid JOIN n y ON v = y.rid WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, l.v FROM r JOIN l ON r.other = l.u),
comp AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON o.rid = other GROUP BY r.rid),
class AS (SELECT u AS rid, min(doc_id) AS least FROM l JOIN d ON v = d.rid WHERE same GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, least(doc_id, coalesce(least, doc_id)) AS class_id FROM d LEFT JOIN n USING (rid) LEFT JOIN comp USING (rid) LEFT JOIN class USING (rid)"""
