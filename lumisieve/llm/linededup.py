"""Fuzzy line dedup: one occurrence of each group of near-identical lines stays.

1. Lines are normalised to their words (digits, letters, non-ASCII bytes; A-Z
   lower-cased) with one space between.  Equal normalised lines are one node.
2. A line's SimHash is made in blocks: each block takes the majority bits of three grams
   of GRAM bytes that overlap, so an edit reaches the few blocks it stands in and no
   others.  About BLOCKS of them are kept, those of least hash, whatever the line's length;
   shorter lines have narrower blocks (WIDTHS), and lengths about an edge have both.  The
   shortest lines have the hashes of their text less one byte instead.
3. Pigeonhole: lines meet where one block agrees.  Blocks of one line are dropped before
   anything else.  In buckets of up to a few lines all pairs meet; in larger ones each
   line meets some members, and lines that are still apart meet again under other blocks;
   pairs that are in one bucket and still apart after that are compared in full
   (:func:`linkage.gather`).
4. Lines that meet are compared by the SimHash of the whole line, unless they are short, and then verified: edit distance of the normalised lines at most a fifth of
   the longer one.
5. In each connected group the first occurrence (least doc_id, then line number) stays;
   all others go from their documents.

With a radius given, lines meet by the SimHash of the whole line instead: the pigeonhole
principle on its 64 bits finds each pair within the radius.

Edge cases: lines without words are never removed and never compared; null text stays
null, empty text empty; a document whose lines all go gets the empty text; rows with
a null doc_id are neither compared nor changed; rows with
the same doc_id count as one document (their lines are numbered alike, and equal lines
at one number are one occurrence); other columns are ignored by :func:`removals` and
kept by :func:`dedup`, where n_lines and n_removed replace columns of those names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as ST

from . import edits, textvec as T
from .idfilter import bitmap, maybe
from .linkage import connect, gather
from .scratch import Scratch, bounded_batches

RADIUS = 3
#: Blocks of a line that are kept, about.
BLOCKS = 16
GRAM = 8
#: Blanks around a line, so that its ends stand in blocks as well.
PAD = 4
#: Bytes between the three grams of a block, and the lengths (least, most) of the lines that have such blocks.
WIDTHS = ((0, 14, 44), (2, 36, 100), (4, 84, 1 << 62))
#: Bytes of text that kernels take at once: their arrays stay in a core's cache.
PIECE = 1 << 18
#: Bits of the SimHash of a whole line, and how many may differ: random edits of a seventh of the characters change 96,
#: give or take 8, and lines of one language that have nothing in common differ in 120.
SKETCH, FARTHEST = 256, 110
_SKETCH = [f"s{k}" for k in range(SKETCH // 64)]
#: Bits of the set of letter pairs of a line; and of the set of its grams that edits.promising counts.
PAIRS, CELLS = 256, 2048
_PAIRS = [f"g{k}" for k in range(PAIRS // 64)]
#: Lines, and bytes of their texts, of large buckets that are compared at once, about; and pairs of them.
MEMBERS, TOGETHER, PAIRS_AT_ONCE = 2048, 4 << 20, 1 << 16
#: Shorter lines are hashed less each byte.
SHORT = 18
_LANES = np.array([[x >> b & 1 for b in range(8)] for x in range(256)], np.uint8).view("<u8").ravel()


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and end of each line; an empty document has one line."""
    brk = np.flatnonzero(data == 10)
    starts = np.concatenate([offs[:-1], brk + 1])
    own = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, brk, "right") - 1])
    order = np.lexsort((starts, own))
    starts, own = starts[order], own[order]
    first = np.searchsorted(own, np.arange(len(offs) - 1))
    ends = np.append(starts[1:] - 1, offs[-1])
    last = np.append(first[1:], len(own)) - 1
    ends[last] = offs[1:]
    return own, np.arange(len(own)) - first[own], starts, ends


def lines(data: np.ndarray, offs: np.ndarray):
    """For each line with words: document, number and node hash; and all words (hashes, starts, ends, counts before lines, lower-cased bytes)."""
    data = T.LOWER[data]
    own, number, ls, _ = line_spans(data, offs)
    starts, ends, _ = T.spans(data, np.append(ls, len(data)), T.ALNUM)
    words = T.span_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, np.append(ls, len(data)))
    full = np.diff(bounds) > 0
    own, number = own[full], number[full]
    bounds = np.append(bounds[:-1][full], len(words))
    return own, number, sequence_hash(words, bounds), words, starts, ends, bounds, data


def sequence_hash(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each run of words, in order."""
    up, down = T._powers(len(words) + 1, False), T._powers(len(words) + 1, True)
    total = np.zeros(len(words) + 1, T.U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return T.mix((total[bounds[1:]] - total[bounds[:-1]]) * down[bounds[:-1]] + np.diff(bounds).astype(T.U))


def simhash(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Majority bits of the hashes of each run of one word at least; a tie is 0."""
    if len(bounds) < 2:
        return np.zeros(0, T.U)
    size = np.diff(bounds)
    parts = -(-size // 255)  # eight counters in a word of 64 bits, of up to 255 each
    line = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = bounds[:-1][line] + nth * 255
    heads = np.cumsum(parts) - parts
    out = np.zeros(len(size), T.U)
    raw = words.astype("<u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[raw[:, byte]], cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), heads, axis=0)
        bits = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").ravel()
        out |= bits.astype(T.U) << T.U(8 * byte)
    return out


def _distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = T.order_by_owner(owner, key)
    owner, key = owner[order], key[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[keep], key[keep]


def blocks(flat: np.ndarray, offs: np.ndarray, keep: int = BLOCKS, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the kept SimHash blocks of normalised lines, best ordered by length; another turn keeps others."""
    size, n = np.diff(offs), len(offs) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, T.U)
    first = offs[:-1] + 2 * PAD * np.arange(n)  # where a line's leading blanks begin
    wide = np.full(int(offs[-1]) + 2 * PAD * n, 32, np.uint8)
    wide[np.arange(len(flat)) + np.repeat(2 * PAD * np.arange(n) + PAD, size)] = flat
    gram = wide.astype(T.U)
    for j in (1, 2, 4):  # two bytes, four, eight
        gram = gram[:-j] | (gram[j:] << T.U(8 * j))
    gram = T.mix(gram)
    owner, keys = [], []
    for step, least, most in WIDTHS:
        pick = np.flatnonzero((size >= least) & (size < most))
        count = size[pick] + 2 * PAD - GRAM - 2 * step + 1
        share = (np.minimum(1.0, keep / count) * float(1 << 32)).astype(np.int64)
        for lo, hi in _runs(pick):
            # neighbouring lines are taken together; blocks across their ends are left out
            a, b = first[pick[lo]], first[pick[hi - 1]] + size[pick[hi - 1]] + 2 * PAD
            g = gram[a : b - GRAM + 1]
            m = max(0, len(g) - 2 * step)
            x, y, z = g[:m], g[step : step + m], g[2 * step :][:m]
            sim = x if not step else (x & y) | ((x | y) & z)
            inside = np.zeros(b - a + 1, np.int64)
            inside[first[pick[lo:hi]] - a] += share[lo:hi]
            np.add.at(inside, first[pick[lo:hi]] - a + count[lo:hi], -share[lo:hi])
            rank = (sim * T.U(0xD6E8FEB86659FD93 + 2 * turn)) >> T.U(32)
            at = np.flatnonzero(rank < np.cumsum(inside)[:m].view(T.U))
            owner.append(pick[lo + np.searchsorted(first[pick[lo:hi]] - a, at, "right") - 1])
            keys.append(T.mix(sim[at] + T.U(step)))
    return _distinct(np.concatenate(owner), np.concatenate(keys)) if owner else (np.zeros(0, np.int64), np.zeros(0, T.U))


def _runs(pick: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers, as (first, after the last) places; short gaps break them too."""
    if not len(pick):
        return []
    cut = np.flatnonzero(np.diff(pick) > 1) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(pick)]))


def less_one(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of short normalised lines, whole and less each one of their bytes."""
    short = np.flatnonzero(np.diff(offs) < SHORT)
    if not len(short):
        return np.zeros(0, np.int64), np.zeros(0, T.U)
    size = np.diff(offs)[short]
    at = np.concatenate([[0], np.cumsum(size)])
    flat = flat[np.arange(at[-1]) + np.repeat(offs[short] - at[:-1], size)]
    up, down, table = T._powers(len(flat) + 1, False), T._powers(len(flat) + 1, True), T._symbols()
    total = np.zeros(len(flat) + 1, T.U)
    np.cumsum(table[flat] * up[: len(flat)], out=total[1:])
    line, place = T.owners(at), np.arange(len(flat))
    s, e = at[:-1][line], at[1:][line]
    less = (total[place] - total[s] + (total[e] - total[place + 1]) * down[1]) * down[s] + (size[line] - 1).astype(T.U)
    whole = (total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + size.astype(T.U)
    return _distinct(short[np.concatenate([line, np.arange(len(short))])], T.mix(np.concatenate([less, whole]) ^ T.U(0x5EED11E5)))


def flatten(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the picked lines (of one word at least), with one blank between words."""
    many = np.diff(bounds)[pick]
    sub = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    index = np.arange(sub[-1]) + np.repeat(bounds[pick] - sub[:-1], many)
    starts, sizes = starts[index], ends[index] - starts[index]
    before = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum())
    at = before + np.arange(len(sizes)) - np.repeat(np.arange(len(pick)), many)
    flat = np.full(int(sizes.sum() + len(sizes) - len(pick)), 32, np.uint8)
    flat[place + np.repeat(at - before, sizes)] = data[place + np.repeat(starts - before, sizes)]
    return flat, np.append(at, len(flat))[sub]


def _keys(keep: int, turn: int, flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, key = blocks(flat, offs, keep, turn)
    two, less = less_one(flat, offs) if turn == 0 else (one[:0], key[:0])
    return np.concatenate([one, two]), np.concatenate([key, less])


def _postings(keep: int):
    """Blocks of each line that a piece has, once."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in T.pieces(batch.column(0), PIECE):
                _, _, node, _, starts, ends, bounds, data = lines(data, offs)
                pick = np.unique(node, return_index=True)[1]
                size = np.add.reduceat(ends - starts, bounds[:-1]) + np.diff(bounds) if len(node) else pick
                pick = pick[np.argsort(size[pick])]  # lines of like length together
                line, key = _keys(keep, 0, *flatten(data, starts, ends, bounds, pick))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[pick[line]].view(np.int64))], ["key", "node"])

    return run


def _other_postings(keep: int, turn: int):
    """Other blocks of normalised lines."""

    def run(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(np.asarray(pa.compute.binary_length(batch.column(1))))))
            node = np.asarray(batch.column(0))
            for lo, _, flat, offs in T.pieces(batch.column(1), PIECE):
                line, key = _keys(keep, turn, flat, offs)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[lo + line])], ["key", "node"])

    return run


def _texts(wanted: bytes):
    """Each line with words; and its normalised text, once in a piece, if it may be wanted."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1), PIECE):
                own, number, node, _, starts, ends, bounds, data = lines(data, offs)
                if not len(own):
                    continue
                first = np.zeros(len(node), bool)
                first[np.unique(node, return_index=True)[1]] = True
                first &= maybe(wanted, node.view(np.int64))
                pick = np.flatnonzero(first)
                flat, at = flatten(data, starts, ends, bounds, pick)
                some = pa.LargeStringArray.from_buffers(len(pick), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())
                place = np.full(len(node), -1)
                place[pick] = np.arange(len(pick))
                norm = some.take(pa.array(place, mask=place < 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(own)), pa.array(number), pa.array(node.view(np.int64)), norm], ["doc_id", "line", "node", "norm"])

    return run


def _occurrences(batches):
    """Each line with words, and the SimHash and characters of the whole line."""
    for batch in batches:
        for lo, hi, data, offs in T.pieces(batch.column(1)):
            own, number, node, words, starts, ends, bounds, data = lines(data, offs)
            if not len(own):
                continue
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            chars = np.add.reduceat(lead[ends] - lead[starts], bounds[:-1]) + np.diff(bounds) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(own)), pa.array(number), pa.array(node.view(np.int64)), pa.array(simhash(words, bounds).view(np.int64)), pa.array(chars.astype(np.int32))], ["doc_id", "line", "node", "sim", "chars"])


def layout(nodes: int, radius: int = RADIUS) -> list[int]:
    """Bit masks: each pair within the radius agrees under one of them."""
    j = 1
    while 64 * j / (radius + j) < max(1, nodes).bit_length() + 2 and j < 6:
        j += 1
    edges = [64 * i // (radius + j) for i in range(radius + j + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, j)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def letter_pairs(texts: pa.Array) -> np.ndarray:
    """(PAIRS / 64, n): the set of each text's pairs of neighbouring characters, its ends being characters too, by a hash of PAIRS values."""
    code, at = T.code_points(texts)
    code = np.asarray(code).astype(T.U)
    own, full = T.owners(at), np.flatnonzero(np.diff(at))
    before = np.zeros(len(code), T.U)
    before[1:] = code[:-1]
    before[at[:-1][full]] = 0
    pair = np.concatenate([before << T.U(32) | code, code[at[1:][full] - 1] << T.U(32)])
    has = np.zeros((len(at) - 1, PAIRS), bool)
    has[np.concatenate([own, full]), (T.mix(pair) & T.U(PAIRS - 1)).astype(np.int64)] = True
    return np.packbits(has, axis=1, bitorder="little").view("<u8").T.astype(T.U)


def gram_cells(data: np.ndarray, offs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, CELLS / 8) bytes: the set of each text's grams that :func:`edits.promising` takes from it at most, by a hash of CELLS values;
    and how many cells it has in common, at least, with each promising text that is not longer.  size: characters of texts."""
    own, gram = edits.sampled(data, offs, np.minimum(1.0, edits.GRAMS / np.maximum(1, size)))
    own, gram = _distinct(own, gram >> T.U(20))
    has = np.zeros((len(size), CELLS), bool)
    has[own, (gram & T.U(CELLS - 1)).astype(np.int64)] = True
    taken = np.bincount(own, minlength=len(size))
    least = np.ceil(edits.LEAST_SHARE * taken).astype(np.int64) - (taken - has.sum(axis=1))
    return np.packbits(has, axis=1), least


def _sketches(batches):
    """SimHash of whole lines, SKETCH bits in longs, of some of their grams; and letter pairs of lines that can be alike to one of under 64 characters."""
    for batch in batches:
        for lo, hi, data, offs in T.pieces(batch.column(1), PIECE):
            size = np.asarray(batch.column(2))[lo:hi]
            own, gram = edits.sampled(data, offs, np.minimum(1.0, edits.GRAMS / np.maximum(1, np.diff(offs))))
            have, first = np.unique(own, return_index=True)
            bounds = np.append(first, len(own))
            out = np.zeros(((SKETCH + PAIRS) // 64, hi - lo), T.U)
            for k in range(len(_SKETCH)):
                out[k, have] = simhash(T.mix(gram + T.U(k)), bounds)
            few = size < 80
            out[len(_SKETCH) :, few] = letter_pairs(batch.column(1).slice(lo, hi - lo).filter(pa.array(few)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.array(x.view(np.int64)) for x in out)], ["node", "size", *_SKETCH, *_PAIRS])


def _words(cells: pa.Array) -> np.ndarray:
    """Rows of longs of binary values of CELLS bits."""
    _, offsets, data = cells.buffers()
    at = int(np.frombuffer(offsets, np.int32)[cells.offset]) if len(cells) else 0
    return np.frombuffer(data or b"", np.uint8)[at : at + len(cells) * CELLS // 8].view("<u8").reshape(-1, CELLS // 64)


def _may_share(batches):
    """The pairs (u, v) of batches (u, v, size, least and cells of both) whose cells leave it open that they share enough grams."""
    for batch in batches:
        m, n, x, y = (np.asarray(batch.column(k)) for k in range(2, 6))
        a, b = (_words(batch.column(k)) for k in (6, 7))
        enough = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64) >= np.where(m >= n, x, y)
        yield batch.select([0, 1]).filter(pa.array(enough | (np.maximum(m, n) < 64)))


def _sketched(text: DataFrame) -> DataFrame:
    """(node, size, ...) of lines (node, norm, size): what :func:`_close` reads."""
    kinds = [f"{x} long" for x in (*_SKETCH, *_PAIRS)]
    return text.select("node", "norm", "size").mapInArrow(_sketches, ", ".join(["node long", "size int", *kinds]))


def _whole(batches):
    """Tables of whole groups (key, part) out of rows in order of these; each of some rows or bytes, or of one group."""
    held, bytes_ = [], 0
    for batch in batches:
        held.append(batch)
        bytes_ += batch.nbytes
        if bytes_ < TOGETHER and sum(map(len, held)) < MEMBERS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, part = (np.asarray(table.column(k).chunk(0)) for k in (0, 1))
        at = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if key[0] != key[-1] or part[0] != part[-1] else 0
        if at:
            yield table.slice(0, at)
            # a copy, so that what went is not held on to
            held = table.slice(at).take(pa.array(np.arange(len(key) - at))).to_batches()
            bytes_ = sum(x.nbytes for x in held)
    if held and any(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _met(batches):
    """Pairs (u, v, a, b) of lines that can be alike, out of rows (key, part, own, node, comp, size, earlier, SimHash, letter pairs, norm) in order of key and part.

    Lines of one key and part meet, in the least of their common keys (earlier: lesser keys of the line).
    A part that stands for two (own is not the same in all rows) has the pairs across them only.
    """
    for table in _whole(batches):
        key, part, own, node, comp, size = (np.asarray(table.column(k).chunk(0)) for k in range(6))
        earlier, norm = table.column("earlier").chunk(0), table.column("norm").chunk(0)
        sim, pairs = (np.stack([np.asarray(table.column(x).chunk(0)).view(T.U) for x in names], axis=1) for names in (_SKETCH, _PAIRS))
        size = size.astype(np.int64)
        heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        many = np.diff(np.append(heads, len(key)))
        ends = np.repeat(np.append(heads[1:], len(key)), many)
        across = np.repeat(np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads), many)
        more = ends - np.arange(len(key)) - 1
        upto = np.cumsum(more)
        found, lo = [], 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            row, place, _ = edits._ranges(np.arange(lo, hi), more[lo:hi])
            i, j = lo + row, lo + row + 1 + place
            lo = hi
            most = np.maximum(size[i], size[j])
            keep = (comp[i] != comp[j]) & ~(across[i] & (own[i] == own[j])) & (5 * np.abs(size[i] - size[j]) <= most)
            i, j, most = i[keep], j[keep], most[keep]
            keep = most >= 64
            keep[keep] = np.bitwise_count(sim[i[keep]] ^ sim[j[keep]]).sum(axis=1, dtype=np.int64) <= FARTHEST
            short = np.flatnonzero(most < 64)
            x, y, edge = pairs[i[short]], pairs[j[short]], most[short] // 5 * 2
            keep[short] = np.all([np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) <= edge for p, q in ((x, y), (y, x))], axis=0)
            i, j = i[keep], j[keep]
            keep = ~_in_both(earlier, i, j)
            found.append((i[keep], j[keep]))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        if not len(i):
            continue
        some, which = np.unique(np.concatenate([i, j]), return_inverse=True)
        x, y = which[: len(i)], which[len(i) :]
        has, least = gram_cells(*T.buffers(norm.take(pa.array(some))), size[some])
        cells, least, ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CELLS // 8), len(some), [None, pa.py_buffer(has)]).cast(pa.binary()), least.astype(np.int32), pa.array(node)
        for k in range(0, len(i), 4096):
            cut = slice(k, k + 4096)
            sides = [pa.array(c[cut]) for c in (i, j)] + [pa.array(size[c[cut]]) for c in (i, j)] + [pa.array(least[c[cut]]) for c in (x, y)]
            left = next(_may_share([pa.RecordBatch.from_arrays([*sides, *(cells.take(pa.array(c[cut])) for c in (x, y))], list("uvmnxyab"))]))
            u, v = left.columns
            yield pa.RecordBatch.from_arrays([ids.take(u), ids.take(v), norm.take(u), norm.take(v)], list("uvab"))


def _in_both(lists: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the lists (longs) at i and at j have a value in common."""
    offs, values = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values).view(T.U)
    out = np.zeros(len(i), bool)
    sides = []
    for k in (i, j):
        row, _, at = edits._ranges(offs[k], offs[k + 1] - offs[k])
        sides.append((row, T.mix(T.mix(values[at]) + row.astype(T.U))))
    (row, one), (_, two) = sides
    out[row[np.isin(one, two)]] = True
    return out


def _together(rows: DataFrame, text: DataFrame, sketch: DataFrame, scratch: Scratch, passes: int) -> Iterator[DataFrame]:
    """Pairs (u, v) of lines that are alike among rows (key, node, size, comp, many, bytes) of one key and different comp, by passes over the keys.

    A bucket's lines, with their texts, come to one task, which compares them; no row is made for a pair that does not hold.
    Large buckets are cut in parts, and two parts at a time meet.
    """
    have = bitmap(rows.select("node"), rows.count())
    parts = F.ceil(F.greatest(F.col("many") / MEMBERS, F.col("bytes") / TOGETHER)).cast("int")
    keys = rows.select("node", "comp", F.struct("key", parts.alias("c")).alias("k")).groupBy("node").agg(F.first("comp").alias("comp"), F.sort_array(F.collect_list("k")).alias("keys"))
    some = text.select("node", "norm").mapInArrow(_wanted(have), "node long, norm string")
    line = scratch.table(keys.join(sketch, "node").join(some, "node"))
    each = line.select("*", F.posexplode("keys").alias("nth", "k"))
    for k in range(passes):
        full = each.where(F.pmod(F.xxhash64("k.key"), F.lit(passes)) == k)
        full = full.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k.c")).cast("int")).withColumn("earlier", F.transform(F.slice("keys", F.lit(1), F.col("nth")), lambda x: x["key"]))
        meets = F.transform(F.sequence(F.lit(0), F.col("k.c") - 1), lambda q: F.least(q, F.col("own")) * F.col("k.c") + F.greatest(q, F.col("own")))
        full = full.select(F.col("k.key").alias("key"), F.explode(meets).alias("part"), "own", "node", "comp", "size", "earlier", *_SKETCH, *_PAIRS, "norm")
        near = full.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "part").sortWithinPartitions("key", "part")
        yield near.mapInArrow(lambda batches: edits.verified(_met(batches)), "u long, v long")
    scratch.drop(line)


def _wanted(have: bytes):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe(have, np.asarray(batch.column(0)))))

    return run


def _close(a: str, b: str):
    """Whether two lines can be alike, by columns that begin with a and b.

    Lines of 64 characters on: whole SimHashes are near enough.  Shorter ones: each lacks no more letter pairs of the other than
    edits of a fifth of the characters take away, at two an edit.
    """
    count = lambda each: sum(each[1:], each[0])
    both = lambda names, f: count([F.bit_count(f(F.col(f"{a}{x}"), F.col(f"{b}{x}"))) for x in names])
    size = F.greatest(f"{a}size", f"{b}size")
    most = F.floor(size / 5) * 2
    short = (both(_PAIRS, lambda x, y: x.bitwiseAND(F.bitwise_not(y))) <= most) & (both(_PAIRS, lambda x, y: y.bitwiseAND(F.bitwise_not(x))) <= most)
    long = both(_SKETCH, lambda x, y: x.bitwiseXOR(y)) <= FARTHEST
    return F.when(size < 64, short).otherwise(long)


def _alike(pairs: DataFrame, text: DataFrame, scratch: Scratch, sketches: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) of lines (node, norm) whose edit distance is a fifth of the longer one at most.

    sketches: pairs that cannot be alike by these are left out before any text is sent.
    """
    if sketches is not None:
        side = lambda n, s: sketches.select(F.col("node").alias(n), *(F.col(x).alias(f"{s}{x}") for x in ("size", *_SKETCH, *_PAIRS)))
        pairs = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where(_close("a", "b")).select("u", "v")
        pairs, count = scratch.counted(pairs)
        have = bitmap(pairs.select(F.explode(F.array("u", "v")).alias("node")), 2 * count)
        text = text.select("node", "norm").mapInArrow(_wanted(have), "node long, norm string")
    full = pairs.join(text.select(F.col("node").alias("u"), F.col("norm").alias("a")), "u").join(text.select(F.col("node").alias("v"), F.col("norm").alias("b")), "v")
    return full.select("u", "v", "a", "b").mapInArrow(edits.verified, "u long, v long")


def _by_blocks(docs: DataFrame, scratch: Scratch, keep: int) -> tuple[DataFrame, DataFrame | None]:
    """Lines (doc_id, line, node), and their groups (node, comp) by SimHash blocks."""
    held: dict[str, DataFrame] = {}

    def verify(nodes: DataFrame):
        nodes, count = scratch.counted(nodes)
        every = scratch.table(docs.mapInArrow(_texts(bitmap(nodes, count)), "doc_id long, line long, node long, norm string"))
        held["seen"] = scratch.table(every.select("doc_id", "line", "node"))
        held["text"] = text = scratch.table(every.where("norm is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("norm").alias("norm")).withColumn("size", F.length("norm")))
        scratch.drop(every)
        scratch.drop(nodes)
        held["sketch"] = sketch = scratch.table(_sketched(text))
        return sketch, lambda pairs: _alike(pairs, text, scratch, sketch)

    def near(a, b):
        return 5 * F.abs(a - b) <= F.greatest(a, b)

    def again(nodes: DataFrame, turn: int) -> DataFrame:
        return held["text"].join(nodes, "node", "left_semi").select("node", "norm").mapInArrow(_other_postings(keep, turn), "key long, node long")

    first = docs.select("text").mapInArrow(_postings(keep), "key long, node long")
    comp = gather(first.repartition(F.col("key")).dropDuplicates(["key", "node"]), again, verify, near, scratch, lambda rows, passes: _together(rows, held["text"], held["sketch"], scratch, passes))
    scratch.drop(held["text"])
    scratch.drop(held["sketch"])
    return held["seen"], comp


def _by_simhash(docs: DataFrame, scratch: Scratch, radius: int) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, line, node), and their groups (node, comp) by the SimHash of whole lines."""
    seen = scratch.table(docs.mapInArrow(_occurrences, "doc_id long, line long, node long, sim long, chars int"))
    nodes = scratch.table(seen.select("node", "sim", "chars").distinct())
    keys = F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("sim").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(layout(nodes.count(), radius)))))

    def near(a: str, b: str):
        close = F.bit_count(F.col(f"{a}.sim").bitwiseXOR(F.col(f"{b}.sim"))) <= radius
        return close & (5 * F.abs(F.col(f"{a}.chars") - F.col(f"{b}.chars")) <= F.greatest(f"{a}.chars", f"{b}.chars"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs, count = scratch.counted(pairs)
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node"))
        every = docs.mapInArrow(_texts(bitmap(ends, 2 * count)), "doc_id long, line long, node long, norm string").where("norm is not null")
        return _alike(pairs, scratch.table(every.join(ends.distinct(), "node", "left_semi").groupBy("node").agg(F.first("norm").alias("norm"))), scratch)

    return seen, connect(nodes.select(keys.alias("key"), "node", "sim", "chars"), near, verify, scratch, rounds=1)


def removals(docs: DataFrame, scratch: Scratch, keep: int = BLOCKS, radius: int | None = None) -> DataFrame:
    """(doc_id, lines): numbers of the lines that go from each document that loses some."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    seen, comp = _by_blocks(docs, scratch, keep) if radius is None else _by_simhash(docs, scratch, radius)
    # occurrences of a line, then lines of a group, are aggregated before anything is joined
    place = F.struct("doc_id", "line")
    nodes = seen.groupBy("node").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    if comp is None:
        many = nodes.where("first <> last").select("node", F.col("first").alias("keep"))
    else:
        named = scratch.table(nodes.join(comp, "node", "left").where("comp is not null or first <> last"))
        kept = named.where("comp is not null").groupBy("comp").agg(F.min("first").alias("keep"))
        many = named.join(kept, "comp", "left").select("node", F.coalesce("keep", "first").alias("keep"), "first", "last").where("keep <> first or first <> last").select("node", "keep")
    gone = seen.join(many, "node").where("doc_id <> keep.doc_id or line <> keep.line")
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def _without(at: int, gone: int, names: list[str]):
    def run(batches):
        for batch in batches:
            text, lost = batch.column(at), batch.column(gone)
            touched = np.flatnonzero(np.asarray(lost.is_valid()) & np.asarray(text.is_valid()))
            n_lines = np.asarray(pa.compute.add(pa.compute.count_substring(text.fill_null(""), "\n"), 1)).astype(np.int64)
            n_gone = np.zeros(len(text), np.int64)
            if len(touched):
                whole = text.to_pylist()
                for i in touched.tolist():
                    drop = set(lost[i].as_py())
                    kept = [x for k, x in enumerate(whole[i].split("\n")) if k not in drop]
                    n_gone[i] = n_lines[i] - len(kept)
                    whole[i] = "\n".join(kept)
                text = pa.array(whole, pa.string())
            columns = [text if i == at else batch.column(i) for i in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_gone)], names)

    return run


def _with_counts(docs: DataFrame, scratch: Scratch, keep: int, radius: int | None, counts: list[str]) -> DataFrame:
    """docs with lines removed from text, and two more columns: lines before, and removed."""
    mark = uuid.uuid4().hex  # no column of the input has these names
    gone = scratch.table(removals(docs, scratch, keep, radius).withColumnsRenamed({"doc_id": f"id_{mark}", "lines": f"gone_{mark}"}))
    both = docs.join(gone, docs["doc_id"] == gone[f"id_{mark}"], "left").drop(f"id_{mark}")
    names = [*docs.columns, *counts]
    schema = ST.StructType([*docs.schema.fields, *(ST.StructField(x, ST.LongType()) for x in counts)])
    return both.mapInArrow(_without(names.index("text"), len(docs.columns), names), schema)


def dedup(docs: DataFrame, keep: int = BLOCKS, radius: int | None = None) -> DataFrame:
    """docs with lines removed from text, and n_lines (before) and n_removed (long).

    radius: lines meet by whole SimHashes within so many bits, not by blocks.
    """
    bounded_batches(docs.sparkSession)
    counts = ["n_lines", "n_removed"]
    return _with_counts(docs.drop(*counts), Scratch(docs.sparkSession, "linededup"), keep, radius, counts)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with lines removed from text, less the documents that lose all their words; columns as before."""
    bounded_batches(docs.sparkSession)
    counts = [f"{x}_{uuid.uuid4().hex}" for x in ("lines", "removed")]
    out = _with_counts(docs, Scratch(docs.sparkSession, "linededup"), BLOCKS, None, counts)
    return out.where((F.col(counts[1]) == 0) | (F.trim("text") != "")).drop(*counts)
