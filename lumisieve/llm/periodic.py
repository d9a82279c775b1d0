"""Periodic runs: stretches of words that repeat with a period, found by matching aligned blocks.

1. Words of a document are numbers.  A run of period q has at least max(12, 2 q) words, so
   each of its words lies in a six-word window that occurs twice: only stretches of such
   words are searched (an exact filter; most texts end here).
2. At scale B = 2, 4, 8, ... the aligned blocks of B words of a stretch are the keys (integer
   sequences) of an Aho-Corasick automaton that is run over the stretch.  A run of period q
   from 2 B - 1 to 4 B - 2 (1 to 6 at the first scale) keeps at least 2 B - 1 words before its
   last period, hence a whole aligned block whose copy stands q words later: occurrences at
   those distances are the seeds.
3. A seed is extended to both sides, word by word, as far as words q apart agree.  Periods
   come in ascending order, so a stretch that was found under a smaller period is known, and
   seeds inside a run whose period divides q are its own repetition and are passed over.

The result is every maximal run, exactly.  Nothing is shuffled: a document is searched where it
is read, and its automata hold one scale at a time, at most one node for each word.

Edge cases: null or empty texts have no words and no runs; rows with a null doc_id are searched
like others (and never altered by :func:`digest`); repeated rows each get a row; of runs of equal
length the one with the smaller start, then period, is named; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as T
from .scratch import bounded_batches

#: A run has at least so many words, and two periods.
LEAST = 12
#: Words of the windows that must occur twice in a run: a run keeps LEAST / 2 words at least before its last period.
TWICE = LEAST // 2


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All (start, length, smallest period) of a sequence of numbers below 2**32, by start and period."""
    n, size, found = len(words), 2, {}
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run that goes farthest over each word
    text = tuple(words.tolist())
    while n >= LEAST:
        near, far = (1, 6) if size == 2 else (2 * size - 1, 4 * size - 2)
        if 2 * near > n:
            break
        at, step = _seeds(words, text, size, near, min(far, n // 2))
        cuts = np.flatnonzero(np.diff(step)) + 1
        for some, q in zip(np.split(at, cuts), step[np.r_[0, cuts]].tolist() if len(step) else []):
            some = some[(reach[some] < some + q) | (q % period[some] != 0)]
            done = -1
            for a in some.tolist():
                if a < done:
                    continue
                first, done = _extend(words, a, a + size, q)
                end = done + q
                if end - first >= max(LEAST, 2 * q) and (first, end) not in found:
                    found[first, end] = q
                    new = first + np.flatnonzero(reach[first:end] < end)
                    reach[new], period[new] = end, q
        size *= 2
    return sorted((first, end - first, q) for (first, end), q in found.items())


def _seeds(words: np.ndarray, text: tuple, size: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of aligned blocks that occur again at a distance from near to far, by distance and start."""
    n, known = len(words), {}
    named = np.array([known.setdefault(b, len(known)) for b in map(tuple, words[: n - n % size].reshape(-1, size).tolist())])
    search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for b, name in known.items():
        search.add_word(b, name)
    search.make_automaton()
    seen = np.full(n + 1, -1, np.int64)
    hits = np.array([(end, name) for end, name in search.iter(text)], np.int64).reshape(-1, 2)
    seen[hits[:, 0] - size + 1] = hits[:, 1]
    block = np.flatnonzero(np.bincount(hits[:, 1], minlength=len(known))[named] > 1)
    step = np.arange(near, far + 1)
    there = np.minimum(block[None, :] * size + step[:, None], n)
    q, b = np.nonzero(seen[there] == named[block][None, :])
    return block[b] * size, step[q]


def _extend(words: np.ndarray, lo: int, hi: int, q: int) -> tuple[int, int]:
    """The maximal stretch of places around lo to hi whose word is that of q places later."""
    last, step = len(words) - q, 64
    while hi < last:
        m = min(step, last - hi)
        bad = np.flatnonzero(words[hi : hi + m] != words[hi + q : hi + q + m])
        if len(bad):
            hi += int(bad[0])
            break
        hi, step = hi + m, 2 * step
    step = 64
    while lo > 0:
        m = min(step, lo)
        bad = np.flatnonzero(words[lo - m : lo] != words[lo - m + q : lo + q])
        if len(bad):
            lo -= m - 1 - int(bad[-1])
            break
        lo, step = lo - m, 2 * step
    return lo, hi


def stretches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches, inside documents, of words that lie in windows of TWICE words that occur twice there."""
    at, key = T.windows(hashes, bounds, TWICE)
    if not len(at):
        return at, at
    key = T.mix(key + T.owners(bounds)[at].astype(T.U) * T.U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.subtract.at(edge, at[twice] + TWICE, 1)
    inside = np.cumsum(edge[:-1]) > 0
    cut = np.zeros(len(hashes) + 1, bool)
    cut[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = hi - lo >= LEAST
    return lo[long], hi[long]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word of its text stands at each place of an altered document (a tenth of them); None for others."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g, i = h // 10, np.arange(n)
    a = g % n
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def _searched(batches, altered: bool) -> Iterator[tuple]:
    """(doc_id, word bytes, starts, ends, runs) of each row."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lo, hi, data, offs in T.pieces(batch.column(1)):
            starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
            hashes = T.span_hashes(data, starts, ends)
            if altered:
                for d in range(hi - lo):
                    if (place := planted(ids[lo + d], int(bounds[d + 1] - bounds[d]))) is not None:
                        for x in (starts, ends, hashes):
                            x[bounds[d] : bounds[d + 1]] = x[bounds[d] + place]
            runs: list[list] = [[] for _ in range(hi - lo)]
            first, last = stretches(hashes, bounds)
            for d, a, b in zip((np.searchsorted(bounds, first, "right") - 1).tolist(), first.tolist(), last.tolist()):
                base = a - int(bounds[d])
                runs[d] += [(s + base, n, q) for s, n, q in find_runs(np.unique(hashes[a:b], return_inverse=True)[1])]
            yield ids[lo:hi], data, starts, ends, bounds, runs


def _listed(batches):
    for ids, _, _, _, _, runs in _searched(batches, False):
        rows = [(i, *r) for i, found in zip(ids, runs) for r in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "length", "period"])


def _dropped(runs: list[list], bounds: np.ndarray) -> np.ndarray:
    """Words that a run holds after its first period."""
    edge = np.zeros(bounds[-1] + 1, np.int64)
    for base, found in zip(bounds.tolist(), runs):
        for s, n, q in found:
            edge[base + s + q] += 1
            edge[base + s + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def _digested(batches):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for ids, data, starts, ends, bounds, runs in _searched(batches, True):
        keep = np.flatnonzero(~_dropped(runs, bounds))
        text, first, last = T.joined(data, starts[keep], ends[keep], np.searchsorted(keep, bounds))
        most = [max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None) for found in runs]
        long = lambda values: pa.array(values, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                long(ids), long([len(found) for found in runs]), *(long([m[k] for m in most]) for k in range(3)), long([m[0] if m[0] is None else 1000 * m[1] // m[2] for m in most]),
                pa.array([sha("".join("%d,%d,%d\n" % r for r in found).encode()) for found in runs]), pa.array([sha(text[a:b]) for a, b in zip(first.tolist(), last.tolist())]),
            ],
            ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        )


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of the texts as they are."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_listed, "doc_id long, start long, length long, period long")


def _collapsed(batches):
    for ids, data, starts, ends, bounds, found in _searched(batches, False):
        keep = np.flatnonzero(~_dropped(found, bounds))
        text, first, last = T.joined(data, starts[keep], ends[keep], np.searchsorted(keep, bounds))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([text[a:b].tobytes().decode() for a, b in zip(first.tolist(), last.tolist())], pa.string())], ["doc_id", "text"])


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each run one period stays, and words are joined by one space (null text: empty)."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_collapsed, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, a tenth of which are altered by :func:`planted` first."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_digested, schema)
