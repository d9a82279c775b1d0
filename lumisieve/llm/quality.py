"""Quality rules: base rules, then robust multivariate outliers.

Every document gets counts (words, symbols, repeated lines and words), and a vector of
transformed ratios.  Among documents that pass the base rules, location and scatter are
estimated by the minimum covariance determinant for each (language, source) group, each
language, and all documents: concentration steps from two deterministic starts (median and
MAD; plain mean and covariance; after Hubert, Rousseeuw and Verdonck 2012) until the
determinant settles, the better start kept; then the consistency factor, up or down, on
the coordinates that vary, and one reweighting step.  A group's estimate is shrunk towards
its language's, and that towards all documents', by n / (n + SHRINK) at every size, so no
group changes its rule when it grows.

A step is two aggregations over all documents - a quantile of distances, then moments of
the nearer half - pre-aggregated before the shuffle, so a hot group is never gathered.
Estimates are tables with one row a group, never collected: broadcast up to
BROADCAST_GROUPS rows, else joined by group and salt.

Mean word length and capitals of a short text scatter more, by chance, than a long one's:
both are drawn towards the language's median as if each text had STEADY more typical words.

Documents beyond the chi-squared cut-off of their group's distance are rejected.

Edge cases: null or empty text has no words and fails the base rules; a null language or
source is a group like any other, and no other group's; FLOOR stands in for a coordinate's
spread only where the data's own is smaller, so copies cannot make a clean document an
outlier; one repeated line, one repeated window or one number does not count at all;
quantiles are within 1 in 10 000 of their rank, so a document at the very cut-off may
depend on the partitioning; repeated rows count as often as they occur; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as T
from .linededup import line_spans
from .scratch import Scratch, bounded_batches

WINDOW = 8
SYMBOLS = T.byte_class(list(b"#*$%&|<>"))
VECTOR = ("word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits")
#: Documents that the estimate above a group (its language's, or all documents') counts for.
SHRINK = 30
#: Estimates that are broadcast at most, of about 400 bytes each.
BROADCAST_GROUPS = 20_000
SALTS = 32
#: Least spread of each coordinate (after the transforms), where the data's own is smaller.
FLOOR = (0.02, 0.05, 0.1, 0.09, 0.01, 0.08)
#: What does not count: a line's first repeat, the words of one repeated window, the digits of one number.
SPARED_LINES, SPARED_WORDS, SPARED_DIGITS = 1, 2 * WINDOW, 16
#: Typical words that a text's word length and capitals are averaged with.
STEADY, STEADIED = 100, ("word_length", "upper")
#: Tail probability of the cut-off under the normal model, and of the reweighting step's.
TAIL, REWEIGHT_TAIL = 1e-3, 0.025
STEPS = 8
_UPPER = T.byte_class(range(65, 91))
_DIGIT = T.byte_class(range(48, 58))


def counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document."""
    starts, ends, bounds = T.spans(data, offs, T.NOT_SPACE)
    hashes = T.span_hashes(data, starts, ends)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    docs = np.arange(len(offs) - 1)
    # words inside 8-word windows that occur twice or more in the text
    at, key = T.windows(hashes, bounds, WINDOW)
    own = np.searchsorted(bounds, at, "right") - 1
    order = T.order_by_owner(own, key)
    k, o = key[order], own[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = np.append(same, False) | np.append(False, same) if len(k) else np.zeros(0, bool)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[order][twice], 1)
    np.add.at(cover, at[order][twice] + WINDOW, -1)
    # lines with a word that equal an earlier line
    lo, _, ls, le = line_spans(data, offs)
    inside = np.searchsorted(starts, np.stack([ls, le]))
    full = inside[1] > inside[0]
    lo, lh = lo[full], T.span_hashes(data, ls[full], le[full])
    order = T.order_by_owner(lo, lh)
    again = (lh[order][1:] == lh[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    return {
        "n_words": np.diff(bounds),
        "word_chars": T.sums(lead[ends] - lead[starts], bounds),
        "n_symbols": T.sums(SYMBOLS[data], offs),
        "n_dup_lines": np.bincount(lo[order][1:][again], minlength=len(docs)),
        "n_repeat_words": T.sums(np.cumsum(cover[:-1]) > 0, bounds),
        "n_lines": np.bincount(lo, minlength=len(docs)),
        "n_upper": T.sums(_UPPER[data], offs),
        "n_digits": T.sums(_DIGIT[data], offs),
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed ratios: a logarithm of the mean word length, and square roots of shares (which steady their variance)."""
    words, chars, rows = (np.maximum(1, c[x]) for x in ("n_words", "word_chars", "n_lines"))
    beyond = lambda x, spared: np.maximum(0, c[x] - spared)
    shares = [c["n_symbols"] / chars, beyond("n_dup_lines", SPARED_LINES) / rows, beyond("n_repeat_words", SPARED_WORDS) / words, c["n_upper"] / chars, beyond("n_digits", SPARED_DIGITS) / chars]
    return np.column_stack([np.log(np.maximum(1, c["word_chars"]) / words), *map(np.sqrt, shares)])


def _measure(batches):
    for batch in batches:
        for lo, hi, data, offs in T.pieces(batch.column(1)):
            c = counts(data, offs)
            v = vectors(c)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)), *(pa.array(c[x].astype(np.int64)) for x in _LONGS), *(pa.array(np.ascontiguousarray(v[:, i])) for i in range(v.shape[1]))], ["doc_id", "lang", "source", *_LONGS, *VECTOR])


def chi2_tail(x: float, df: int) -> float:
    """The probability that a chi-squared variable exceeds x (recurrence over df)."""
    k = 1 if df % 2 else 2
    out = math.erfc(math.sqrt(x / 2)) if k == 1 else math.exp(-x / 2)
    for j in range(k, df, 2):
        out += (x / 2) ** (j / 2) * math.exp(-x / 2) / math.gamma(j / 2 + 1)
    return out


def chi2_quantile(tail: float, df: int) -> float:
    """The value that a chi-squared variable exceeds with this probability (bisection)."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, df) > tail else (lo, mid)
    return hi


P = len(VECTOR)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_ROW, _COL = (np.array(x) for x in zip(*_PAIRS))
#: An estimate: group, start, documents, mean, covariance and inverse (upper triangles), log determinant, unsettled.
_STATE = "g long, s int, n long, m array<double>, c array<double>, q array<double>, det double, live boolean"


def _matrices(triangles: np.ndarray) -> np.ndarray:
    out = np.zeros((len(triangles), P, P))
    out[:, _ROW, _COL] = out[:, _COL, _ROW] = triangles
    return out


def _floored(cov: np.ndarray) -> np.ndarray:
    """Covariances whose variances reach the floor, with a little more on the diagonal against dependent coordinates."""
    var = np.diagonal(cov, axis1=1, axis2=2)
    more = np.maximum(0, np.square(FLOOR) - var) + 1e-3 * var
    return cov + more[:, :, None] * np.eye(P)


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(_floored(cov))[:, _ROW, _COL]


def _varying(cov: np.ndarray) -> np.ndarray:
    return np.diagonal(cov, axis1=1, axis2=2) > 1e-8


def _inverse_varying(cov: np.ndarray) -> np.ndarray:
    """Inverses over the coordinates that vary at all, zero elsewhere."""
    live = _varying(cov)
    var = np.diagonal(cov, axis1=1, axis2=2)
    safe = cov * (live[:, :, None] & live[:, None, :]) + np.where(live, 1e-3 * var, 1.0)[:, :, None] * np.eye(P)
    return (np.linalg.inv(safe) * (live[:, :, None] & live[:, None, :]))[:, _ROW, _COL]


def _rows_of(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def _state(batches):
    """g, s, n, m, c, old det, live (c: new covariances) to estimates; settled where the determinant stays."""
    for b in batches:
        if not b.num_rows:
            continue
        cov, old = _matrices(_rows_of(b.column("c"))), np.asarray(b.column("det"))
        det = np.linalg.slogdet(_floored(cov))[1]
        live = np.asarray(b.column("live").to_numpy(zero_copy_only=False)) & (old - det >= 1e-3)
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("g", "s", "n", "m", "c")), _lists(_inverse(cov)), pa.array(det), pa.array(live)], ["g", "s", "n", "m", "c", "q", "det", "live"])


def _consistent(batches):
    """g, n, m, c, h (median distance over the coordinates that vary) to g, n, m, c, q with the consistency factor."""
    medians = np.array([1.0, *(chi2_quantile(0.5, k) for k in range(1, P + 1))])
    for b in batches:
        if not b.num_rows:
            continue
        cov = _matrices(_rows_of(b.column("c")))
        k = _varying(cov).sum(axis=1)
        factor = np.where(k > 0, np.asarray(b.column("h")) / medians[k], 1.0)
        cov = cov * factor[:, None, None]
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("n"), b.column("m"), _lists(cov[:, _ROW, _COL]), _lists(_inverse(cov))], ["g", "n", "m", "c", "q"])


def _inverted(inverse):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("g", "n", "m", "c")), _lists(inverse(_matrices(_rows_of(b.column("c")))))], ["g", "n", "m", "c", "q"])

    return run


_FIT = "g long, n long, m array<double>, c array<double>, q array<double>"


def _distance() -> F.Column:
    """Mahalanobis distance (squared) from columns m and q."""
    d = [F.col(x) - F.col("m")[i] for i, x in enumerate(VECTOR)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        out = out + d[i] * d[j] * F.col("q")[k] * (1.0 if i == j else 2.0)
    return out


def _moments(df: DataFrame, *by: str) -> DataFrame:
    """Count n, mean m and covariance c of each group, by one aggregation."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"a{i}") for i, x in enumerate(VECTOR)), *(F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{k}") for k, (i, j) in enumerate(_PAIRS))]
    return df.groupBy(*by).agg(*aggs).select(*by, "n", F.array(*(f"a{i}" for i in range(P))).alias("m"), F.array(*(f"c{k}" for k in range(len(_PAIRS)))).alias("c"))


def _median(x) -> F.Column:
    return F.percentile_approx(x, 0.5, 10000)


def _beside(rows: DataFrame, fits: DataFrame, groups: int, *by: str, how: str = "inner") -> DataFrame:
    """Rows with their group's estimate: broadcast where the table is small, else by group and salt, so no group is one task's."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(fits), list(by), how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*VECTOR), F.lit(SALTS)).cast("int"))
    copies = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*by, "salt"], how).drop("salt")


def mcd(rows: DataFrame, scratch: Scratch, steps: int = STEPS) -> tuple[DataFrame, int]:
    """(g, n, m, c) of each group g of rows (VECTOR columns): size, location and scatter; and the number of groups."""
    small = lambda df: scratch.table(df, tidy=False)
    plain, groups = scratch.counted(_moments(rows, "g"), tidy=False)
    centre = small(rows.groupBy("g").agg(F.array(*(_median(x) for x in VECTOR)).alias("m")))
    off = _beside(rows, centre, groups, "g").groupBy("g").agg(F.array(*(_median(F.abs(F.col(x) - F.col("m")[i])) for i, x in enumerate(VECTOR))).alias("mad"))
    diagonal = F.array(*((F.pow(1.4826 * F.col("mad")[i], F.lit(2.0)) if i == j else F.lit(0.0)) for i, j in _PAIRS))
    robust = plain.select("g", "n").join(centre, "g").join(off, "g").select("g", F.lit(0).alias("s"), "n", "m", diagonal.alias("c"))
    begin = robust.unionByName(plain.select("g", F.lit(1).alias("s"), "n", "m", "c"))
    state = small(begin.select("*", F.lit(1e300).alias("det"), F.lit(True).alias("live")).mapInArrow(_state, _STATE))
    both = rows.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        live = state.where("live").select("g", "s", "m", "q")
        if live.isEmpty():
            break
        limit = small(_beside(both, live, 2 * groups, "g", "s").groupBy("g", "s").agg(_median(_distance()).alias("h")))
        near = _beside(both, live.join(limit, ["g", "s"]), 2 * groups, "g", "s").where(_distance() <= F.col("h"))
        new = _moments(near, "g", "s").select("g", "s", F.col("m").alias("m2"), F.col("c").alias("c2"))
        after = state.join(new, ["g", "s"], "left")
        state = small(after.select("g", "s", "n", F.coalesce("m2", "m").alias("m"), F.coalesce("c2", "c").alias("c"), "det", "live").mapInArrow(_state, _STATE))
    best = state.groupBy("g").agg(F.min(F.struct("det", "s", "n", "m", "c")).alias("x")).select("g", "x.n", "x.m", "x.c")
    best = small(best.mapInArrow(_inverted(_inverse_varying), _FIT))
    typical = _beside(rows, best.select("g", "m", "q"), groups, "g").groupBy("g").agg(_median(_distance()).alias("h"))
    fits = small(best.drop("q").join(typical, "g").select("g", "n", "m", "c", "h").mapInArrow(_consistent, _FIT))
    # moments of what is no outlier; the factor makes up for the tail that is cut
    cut = chi2_quantile(REWEIGHT_TAIL, P)
    factor = (1 - REWEIGHT_TAIL) / (1 - chi2_tail(cut, P + 2))
    inner = _moments(_beside(rows, fits.select("g", "m", "q"), groups, "g").where(_distance() <= cut), "g")
    inner = inner.select("g", F.col("m").alias("m2"), F.transform("c", lambda x: x * factor).alias("c2"))
    return small(fits.join(inner, "g", "left").select("g", "n", F.coalesce("m2", "m").alias("m"), F.coalesce("c2", "c").alias("c"))), groups


def _shrunk(fits: DataFrame, above: DataFrame, weight: float = SHRINK) -> DataFrame:
    """Estimates (g, up, n, m, c) drawn towards those of their group above (up, m, c), the more the smaller they are."""
    far = above.select(F.col("g").alias("up"), F.col("m").alias("um"), F.col("c").alias("uc"))
    own = F.col("n") / (F.col("n") + weight)
    mix = lambda x, y: F.zip_with(x, y, lambda a, b: own * a + (1 - own) * b)
    return fits.join(far, "up").select("g", "n", mix("m", "um").alias("m"), mix("c", "uc").alias("c"))


def _key(level: str, *columns: str) -> F.Column:
    return F.xxhash64(F.lit(level), *(y for x in columns for y in (F.col(x).isNull(), F.col(x))))


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept and distance (null where none was taken).

    docs: doc_id (long), text, lang, source.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "quality")
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in _LONGS) + ", " + ", ".join(f"{x} double" for x in VECTOR)
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).mapInArrow(_measure, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    levels = {"g": _key("source", "lang", "source"), "of_lang": _key("lang", "lang"), "of_all": _key("all")}
    rows = scratch.table(measured.withColumns({"base_failed": failed, **levels}).drop("lang", "source"))
    typical, langs = scratch.counted(rows.where("not base_failed").groupBy("of_lang").agg(*(_median(x).alias(f"typical_{x}") for x in STEADIED)), tidy=False)
    near = F.col("n_words") / (F.col("n_words") + STEADY)
    steadied = {x: F.col(f"typical_{x}") + (F.col(x) - F.col(f"typical_{x}")) * near for x in STEADIED}
    known = {x: F.coalesce(y, F.col(x)) for x, y in steadied.items()}
    raw, rows = rows, scratch.table(_beside(rows, typical, langs, "of_lang", how="left").withColumns(known).drop(*(f"typical_{x}" for x in STEADIED)))
    scratch.drop(raw)
    good = rows.where("not base_failed")
    fits, groups = mcd(good.select(F.explode(F.array(*levels)).alias("g"), *VECTOR), scratch)
    above = good.select(*levels).distinct()
    langs = _shrunk(fits.join(above.select(F.col("of_lang").alias("g"), F.col("of_all").alias("up")).distinct(), "g"), fits)
    final = _shrunk(fits.join(above.select("g", F.col("of_lang").alias("up")), "g"), langs)
    final = scratch.table(final.mapInArrow(_inverted(_inverse), _FIT), tidy=False)
    far = _beside(rows, final.select("g", "m", "q"), groups, "g", how="left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(tail, P), F.lit(False))
    return far.select("doc_id", *_LONGS, "base_failed", kept.alias("kept"), "distance")
