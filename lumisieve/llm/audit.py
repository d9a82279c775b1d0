"""Filter interaction audit: what each filter removes after each set of others, in every order.

A document fails some of five filters: one of 32 masks.  It stands on each of the 80 edges
of the lattice of filter sets, from a set that was already applied to that set and the next
filter.  Masks are counted by part first, so what meets the 80 edges are at most 32 rows for
each part; their sums, one row for each part and edge, are joined to the 600 steps of the
120 orders, each of which is a path of five edges.

Edge cases: null text is empty; a null source is the part named by the empty string; rows with
a null doc_id are copies of nothing, make no copies, and have no labels; rows that repeat a
doc_id each count, and are not copies of each other; of several labels of a document
one that is 1 counts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: Filters by letter; a letter's place is its bit.
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """The mask of filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # one array of words serves both counts
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n["n"] < 200,
        100 * n["d"] < 50 * n["n"],
        100 * upper.cast("long") > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, good, toxic) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("same"))
    rows = scratch.table(rows)
    copies = rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    copies = scratch.table(copies)  # so that the join below can split a text with very many copies
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    marks = scratch.table(marks)
    no = F.lit(False)
    rows = rows.join(copies, "same", "left").select("doc_id", "part", F.when(F.col("doc_id") > F.col("least"), F.col("mask") + (1 << 4)).otherwise(F.col("mask")).alias("mask"))
    return rows.join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def edges(masks: DataFrame) -> DataFrame:
    """(part, applied, next, and the counts) of rows (part, mask, good, toxic): 80 for each part."""
    count = lambda c: F.sum(c.cast("long"))
    few = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))
    all_edges = [(s, f) for s in range(32) for f in range(5) if not s >> f & 1]
    rows = few.withColumn("e", F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in all_edges)))).select("*", "e.*")
    mask, bit = F.col("mask"), F.call_function("shiftleft", F.lit(1), F.col("next"))
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("applied")) != 0
    when = lambda c, n: F.sum(F.when(c, F.col(n)).otherwise(0))
    values = [when(~fails & ~gone, "n"), when(fails & ~gone, "n"), when(fails & gone, "n"), when(mask == bit, "n"), when(fails & ~gone, "good"), when(fails & ~gone, "toxic")]
    return rows.groupBy("part", "applied", "next").agg(*(v.alias(n) for v, n in zip(values, COUNTS)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    edge = scratch.table(edges(judged(docs, labels, scratch)))
    orders = lambda s: factorial(s) * factorial(4 - s)  # noqa: E731  that have a given set of s filters before a given filter
    times = F.element_at(F.array(*(F.lit(orders(s)) for s in range(5))), F.bit_count("applied") + 1)
    shapley = edge.groupBy("part", "next").agg(F.sum(F.col("removed") * times).alias("shapley"))
    steps = [("".join(p), k + 1, sum(1 << FILTERS.index(c) for c in p[:k]), FILTERS.index(p[k])) for p in permutations(FILTERS) for k in range(5)]
    paths = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, applied int, next int"))  # 600 rows
    return edge.join(shapley, ["part", "next"]).join(paths, ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100*len(list_distinct(ws)) < 50*len(ws) AS b, 100*length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2*length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2*b::INT + 4*c::INT + 8*d::INT + 16*e::INT AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(k, c) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
p AS (SELECT x1.c || x2.c || x3.c || x4.c || x5.c AS filter_order, [x1.k, x2.k, x3.k, x4.k, x5.k] AS ks FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.k, x2.k, x3.k, x4.k, x5.k])) = 5),
s AS (SELECT filter_order, step, (1 << ks[step]) AS bit, coalesce(list_sum(list_transform(ks[1:step-1], lambda k: 1 << k)), 0)::INT AS before FROM p, range(1, 6) r(step)),
o AS (SELECT part, filter_order, step::INT AS step, bit,
  sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM o"""
