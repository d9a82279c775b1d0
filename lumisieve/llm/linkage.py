"""Connected groups from buckets, without all pairs of a group.

Two nodes may be linked only if they share a bucket.  A group of m near copies
shares buckets m wide, and comparing all pairs in it would cost m*m; but once a
member is known to be connected, comparing it again is idle.  So:

1. buckets of at most SMALL members compare all pairs; of its larger buckets, each
   node is compared with PIVOTS members only, the least of all its buckets under so
   many orders; links are verified, and connected components are found;
2. buckets that still hold several components do this again with other pivots,
   until a round finds no link;
3. what is left - pairs in one bucket and in two components - is compared in
   full.

No link is lost, since every pair in a bucket is either compared or already in
one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

Verify = Callable[[DataFrame], DataFrame]
#: Members of a bucket whose pairs are all compared at once.
SMALL = 6
#: Nodes that each node is compared with in a turn.
PIVOTS = 6
#: Edges that one task groups in memory (16 bytes each); more are grouped by joins.
EDGES_IN_TASK = 400_000


def _union_find(table: pa.Table) -> pa.Table:
    above: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while above.setdefault(root, root) != root:
            root = above[root]
        while above[x] != root:
            above[x], x = root, above[x]
        return root

    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist()):
        a, b = top(u), top(v)
        above[max(a, b)] = min(a, b)
    nodes = list(above)
    return pa.table({"node": pa.array(nodes, pa.int64()), "comp": pa.array([top(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, scratch: Scratch, count: int) -> DataFrame:
    """(node, comp): the least node of each connected component, for nodes of ``count`` edges (u, v).

    Up to EDGES_IN_TASK edges one task is enough.  Beyond:
    Alternating large-star and small-star (Kiveris et al. 2014) over written tables; rounds
    grow with the logarithm of the component's size.  Stars are joined to minima that are
    aggregated before the shuffle, so a hub's rows stay splittable.
    """
    if count <= EDGES_IN_TASK:
        return edges.select("u", "v", F.lit(0).alias("k")).groupBy("k").applyInArrow(_union_find, "node long, comp long")
    now, held, mark = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), None, None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b"))))
        small = large.join(low, "u").select(ends.alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct()
        seen = Observation()
        after = scratch.table(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("h")))
        scratch.drop(held)
        now = held = after
        was, mark = mark, (seen.get["n"], seen.get["h"])
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _shared(many: DataFrame, near: Callable[[str, str], Column], enough: Callable[..., Column] | None) -> DataFrame:
    """Pairs of nodes in small buckets, with enough of them in common."""
    small = many.where(F.col("m") <= SMALL).select("key", "x")
    met = small.join(small.select("key", F.col("x").alias("y")), "key").where("x.node < y.node").where(near("x", "y"))
    if enough is None:
        return met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    # plain columns are aggregated, not structs: by hashing, in narrow rows
    more = [c for c in small.select("x.*").columns if c != "node"]
    each = met.groupBy(F.col("x.node").alias("u"), F.col("y.node").alias("v")).agg(F.count(F.lit(1)).alias("shared"), *(F.max(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in more))
    each = each.select("u", "v", "shared", *(F.struct(F.col(n).alias("node"), *(F.col(f"{s}_{c}").alias(c) for c in more)).alias(s) for s, n in (("x", "u"), ("y", "v"))))
    wide = lambda c: many.where(F.col("m") > SMALL).groupBy(F.col("x.node").alias(c)).agg(F.count(F.lit(1)).alias(f"{c}_large"))
    each = each.join(wide("u"), "u", "left").join(wide("v"), "v", "left")
    return each.where(enough(F.col("shared"), "x", "y", F.least(F.coalesce("u_large", F.lit(0)), F.coalesce("v_large", F.lit(0))))).select("u", "v")


def connect(postings: DataFrame, near: Callable[[str, str], Column], verify: Verify, scratch: Scratch, rounds: int = 2, enough: Callable[..., Column] | None = None, detail: DataFrame | None = None, close: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(node, comp) of all nodes that have a verified link.

    postings: ``key`` and ``node`` (long), and columns that ``near(a, b)``, a cheap necessary
    condition on two structs, reads.  verify: pairs (u, v) to those that hold.
    enough(shared, a, b, large): whether so many shared small buckets can be enough for a
    link of two structs, of which both may share up to ``large`` larger ones as well.
    detail: more columns of nodes (node, ...), which ``close(a, b)``, a sharper necessary condition, reads
    where the pairs that are left are compared in full.
    """
    rest = [c for c in postings.columns if c != "key"]
    wide = F.count(F.lit(1)).over(Window.partitionBy("key"))
    many, size = scratch.counted(postings.withColumn("m", wide).where("m > 1").select("key", "m", F.struct(*rest).alias("x"), F.col("node").alias("comp")))
    edges: DataFrame | None = None
    label: DataFrame | None = None
    left, turn, links, fresh = many, 0, 0, 1
    pair = lambda a, b: [F.least(f"{a}.node", f"{b}.node").alias("u"), F.greatest(f"{a}.node", f"{b}.node").alias("v")]
    crossed = lambda t: t.alias("s").join(t.select("key", F.col("x").alias("y"), F.col("comp").alias("other")), "key").where("comp < other").where((close or near)("x", "y")).select(*pair("x", "y"))
    more = [c for c in detail.columns if c != "node"] if detail is not None else []
    detailed = lambda t: t if detail is None else t.withColumn("node", F.col("x.node")).join(detail, "node").select("key", "comp", F.struct("x.*", *more).alias("x"))
    while size:
        last = turn > 0 and not fresh or turn >= rounds
        if last:
            pairs = crossed(scratch.table(detailed(left)))
        else:
            by = lambda c, k: F.xxhash64(F.col(c), F.lit(turn * PIVOTS + k))  # noqa: B023, E731
            large = left.where(F.col("m") > SMALL)
            pivot = large.groupBy("key").agg(*(F.min_by(F.struct("x", "comp"), by("x.node", k)).alias(f"p{k}") for k in range(PIVOTS)))
            ok = [(F.col("comp") != F.col(f"p{k}.comp")) & near("x", f"p{k}.x") for k in range(PIVOTS)]
            best = [F.min_by(F.when(ok[k], F.col(f"p{k}.x.node")), F.when(ok[k], by(f"p{k}.x.node", k))).alias(f"b{k}") for k in range(PIVOTS)]
            chosen = large.join(pivot, "key").groupBy(F.col("x.node").alias("node")).agg(*best)
            pairs = chosen.select("node", F.explode(F.array_distinct(F.array(*(f"b{k}" for k in range(PIVOTS))))).alias("b")).where("b is not null").select(F.least("node", "b").alias("u"), F.greatest("node", "b").alias("v"))
            if not turn:
                pairs = pairs.union(_shared(left, near, enough))
        found, fresh = scratch.counted(verify(pairs.distinct()))
        if fresh:
            links += fresh
            edges = found if edges is None else edges.union(found)
            scratch.drop(label)
            label = scratch.table(components(edges, scratch, links))
        if last:
            break
        # small buckets are settled by the first turn
        big = many.where(F.col("m") > SMALL)
        named = big.drop("comp").withColumn("node", F.col("x.node")).join(label, "node", "left").select("key", "m", "x", F.coalesce("comp", "node").alias("comp")) if label is not None else big
        several = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        after, size = scratch.counted(named.join(several, "key", "left_semi"))
        if turn:
            scratch.drop(left)
        left, turn = after, turn + 1
    if label is None:
        label = many.select(F.col("comp").alias("node"), "comp").where("false")
    return label


def _many(postings: DataFrame) -> DataFrame:
    """Postings of keys that several nodes have, with the width m of their bucket."""
    return postings.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("m > 1")


def gather(first: DataFrame, again: Callable[[DataFrame, int], DataFrame], verify: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]], near: Callable[[Column, Column], Column], scratch: Scratch, together: Callable[[DataFrame, int], Iterable[DataFrame]] | None = None, pivots: int = 2, turns: int = 2) -> DataFrame | None:
    """(node, comp) of nodes that have a verified link; None if there is no link.

    In each turn, buckets of at most SMALL members compare all pairs, and in larger ones each
    node meets ``pivots`` members.  Nodes of large buckets that still hold several components
    come to other buckets in the next turn: again(nodes, turn) gives their postings.  What is
    left after a turn's pivots - pairs in one large bucket and in two components - is
    compared in full after the last turn, so every pair that shares a bucket is compared or
    in one component.

    first, again: postings (key, node), no pair of which occurs twice.  verify: given the nodes
    that share a bucket, their sizes (node, size), and a function from pairs (u, v) to those that hold.
    near(a, b): a necessary condition on two sizes.  together(rows, passes): pairs (u, v) that hold among rows
    (key, node, size, comp, many, bytes) of one key and different comp; many, bytes: rows and sizes of the key.
    Buckets come there in passes, each of about as much as all nodes have, however many buckets a node is in.  Without
    it, the pairs of those rows are joined and verified as the others are.
    """
    posts, sizes, check, label, edges, links = first, None, None, None, None, 0
    kept: list[DataFrame] = []

    def learn(held: DataFrame) -> None:
        nonlocal edges, links, label
        found, fresh = scratch.counted(held)
        if fresh:
            links += fresh
            edges = found if edges is None else edges.union(found)
            before, label = label, scratch.table(components(edges, scratch, links))
            scratch.drop(before)

    def several(wide: DataFrame) -> DataFrame:
        """Rows (key, node, size, comp) of the buckets that hold several components, with rows and sizes of these."""
        named = wide.withColumn("comp", F.col("node")) if label is None else wide.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("many"), F.sum("size").alias("bytes")).where("lo <> hi")
        return named.join(keys, "key").select("key", "node", "size", "comp", "many", "bytes")

    def joined(rows: DataFrame) -> DataFrame:
        """The different pairs (u, v) of rows of one key and different comp."""
        other = rows.select("key", F.col("node").alias("v"), F.col("comp").alias("other"), F.col("size").alias("length"))
        met = rows.join(other, "key").where("node < v and comp <> other").where(near(F.col("size"), F.col("length")))
        return met.select(F.col("node").alias("u"), "v").distinct()

    for turn in range(turns):
        many = scratch.table(_many(posts))
        if check is None:
            sizes, check = verify(many.select("node").distinct())
            sizes = sizes.select("node", "size")
        # the table of this turn has what its joins need, and takes the place of the one before
        before, many = many, scratch.table(many.join(sizes, "node"))
        scratch.drop(before)
        known = many.withColumn("comp", F.col("node")) if label is None else many.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        small, large = (known.where(f"m {op} {SMALL}") for op in ("<=", ">"))
        other = small.select("key", F.col("node").alias("v"), F.col("comp").alias("other"), F.col("size").alias("length"))
        pairs = small.join(other, "key").where("node < v and comp <> other").where(near(F.col("size"), F.col("length"))).select(F.col("node").alias("u"), "v")
        by = lambda c, k: F.xxhash64(F.col(c), F.lit(turn * pivots + k))  # noqa: B023, E731
        each = [(F.min_by("node", by("node", k)).alias(f"p{k}"), F.min_by("size", by("node", k)).alias(f"s{k}"), F.min_by("comp", by("node", k)).alias(f"c{k}")) for k in range(pivots)]
        met = large.join(large.groupBy("key").agg(*(x for e in each for x in e)), "key")
        # of its buckets' pivots under one order, a node meets the least that is near
        ok = [F.when((F.col(f"c{k}") != F.col("comp")) & near(F.col("size"), F.col(f"s{k}")), by(f"p{k}", k)) for k in range(pivots)]
        chosen = met.groupBy("node").agg(*(F.min_by(f"p{k}", ok[k]).alias(f"b{k}") for k in range(pivots)))
        chosen = chosen.select("node", F.explode(F.array(*(f"b{k}" for k in range(pivots)))).alias("b")).where("b is not null")
        pairs = pairs.union(chosen.select(F.least("node", "b").alias("u"), F.greatest("node", "b").alias("v"))).distinct()
        pairs = scratch.table(pairs)
        learn(check(pairs))
        scratch.drop(pairs)
        apart, left = scratch.counted(several(many.where(F.col("m") > SMALL).select("key", "node", "size")).select("key", "node", "size"))
        scratch.drop(many)
        kept.append(apart)
        if not left or turn + 1 == turns:
            break
        posts = again(apart.select("node").distinct(), turn + 1)
    # what the pivots left apart, bucket by bucket, each time less what is connected by then
    for apart in kept:
        rest, left = scratch.counted(several(apart))
        scratch.drop(apart)
        if left:
            passes = -(-rest.agg(F.sum("size")).first()[0] // max(1, sizes.agg(F.sum("size")).first()[0]))
            for found in together(rest, passes) if together else [check(joined(rest))]:
                learn(found)
        scratch.drop(rest)
    return label
