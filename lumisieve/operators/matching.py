"""Exact Hamming-radius matching of needles against a haystack; 100 % recall.

Three ways, chosen by what they cost (:meth:`Matcher.choose`).  The scan broadcasts the smaller
side, in blocks of a checked size, and compares in generated code; the larger side never
moves.  The packed scan (:mod:`.packed`) holds the needles in blocks of arrays, and compares columns of rows
with them.  The index equi-joins bands: a pair within the radius agrees, up to
radius // BANDS flips, on one of 16 bands, so one side's bands meet the other side's probes
and are verified.  A haystack can be a DataFrame or a :class:`~.store.HashStore`, whose bands are
joined where they lie.

Distances at any radius (:meth:`Matcher.nearest`) come from rings: the index is asked with 0, 1
and 2 flips, each time only for the needles whose nearest rows are not proven yet, and a
scan settles the rest.
"""

from __future__ import annotations

from functools import cached_property
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.window import Window

from ..functions.constants import DEFAULT_RADIUS
from ..functions.expr import WORDS, hamming
from ..functions.runtime import stored
from . import packed
from .hashing import Made, hash_frames
from .store import BAND_BITS, BANDS, KEYS, HashStore, band, banded

#: Rows up to here are broadcast: 64 bytes each.
BROADCAST_NEEDLES = 100_000
#: The first range of hash_id that a search for the first match reads is one of so many.
FIRST_RANGE = 64
#: Needles up to here are scanned for without counting the haystack.
FEW = 1000
#: Flips of one band that the index will ask for: three bits of sixteen, radius 63.
MOST_FLIPS = 697
#: Nanoseconds of one core (measured on one machine; only their proportions matter): to compare a pair in the scan, to
#: send a band or probe through a shuffle and a join, to read a stored band, to verify a pair that met in the index.
SCAN_NS, ROW_NS, STORED_NS, PAIR_NS = 15, 1000, 100, 200
#: The same for the packed scan: to compare a pair, to hand a row to Python; and to start, at once.
PACKED_NS, HANDED_NS, START_NS = 2.5, 1000, 2_000_000_000
#: Needles below this are never worth a packed scan.
LEAST_PACKED = 64
#: To take a resident needle out of its store and bring it together with those of its hash; and to do that at all.
GROUP_NS, GROUPS_NS = 10_000, 10_000_000_000
#: Ids of rows with one hash that stand in one array, about; and how many ids may be broadcast in such arrays.
MEMBERS, SENT_MEMBERS = 1000, 4_000_000

NEEDLE_WORDS = tuple(f"n{w}" for w in WORDS)


def flips(radius: int) -> int:
    """Keys to ask for in each band."""
    return sum(comb(BAND_BITS, i) for i in range(radius // BANDS + 1))


class Matcher:
    """needles: needle_id (long), w0..w3.  Haystacks: hash_id (long), w0..w3, or a store of them.

    Nothing runs before a match is asked for; needles and haystack may be counted then, so hashes that
    are made from frames should be stored first.
    """

    def __init__(self, needles: DataFrame, radius: int = DEFAULT_RADIUS, strategy: str | None = None):
        if not 0 <= radius <= 256:
            raise ValueError("radius must be from 0 to 256")
        if strategy not in (None, "scan", "packed", "index"):
            raise ValueError("strategy is scan, packed, index or None")
        if strategy == "index" and flips(radius) > MOST_FLIPS:
            raise ValueError(f"the index would ask for {flips(radius)} keys in each band at radius {radius}; scan instead")
        self.radius, self.strategy = radius, strategy
        self.needles = needles.select("needle_id", *(F.col(w).alias(n) for w, n in zip(WORDS, NEEDLE_WORDS)))
        #: Of the last :meth:`nearest`: (what was asked, needles, pairs compared).
        self.compared: list[tuple[str, int, int]] = []
        #: Of the last :meth:`first` in a store: the ranges of hash_id that were searched.
        self.searched: list[tuple[int, int]] = []

    @cached_property
    def count(self) -> int:
        return self.needles.count()

    @property
    def few(self) -> bool:
        return self.count <= BROADCAST_NEEDLES

    def distance(self) -> Column:
        return hamming([F.col(w) for w in WORDS], [F.col(n) for n in NEEDLE_WORDS])

    def within(self) -> Column:
        """Within the radius; half of the bits turn most pairs down."""
        half = hamming([F.col(w) for w in WORDS[:2]], [F.col(n) for n in NEEDLE_WORDS[:2]])
        return (half <= self.radius) & (self.distance() <= self.radius)

    # --- which way ----------------------------------------------------------------------

    def costs(self, haystack: DataFrame | HashStore) -> dict[str, float]:
        """Core seconds of each way; the pairs that would meet in the index are counted by keys, since bands of alike pictures are far from even."""
        n, m, f = _rows(haystack), self.count, flips(self.radius)
        out = {"scan": n * m * SCAN_NS * 1e-9}
        if self.few:
            out["packed"] = (START_NS + n * (HANDED_NS + m * PACKED_NS)) * 1e-9
        if m <= FEW:  # compared with so few, a row costs less than its bands
            return out
        if f > MOST_FLIPS or not getattr(haystack, "indexed", True):
            return out
        stored_ = isinstance(haystack, HashStore)
        moved = n * STORED_NS + m * f * ROW_NS if stored_ else (max(n, m) + min(n, m) * f) * ROW_NS
        out["index"] = BANDS * moved * 1e-9
        if out["index"] < min(v for k, v in out.items() if k != "index"):
            # how many rows and probes each of the 16 x 65536 keys has
            rows = haystack.counts() if stored_ else banded(_hashes(haystack), [F.col(w) for w in WORDS]).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
            probes = self._probes(self.radius).groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"))
            met = rows.join(probes, ["band", "key"]).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
            out["index"] += met * PAIR_NS * 1e-9
        return out

    def choose(self, haystack: DataFrame | HashStore) -> str:
        if self.strategy:
            return self.strategy
        if isinstance(haystack, DataFrame) and haystack.isStreaming:  # rows to come cannot be counted
            return "scan" if self.few else "index"
        if self.count < LEAST_PACKED and self.count <= FEW:
            return "scan"
        costs = self.costs(haystack)
        return min(costs, key=costs.get)

    def better_grouped(self, haystack: HashStore) -> bool:
        """Whether it costs less to bring equal hashes together, of the store too (:func:`all_distinct`), than to compare all rows."""
        if self.strategy or self.count < LEAST_PACKED and self.count <= FEW:
            return False
        costs = self.costs(haystack)
        self.strategy = min(costs, key=costs.get)  # not to be counted again
        return costs[self.strategy] > (GROUPS_NS + GROUP_NS * (haystack.rows + self.count)) * 1e-9

    # --- matches ------------------------------------------------------------------------

    def all(self, haystack: DataFrame | HashStore) -> DataFrame:
        """(needle_id, hash_id, dist) of every pair within the radius."""
        way = self.choose(haystack)
        return self._indexed(haystack) if way == "index" else self._scanned(haystack, way)

    def exists(self, haystack: DataFrame | HashStore) -> DataFrame:
        """One row: matched (boolean)."""
        return self.all(haystack).limit(1).agg((F.count(F.lit(1)) > 0).alias("matched"))

    def semi(self, haystack: DataFrame | HashStore) -> DataFrame:
        """Haystack rows within the radius of some needle."""
        return self._kept(haystack, "left_semi")

    def anti(self, haystack: DataFrame | HashStore) -> DataFrame:
        """Haystack rows that no needle matches."""
        return self._kept(haystack, "left_anti")

    def _kept(self, haystack, how: str) -> DataFrame:
        rows = haystack.hashes() if isinstance(haystack, HashStore) else haystack
        if self._by_needles(haystack):
            return rows.join(F.broadcast(self.needles), self.within(), how)
        return rows.join(self.all(haystack).select("hash_id").distinct(), "hash_id", how)

    def _by_needles(self, haystack) -> bool:
        return self.few and self.choose(haystack) != "index"

    def first(self, haystack: DataFrame | HashStore) -> DataFrame:
        """The least (hash_id, needle_id) within the radius; no row if there is none.

        A store is searched in ranges of hash_id, each twice as wide as the one before, up to the first that has a match.
        """
        if isinstance(haystack, HashStore) and self._by_needles(haystack):
            return self._first_of_ranges(haystack)
        least = self.all(haystack).agg(F.min(F.struct("hash_id", "needle_id", "dist")).alias("m"))
        return least.where("m is not null").select("m.*")

    def _first_of_ranges(self, store: HashStore) -> DataFrame:
        schema, self.searched = "hash_id long, needle_id long, dist int", []
        at, end = store.bounds or (1, 0)
        wide, way = max(1, (end - at + 1) // FIRST_RANGE), self.choose(store)
        while at <= end:
            last = min(end, at + wide - 1)
            self.searched.append((at, last))
            least = self._scanned(store.hashes(at, last), way).agg(F.min(F.struct("hash_id", "needle_id", "dist")).alias("m")).first().m
            if least is not None:
                return store.spark.createDataFrame([tuple(least)], schema)
            at, wide = last + 1, 2 * wide
        return store.spark.createDataFrame([], schema)

    def first_per_needle(self, haystack: DataFrame | HashStore) -> DataFrame:
        return self.all(haystack).groupBy("needle_id").agg(F.min(F.struct("hash_id", "dist")).alias("m")).select("needle_id", "m.*")

    def counts(self, haystack: DataFrame | HashStore) -> DataFrame:
        return self.all(haystack).groupBy("needle_id").agg(F.count(F.lit(1)).alias("matches"), F.min("dist").alias("least"), F.max("dist").alias("most"))

    def top(self, haystack: DataFrame | HashStore, k: int) -> DataFrame:
        """(needle_id, hash_id, dist, rank) of the k nearest rows within the radius; ties by hash_id."""
        return _ranked(self.all(haystack), k)

    def nearest(self, haystack: DataFrame | HashStore, k: int = 1) -> DataFrame:
        """(needle_id, hash_id, dist, rank): each needle's k nearest rows at any distance; ties by hash_id.

        All rows within radius 15, 31 or 47 are found with 0, 1 or 2 flips; a needle with k of them is settled there.
        """
        self.compared = []
        n = _rows(haystack)
        if self.strategy == "scan" or not getattr(haystack, "indexed", True) or not self.strategy and (self.count <= FEW or n * self.count * SCAN_NS < BANDS * (n + flips(2 * BANDS) * self.count) * ROW_NS):
            self.compared.append(("scan", self.count, n * self.count))
            return _farther(_hashes(haystack), self.needles, self.count, k)
        left, out = self.needles, None
        for reach in range(3):
            asked, seen = left.count(), Observation()
            if not asked:
                break
            radius = BANDS * (reach + 1) - 1
            pairs = stored(self._joined(haystack, left, radius, seen), "ring")  # no shuffle above the count, which an empty stage would lose
            found = stored(_ranked(pairs, k), "ring")
            self.compared.append((f"radius {radius}", asked, seen.get["pairs"]))
            settled = found.where(F.col("rank") == k).select("needle_id")
            mine = found.join(settled, "needle_id", "left_semi")
            out = mine if out is None else out.union(mine)
            left = stored(left.join(settled, "needle_id", "left_anti"), "ring")
        if rest := left.count():
            self.compared.append(("scan", rest, n * rest))
            last = _farther(_hashes(haystack), left, rest, k)
            out = last if out is None else out.union(last)
        return out

    # --- scan ---------------------------------------------------------------------------

    def _scanned(self, haystack, way: str = "scan") -> DataFrame:
        hay = _hashes(haystack)
        if way == "packed":
            found = None
            for block in _blocks(self.needles, self.count):
                some = packed.scan(hay, block, self.radius)
                found = some if found is None else found.union(some)
            return found
        if self.few:
            joined = hay.join(F.broadcast(self.needles), self.within())
        elif _rows(haystack) <= BROADCAST_NEEDLES:
            joined = self.needles.join(F.broadcast(hay), self.within())
        else:
            joined = None
            for block in _blocks(self.needles, self.count):
                some = hay.join(F.broadcast(block), self.within())
                joined = some if joined is None else joined.union(some)
        return joined.select("needle_id", "hash_id", self.distance().alias("dist"))

    # --- index --------------------------------------------------------------------------

    def _indexed(self, haystack) -> DataFrame:
        return self._joined(haystack, self.needles, self.radius)

    def _probes(self, radius: int, rows: DataFrame | None = None, words: tuple[str, ...] = NEEDLE_WORDS) -> DataFrame:
        masks = [sum(1 << x for x in c) for n in range(radius // BANDS + 1) for c in combinations(range(BAND_BITS), n)]
        own = banded(self.needles if rows is None else rows, [F.col(w) for w in words])
        return own.withColumn("key", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda f: F.col("key").bitwiseXOR(f))))

    def _joined(self, haystack, needles: DataFrame, radius: int, seen: Observation | None = None) -> DataFrame:
        if isinstance(haystack, HashStore):
            m = needles.count()
            # a bucket's probes fit a hash table, so that stored bands need no sort
            way = "shuffle_hash" if BANDS * flips(radius) * m <= 500_000 * haystack.buckets else "merge"
            hits = haystack.bands().join(haystack.salted(self._probes(radius, needles)).hint(way), list(KEYS))
        else:
            hay = haystack.select("hash_id", *WORDS)
            if radius >= BANDS and needles is self.needles and not haystack.isStreaming and haystack.count() < self.count:  # distance is symmetric: the fewer probe
                hits = banded(needles, [F.col(n) for n in NEEDLE_WORDS]).join(self._probes(radius, hay, WORDS), ["band", "key"])
            else:
                hits = banded(hay, [F.col(w) for w in WORDS]).join(self._probes(radius, needles), ["band", "key"])
        if seen is not None:
            hits = hits.observe(seen, F.count(F.lit(1)).alias("pairs"))
        hits = hits.withColumn("dist", self.distance()).where(F.col("dist") <= radius)
        # a pair may meet in several bands, and is kept in the first: no shuffle of pairs
        left, right = [F.col(w) for w in WORDS], [F.col(n) for n in NEEDLE_WORDS]
        apart = [F.bit_count(band(left, k).bitwiseXOR(band(right, k))) for k in range(BANDS)]
        first = F.coalesce(*(F.when(apart[k] <= radius // BANDS, F.lit(k)) for k in range(BANDS)))
        return hits.where(F.col("band") == first).select("needle_id", "hash_id", "dist")


def _rows(haystack: DataFrame | HashStore) -> int:
    return haystack.rows if isinstance(haystack, HashStore) else haystack.count()


def _hashes(haystack: DataFrame | HashStore) -> DataFrame:
    return haystack.hashes() if isinstance(haystack, HashStore) else haystack.select("hash_id", *WORDS)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("needle_id").orderBy("dist", "hash_id"))
    return pairs.select("needle_id", "hash_id", "dist", rank.alias("rank")).where(F.col("rank") <= k)


def _blocks(needles: DataFrame, count: int) -> list[DataFrame]:
    """Needles in blocks that may be broadcast."""
    blocks = 1 if count <= BROADCAST_NEEDLES else -(-count // (BROADCAST_NEEDLES // 2))
    return [needles if blocks == 1 else needles.where(F.pmod(F.xxhash64("needle_id"), F.lit(blocks)) == b) for b in range(blocks)]


def _farther(hay: DataFrame, needles: DataFrame, count: int, k: int) -> DataFrame:
    """The k nearest by comparing every pair, in blocks of needles, without sorting pairs.

    Pairs are counted by distance (at most 257 numbers a needle); those up to the distance that holds k rows are then ranked.
    """
    out, dist = None, hamming([F.col(w) for w in WORDS], [F.col(n) for n in NEEDLE_WORDS])
    for block in _blocks(needles, count):
        pairs = hay.join(F.broadcast(block), F.lit(True)).withColumn("dist", dist)
        if k == 1:
            bound = pairs.groupBy("needle_id").agg(F.min("dist").alias("bound"))
        else:
            upto = F.sum("n").over(Window.partitionBy("needle_id").orderBy("dist"))
            some = pairs.groupBy("needle_id", "dist").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
            bound = some.groupBy("needle_id").agg(F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("dist"))), F.max("dist")).alias("bound"))
        near = hay.join(F.broadcast(block.join(bound, "needle_id")), dist <= F.col("bound"))
        if k == 1:
            found = near.groupBy("needle_id", "bound").agg(F.min("hash_id").alias("hash_id")).select("needle_id", "hash_id", F.col("bound").alias("dist"), F.lit(1).alias("rank"))
        else:
            found = _ranked(near.select("needle_id", "hash_id", dist.alias("dist")), k)
        out = found if out is None else out.union(found)
    return out


def distinct(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The different hashes of rows (key, w0..w3), as (key: a number of the hash, w0..w3); and what they stand for, (key, members), in arrays of MEMBERS or so.

    Ids may be null, or stand at several hashes: members are structs of one id, kept as it is.
    """
    rows = rows.select(key, *WORDS).where(" and ".join(f"{w} is not null" for w in WORDS))
    each = stored(rows.groupBy(*WORDS).agg(F.count(F.lit(1)).alias("m")).withColumn("nth", F.monotonically_increasing_id()), "distinct")
    some = F.pmod(F.xxhash64(key), F.ceil(F.col("m") / MEMBERS)).alias("some")
    members = rows.join(each, list(WORDS)).groupBy("nth", some).agg(F.collect_list(F.struct(F.col(key).alias("id"))).alias("members"))
    return each.select(F.col("nth").alias(key), *WORDS), stored(members.select(F.col("nth").alias(key), "members"), "members")


def _few_to_many(need: DataFrame, hay: DataFrame, radius: int) -> DataFrame:
    """(needle_id, hash_id, dist) of every pair within the radius of two sides of different hashes, the fewer of which are brought together: distance is symmetric."""
    n, m = need.count(), hay.count()
    few, many, swapped = (hay, need, True) if m < n else (need, hay, False)
    if swapped:
        few, many = few.withColumnRenamed("hash_id", "needle_id"), many.withColumnRenamed("needle_id", "hash_id")
    # like hashes lie in one block, so that most needles pass it by
    tasks = 3 * many.sparkSession.sparkContext.defaultParallelism
    many = stored(many.repartitionByRange(tasks, *WORDS).sortWithinPartitions(*WORDS), "distinct")
    match = Matcher(few, radius)
    if not match.few:
        blocks = -(-match.count // (BROADCAST_NEEDLES // 2))
        packed_ = (blocks * (START_NS + max(n, m) * HANDED_NS) + n * m * PACKED_NS) * 1e-9
        if packed_ < min(match.costs(many).values()):
            match.strategy = "packed"
    pairs = match.all(many)
    if swapped:
        pairs = pairs.select(F.col("hash_id").alias("needle_id"), F.col("needle_id").alias("hash_id"), "dist")
    return pairs


def all_distinct(needles: DataFrame, haystack: DataFrame, radius: int = DEFAULT_RADIUS) -> DataFrame:
    """(needle_id, hash_id, dist) of every pair within the radius, where many rows may have the same hash: different hashes are compared once.

    needles: needle_id, w0..w3; haystack: hash_id, w0..w3.  Both are read several times.
    """
    (need, own), (hay, rows) = distinct(needles, "needle_id"), distinct(haystack, "hash_id")
    pairs = _few_to_many(need, hay, radius)
    other = rows.withColumnRenamed("members", "others")
    if haystack.count() <= SENT_MEMBERS:
        other = F.broadcast(other)
    both = pairs.join(own, "needle_id").join(other, "hash_id")
    both = both.select(F.explode("members").alias("own"), "others", "dist").select("own", F.explode("others").alias("other"), "dist")
    return both.select(F.col("own.id").alias("needle_id"), F.col("other.id").alias("hash_id"), "dist")


def distinct_near(needles: DataFrame, haystack: DataFrame, radius: int = DEFAULT_RADIUS) -> DataFrame:
    """Haystack rows (hash_id, w0..w3) within the radius of some needle (needle_id, w0..w3); different hashes are compared once."""
    each = lambda rows, key: stored(rows.select(*WORDS).where(" and ".join(f"{w} is not null" for w in WORDS)).distinct().withColumn(key, F.monotonically_increasing_id()), "distinct")
    need, hay = each(needles, "needle_id"), each(haystack, "hash_id")
    found = _few_to_many(need, hay, radius).select("hash_id").distinct()
    return haystack.join(hay.join(found, "hash_id", "left_semi").select(*WORDS), list(WORDS), "left_semi").select("hash_id", *WORDS)


def filter_then_verify(frames: DataFrame | Made, needles: DataFrame, radius: int = DEFAULT_RADIUS, slack: int = 8) -> DataFrame:
    """(image_id, needle_id, dist): a wider match on fast hashes, then precise hashes of the candidates only.

    frames: image_id, pixels, fmt.  needles: precise hashes (needle_id, w0..w3).  Both are hashed or read once; different
    hashes are compared once.
    """
    needles = stored(needles.select("needle_id", *WORDS), "verify")
    fast = stored(hash_frames(frames).select(F.col("image_id").alias("hash_id"), *WORDS), "verify")
    near = stored(distinct_near(needles, fast, radius + slack).select(F.col("hash_id").alias("image_id")).distinct(), "verify")
    candidates = frames.among(near) if isinstance(frames, Made) else frames.join(near, "image_id", "left_semi")
    exact = stored(hash_frames(candidates, "precise").select(F.col("image_id").alias("hash_id"), *WORDS), "verify")
    return all_distinct(needles, exact, radius).select(F.col("hash_id").alias("image_id"), "needle_id", "dist")
