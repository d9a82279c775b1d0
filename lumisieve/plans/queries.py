"""Registered queries of the perceptual-hash engine, with the SQL that checks them.

Images are made from every row of ``part``; matrices of 16 x 16 from ``embeddings`` (four
rows each); haystacks are SHA-256 hashes of texts, and needles are haystack hashes with 0,
15, 31 or 32 bits flipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as C, expr as X, tables as T
from ..functions.expr import WORDS
from ..functions.runtime import folder, stored
from ..operators import hashing as H
from ..operators.matching import Matcher, all_distinct, filter_then_verify as verify
from ..operators.store import HashStore
from ..sources import frames as S, sinks
from ..streaming import pipe, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Where the gap at the threshold is smaller, rounding could decide a bit; such hashes are shown as null.
SAFE = 1e-6


def _r(x: str, digits: int) -> str:
    """SQL that rounds and has one zero (a negative zero compares equal but prints otherwise)."""
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {digits}) END"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str, fmt: str = "luma8") -> H.Made:
    return S.synthetic(_dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"), fmt)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows that much work hangs on, dealt to a few tasks for each core (a small file is one task otherwise)."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pdqf): four consecutive embeddings as one 16 x 16 matrix."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("id"), F.struct((F.col("vec_id") % 4).alias("p"), F.col("embedding").cast("array<double>").alias("e")).alias("x"))
    got = _dealt(rows, "id").groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") == 4)
    return got.select("id", F.flatten(F.transform("xs", lambda x: x["e"])).alias("pdqf"))


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A haystack (hash_id, hash, w0..w3) of the texts of a table."""
    text = "html" if name == "pages" else "text"
    rows = table(spark, sf_dir, name).where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("hash_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("hash"))
    return rows.select("hash_id", "hash", *X.words(F.col("hash")))


def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each benchmark item, the hash of the document of its number with 0, 15, 31 or 32 bits flipped."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"))
    rows = texts(spark, sf_dir, "documents", "doc_id").join(items, F.col("hash_id") == F.col("needle_id"))
    flips = F.element_at(F.array(*(F.lit((1 << k) - 1).cast("long") for k in (0, 15, 31, 32))), (F.col("needle_id") % 4 + 1).cast("int"))
    return rows.select("needle_id", F.col("w0").bitwiseXOR(flips).alias("w0"), "w1", "w2", "w3")


# --- SQL that several queries share ---------------------------------------------------

_WORDS = ", ".join(f"('0x' || substr(hash, {16 * k + 1}, 16))::UBIGINT AS w{k}" for k in range(4))
_DIST = " + ".join(f"bit_count(xor(h.w{k}, n.w{k}))::INT" for k in range(4))


def _texts(name: str, key: str) -> str:
    text = "html" if name == "pages" else "text"
    return f"SELECT hash_id, hash, {_WORDS} FROM (SELECT {key} AS hash_id, sha256({text}) AS hash FROM {name} WHERE {text} IS NOT NULL)"


_MATCH = f"""WITH hay AS ({_texts('documents', 'doc_id')}),
need AS (SELECT item_id AS needle_id, xor(w0, [0, 32767, 2147483647, 4294967295][(item_id % 4 + 1)::INT]::UBIGINT) AS w0, w1, w2, w3 FROM hay JOIN benchmark ON hash_id = item_id),
pairs AS (SELECT needle_id, hash_id, {_DIST} AS dist FROM hay h CROSS JOIN need n),
hits AS (SELECT * FROM pairs WHERE dist <= 31)
"""
_DCT = "dct AS (SELECT k, j, sqrt(2/127.0) * cos(pi()/254 * (k+1) * (2*j+1)) AS v FROM range(16) a(k), range(127) b(j))"
_TENT = "tent AS (SELECT i, 4*(i+1)+d AS p, (3-abs(d))/9.0::DOUBLE AS v FROM range(127) a(i), range(-2, 3) b(d))"
_BOX = """box AS (SELECT p, q, 1.0::DOUBLE / (CASE WHEN p IN (0, 511) THEN 2 ELSE 3 END) AS v FROM range(512) a(p), range(512) b(q) WHERE abs(p-q) <= 1),
precise AS (SELECT i, y.q AS p, sum(x.v*y.v) AS v FROM range(127) a(i) JOIN box x ON x.p = (2*i+1)*512//254 JOIN box y ON y.p = x.q GROUP BY i, y.q)"""


def _projection(sampler: str) -> str:
    return f"amat AS (SELECT k, p, sum(dct.v*{sampler}.v) AS v FROM dct JOIN {sampler} ON dct.j = {sampler}.i GROUP BY k, p)"


_PATTERN = """pat AS (SELECT p_partkey AS id, x, ((x*(3+s%7))//32 + k)%8 AS a1, ((x*(5+k%11))//24 + s)%19 AS b1, (((x+k)*(1+k%5))//16)%8 AS a2, (((x+3*s)*(2+s%5))//20)%19 AS b2
  FROM (SELECT p_partkey, p_partkey AS k, p_size::BIGINT AS s FROM part), range(512) r(x))"""


def _image(precise: bool = False) -> str:
    sampler = "precise" if precise else "tent"
    return f"""WITH {_DCT}, {_BOX if precise else _TENT}, {_projection(sampler)}, {_PATTERN},
proj AS (SELECT id, k, sum(v*a1) AS pa1, sum(v*b1) AS pb1, sum(v*a2) AS pa2, sum(v*b2) AS pb2 FROM pat JOIN amat ON p = x GROUP BY id, k),
m AS (SELECT y.id, (y.k*16 + z.k)::INT AS i, y.pa1*z.pb1 + y.pa2*z.pb2 AS v FROM proj y JOIN proj z ON y.id = z.id)
"""


def _whole(precise: bool = False, tag: str = "w") -> str:
    """Coefficients in whole numbers, after :func:`_image` of the same mode: cosines in units of 2**-32, the sampler in ninths or thirty-sixths."""
    sampler = f"s{tag} AS (SELECT i, p, round(v * 36)::BIGINT AS v FROM precise)" if precise else f"s{tag} AS (SELECT i, p, round(v * 9)::BIGINT AS v FROM tent)"
    return f""", d{tag} AS (SELECT k, j, round(v * 4294967296)::BIGINT AS v FROM dct), {sampler},
a{tag} AS (SELECT k, p, sum(d{tag}.v*s{tag}.v)::BIGINT AS v FROM d{tag} JOIN s{tag} ON j = i GROUP BY k, p),
p{tag} AS (SELECT id, k, sum(v) AS one, sum(v*a1) AS pa1, sum(v*b1) AS pb1, sum(v*a2) AS pa2, sum(v*b2) AS pb2, sum(v*(a1%2)) AS qa1, sum(v*(b1%2)) AS qb1, sum(v*(a2%2)) AS qa2, sum(v*(b2%2)) AS qb2, sum(v*(a1%2)*(a2%2)) AS qa, sum(v*(b1%2)*(b2%2)) AS qb FROM pat JOIN a{tag} ON p = x GROUP BY id, k),
{tag} AS (SELECT y.id, (y.k*16 + z.k)::INT AS i, y.pa1*z.pb1 + y.pa2*z.pb2 AS v FROM p{tag} y JOIN p{tag} z ON y.id = z.id)
"""


def _image_rgb() -> str:
    """Channels v, 255 - v and v // 2, where v // 2 = (v - p) / 2 with the parity p = x + y - 2xy of two products of bits."""
    return f"""WITH {_DCT}, {_TENT}, {_projection("tent")}, {_PATTERN},
proj AS (SELECT id, k, sum(v) AS one, sum(v*a1) AS pa1, sum(v*b1) AS pb1, sum(v*a2) AS pa2, sum(v*b2) AS pb2, sum(v*(a1%2)) AS qa1, sum(v*(b1%2)) AS qb1, sum(v*(a2%2)) AS qa2, sum(v*(b2%2)) AS qb2, sum(v*(a1%2)*(a2%2)) AS qa, sum(v*(b1%2)*(b2%2)) AS qb FROM pat JOIN amat ON p = x GROUP BY id, k),
m AS (SELECT y.id, (y.k*16 + z.k)::INT AS i, (0.299 - 0.587 + 0.114/2)*(y.pa1*z.pb1 + y.pa2*z.pb2) + 0.587*255*y.one*z.one - 0.114/2*(y.qa1*z.qb1 + y.qa2*z.qb2 - 2*y.qa*z.qb) AS v FROM proj y JOIN proj z ON y.id = z.id)
"""


#: The weights times a thousand: 299 v + 587 (255 - v) + 57 (v - p).
_RGB = (
    _image_rgb()
    + _whole()
    + ", rgb AS (SELECT y.id, (y.k*16 + z.k)::INT AS i, 149685*y.one*z.one - 231*(y.pa1*z.pb1 + y.pa2*z.pb2) - 57*(y.qa1*z.qb1 + y.qa2*z.qb2 - 2*y.qa*z.qb) AS v FROM pw y JOIN pw z ON y.id = z.id)"
    + "@Q SELECT id AS image_id, hash, round(least(g/180, 1), 4) AS quality FROM hashed JOIN grad USING (id)"
)


_MATRIX = """WITH m0 AS (SELECT vec_id//4 AS id, ((vec_id%4)*64 + pos - 1)::INT AS i, e::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
m AS (SELECT * FROM m0 WHERE id IN (SELECT vec_id//4 FROM embeddings GROUP BY 1 HAVING count(*) = 4))
"""


def _quantize(m: str = "m", tag: str = "") -> str:
    return f""", thr{tag} AS (SELECT id, list_sort(list(v))[128] AS thr, list_sort(list(v))[129] - list_sort(list(v))[128] AS margin FROM {m} GROUP BY id),
nib{tag} AS (SELECT {m}.id, i//4 AS nb, sum(CASE WHEN v > thr THEN (1 << (i%4)) ELSE 0 END)::INT AS x FROM {m} JOIN thr{tag} USING (id) GROUP BY ALL),
hashed{tag} AS (SELECT id, string_agg(substr('0123456789abcdef', x+1, 1), '' ORDER BY nb DESC) AS hash FROM nib{tag} GROUP BY id)
"""


#: Fixed values, written out: the SQL must not come from the table it checks.
_DIH = """dih(ord, dihedral, xx, xy, yx, yy, t, c, r) AS (VALUES
(0, 'NORMAL', 1, 0, 0, 1, 0, 0, 0), (1, 'FLOPPED', -1, 0, 0, 1, 0, 1, 0),
(2, 'ROTATED_180', -1, 0, 0, -1, 0, 1, 1), (3, 'FLIPPED', 1, 0, 0, -1, 0, 0, 1),
(4, 'ROTATED_90_FLOPPED', 0, -1, -1, 0, 1, 0, 0), (5, 'ROTATED_270', 0, 1, 1, 0, 1, 0, 1),
(6, 'FLOPPED_ROTATED_270', 0, -1, 1, 0, 1, 1, 1), (7, 'ROTATED_90', 0, 1, -1, 0, 1, 1, 0))"""


def _variants(m: str = "m") -> str:
    return f""", {_DIH}, moved AS (SELECT id*8 + ord AS id, (CASE WHEN t = 1 THEN (i%16)*16 + i//16 ELSE i END)::INT AS i, v, c, r FROM {m}, dih),
dm AS (SELECT id, i, v * (CASE WHEN c = 1 AND i%2 = 0 THEN -1 ELSE 1 END) * (CASE WHEN r = 1 AND (i//16)%2 = 0 THEN -1 ELSE 1 END) AS v FROM moved)
"""


def _gradient(m: str = "m", name: str = "grad") -> str:
    return f", {name} AS (SELECT a.id, sum(abs(b.v - a.v)) AS g FROM {m} a JOIN {m} b ON a.id = b.id AND (b.i = a.i + 16 OR (b.i = a.i + 1 AND a.i % 16 <> 15)) GROUP BY a.id)\n"


# --- constants ---------------------------------------------------------------------------


def _cells(spark: SparkSession, m, row: str, col: str) -> DataFrame:
    cells = [(int(i), int(j), float(m[i, j])) for i, j in zip(*m.nonzero())]
    return spark.createDataFrame(cells, f"{row} long, {col} long, v double").select(row, col, F.round("v", 6).alias("v"))


@query(f"WITH {_DCT} SELECT k, j, {_r('v', 6)} AS v FROM dct")
def dct_matrix(spark, sf_dir):
    return _cells(spark, C.dct_matrix(), "k", "j")


@query(f"WITH {_TENT} SELECT i, p, round(v, 6) AS v FROM tent")
def tent_weights(spark, sf_dir):
    return _cells(spark, C.tent_matrix(), "i", "p")


@query("SELECT i, 4*(i+1) AS variant, (2*i+1)*512//254 AS precise FROM range(127) r(i)")
def sample_grid(spark, sf_dir):
    return spark.range(C.COARSE).select(F.col("id").alias("i"), (4 * (F.col("id") + 1)).alias("variant"), F.floor((2 * F.col("id") + 1) * 512 / 254).alias("precise"))


@query(f"WITH {_DCT}, {_TENT}, {_projection('tent')} SELECT k, p, {_r('v', 6)} AS v FROM amat")
def a_matrix(spark, sf_dir):
    return _cells(spark, C.projection(), "k", "p")


@query(f"WITH {_DIH} SELECT ord, dihedral, xx, xy, yx, yy, ((xx & 255)::BIGINT << 24) + ((xy & 255)::BIGINT << 16) + ((yx & 255)::BIGINT << 8) + (yy & 255)::BIGINT AS packed FROM dih")
def dihedral_dim(spark, sf_dir):
    return H.dihedral_table(spark)


@query(f"WITH {_DIH} SELECT ord, xx, xy, yx, yy FROM dih")
def dihedral_pack_unpack(spark, sf_dir):
    byte = lambda k: F.shiftright(F.shiftleft(F.col("packed").bitwiseAND(0xFFFFFFFF), 32 + 8 * k), 56).cast("int")
    return H.dihedral_table(spark).select("ord", byte(0).alias("xx"), byte(1).alias("xy"), byte(2).alias("yx"), byte(3).alias("yy"))


# --- pixels ------------------------------------------------------------------------------


def _luma(spark, sf_dir, more):
    r, g, b = (F.pmod(F.col(c), F.lit(256)) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *more, F.round(X.luma(r, g, b), 4).alias("luma"))


@query("SELECT l_orderkey, l_linenumber, round(0.299*(l_orderkey%256) + 0.587*(l_partkey%256) + 0.114*(l_suppkey%256), 4)::DOUBLE AS luma FROM lineitem")
def luma_rgb(spark, sf_dir):
    return _luma(spark, sf_dir, [])


@query("SELECT l_orderkey, l_linenumber, (l_linenumber%256)::INT AS alpha, round(0.299*(l_orderkey%256) + 0.587*(l_partkey%256) + 0.114*(l_suppkey%256), 4)::DOUBLE AS luma FROM lineitem")
def luma_rgba(spark, sf_dir):
    return _luma(spark, sf_dir, [F.pmod(F.col("l_linenumber"), F.lit(256)).cast("int").alias("alpha")])


def _plane_sql(sampler: str, more: str) -> str:
    return f"""WITH {more}, {_PATTERN}, side AS (SELECT id, i, sum(v*a1) AS a1, sum(v*b1) AS b1, sum(v*a2) AS a2, sum(v*b2) AS b2 FROM pat JOIN {sampler} ON p = x GROUP BY id, i)
SELECT y.id AS image_id, round(sum(y.a1*z.b1 + y.a2*z.b2), 2) AS plane_sum, round(min(y.a1*z.b1 + y.a2*z.b2), 4) AS plane_min, round(max(y.a1*z.b1 + y.a2*z.b2), 4) AS plane_max FROM side y JOIN side z ON y.id = z.id GROUP BY y.id"""


_PLANE_QUALITY = f"""WITH {_TENT}, {_PATTERN}, side AS (SELECT id, i, sum(v*a1) AS a1, sum(v*b1) AS b1, sum(v*a2) AS a2, sum(v*b2) AS b2 FROM pat JOIN tent ON p = x GROUP BY id, i),
step AS (SELECT s.id, s.i, s.a1, s.b1, s.a2, s.b2, t.a1 - s.a1 AS da1, t.b1 - s.b1 AS db1, t.a2 - s.a2 AS da2, t.b2 - s.b2 AS db2 FROM side s LEFT JOIN side t ON s.id = t.id AND t.i = s.i + 1)
SELECT y.id AS image_id, round(least((coalesce(sum(abs(y.da1*z.b1 + y.da2*z.b2)), 0) + coalesce(sum(abs(y.a1*z.db1 + y.a2*z.db2)), 0)) / 255 / 90, 1), 4) AS plane_quality FROM step y JOIN step z ON y.id = z.id GROUP BY y.id"""


@query(_PLANE_QUALITY)
def plane_quality(spark, sf_dir):
    """Quality in the image domain: gradients of the filtered plane."""
    return H.plane_stats(images(spark, sf_dir)).select("image_id", F.round("plane_quality", 4).alias("plane_quality"))


def _stats(df):
    return df.select("image_id", F.round("plane_sum", 2).alias("plane_sum"), F.round("plane_min", 4).alias("plane_min"), F.round("plane_max", 4).alias("plane_max"))


@query(_plane_sql("tent", _TENT))
def tent_compress(spark, sf_dir):
    return _stats(H.plane_stats(images(spark, sf_dir)))


@query(_plane_sql("precise", _BOX))
def jarosz_precise(spark, sf_dir):
    return _stats(H.plane_stats(images(spark, sf_dir), "precise"))


@query(_image() + f"SELECT id AS image_id, i, {_r('v', 4)} AS v FROM m")
def pdqf_image(spark, sf_dir):
    return H.pdqf(images(spark, sf_dir)).select("image_id", F.posexplode("pdqf").alias("i", "v")).select("image_id", "i", F.round("v", 4).alias("v"))


@query(_image() + ", r AS (SELECT id, i//16 AS k, sum(v) AS s FROM m GROUP BY ALL) SELECT id AS image_id, k, " + _r("s", 4) + " AS row_sum FROM r")
def dct2d(spark, sf_dir):
    rows = H.pdqf(images(spark, sf_dir)).select("image_id", F.posexplode("pdqf").alias("i", "v"))
    return rows.groupBy("image_id", F.floor(F.col("i") / 16).cast("int").alias("k")).agg(F.round(F.sum("v"), 4).alias("row_sum"))


@query(_image() + _whole() + _quantize() + _quantize("w", "w") + _gradient() + "SELECT id AS image_id, hash, round(thr, 4) AS threshold, round(least(g/180, 1), 4) AS quality FROM hashedw JOIN thr USING (id) JOIN grad USING (id)")
def hash_image(spark, sf_dir):
    return H.hash_frames(images(spark, sf_dir)).select("image_id", "hash", F.round("threshold", 4).alias("threshold"), F.round("quality", 4).alias("quality"))


@query(_image(True) + _whole(True) + _quantize() + _quantize("w", "w") + "SELECT id AS image_id, hash, round(thr, 4) AS threshold FROM hashedw JOIN thr USING (id)")
def hash_precise(spark, sf_dir):
    return H.hash_frames(images(spark, sf_dir), "precise").select("image_id", "hash", F.round("threshold", 4).alias("threshold"))


#: Width and height of the pictures of a part, by its key modulo three.
SIZES = ((384, 256), (200, 300), (1031, 640))


def _resized_sql() -> str:
    sizes = ", ".join(f"({k}, {w}, {h})" for k, (w, h) in enumerate(SIZES))
    return f"""WITH {_DCT}, {_TENT}, {_projection("tent")}, sizes(n, w, h) AS (VALUES {sizes}), side AS (SELECT DISTINCT unnest([w, h]) AS size FROM sizes),
tri AS (SELECT size, o, q, greatest(1 - abs(q - ((o + 0.5)::DOUBLE * size / 512 - 0.5)) / greatest(size / 512.0::DOUBLE, 1), 0) AS t FROM side, range(512) a(o), range(1100) b(q) WHERE q < size AND abs(q - ((o + 0.5)::DOUBLE * size / 512 - 0.5)) < greatest(size / 512.0::DOUBLE, 1)),
norm AS (SELECT size, o, sum(t) AS total FROM tri GROUP BY ALL),
scaled AS (SELECT size, k, q, sum(v * t / total) AS v FROM tri JOIN norm USING (size, o) JOIN amat ON p = o GROUP BY ALL),
pat AS (SELECT p_partkey AS id, w, h, x, ((x*(3+s%7))//32 + k)%8 AS a1, ((x*(5+k%11))//24 + s)%19 AS b1, (((x+k)*(1+k%5))//16)%8 AS a2, (((x+3*s)*(2+s%5))//20)%19 AS b2 FROM (SELECT p_partkey, p_partkey AS k, p_size::BIGINT AS s FROM part) JOIN sizes ON k % {len(SIZES)} = n, range(1100) r(x)),
down AS (SELECT id, k, sum(v*a1) AS a1, sum(v*a2) AS a2 FROM pat JOIN scaled ON size = h AND q = x GROUP BY id, k),
across AS (SELECT id, k, sum(v*b1) AS b1, sum(v*b2) AS b2 FROM pat JOIN scaled ON size = w AND q = x GROUP BY id, k),
m AS (SELECT y.id, (y.k*16 + z.k)::INT AS i, y.a1*z.b1 + y.a2*z.b2 AS v FROM down y JOIN across z ON y.id = z.id)
"""


@query(_resized_sql() + _quantize() + _gradient() + f"SELECT id AS image_id, w AS width, h AS height, CASE WHEN margin > {SAFE} THEN hash END AS hash, round(thr, 4) AS threshold, round(least(g/180, 1), 4) AS quality FROM hashed JOIN thr USING (id) JOIN grad USING (id) JOIN (SELECT DISTINCT id, w, h FROM pat) USING (id)")
def hash_resized(spark, sf_dir):
    """Pictures of three sizes, none of them 512 x 512 (there, rounding could decide bits within SAFE)."""
    frames = S.synthetic(_dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"), sizes=SIZES)
    shown = F.when(F.col("margin") > SAFE, F.col("hash")).alias("hash")
    return H.hash_frames(frames, keep=("width", "height")).select("image_id", "width", "height", shown, F.round("threshold", 4).alias("threshold"), F.round("quality", 4).alias("quality"))


def _distances(spark, sf_dir):
    both = H.hash_modes(images(spark, sf_dir))
    return both.select("image_id", X.hamming([F.col(w) for w in WORDS], [F.col(f"p{w}") for w in WORDS]).alias("dist"))


#: Hashes of both modes, in whole numbers: fast (id, w0..w3) and precise.
_BOTH = f"""WITH {_DCT}, {_TENT}, {_BOX}, {_PATTERN}{_whole()}{_whole(True, "u")}{_quantize("w", "w")}{_quantize("u", "u")},
fast AS (SELECT id, {_WORDS} FROM hashedw), slow AS (SELECT id, {_WORDS} FROM hashedu),
apart AS (SELECT h.id AS image_id, {_DIST} AS dist FROM fast h JOIN slow n USING (id))
"""


@query(_BOTH + "SELECT image_id, dist FROM apart")
def variant_vs_precise_distance(spark, sf_dir):
    return _distances(spark, sf_dir)


@query(_BOTH + "SELECT n, worst, round(average, 4) AS average, round(100.0/pow(2, (31 - worst + 1)/2.0)/n, 9) AS worst_fnr, round(100.0/pow(2, (31 - average + 1)/2.0)/n, 9) AS average_fnr FROM (SELECT count(*) AS n, max(dist) AS worst, avg(dist) AS average FROM apart)")
def fnr_stats(spark, sf_dir):
    """Worst and mean distance of fast hashes from precise ones, and the bound on missed matches that follows."""
    got = _distances(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("worst"), F.avg("dist").alias("average"))
    bound = lambda x: F.round(F.lit(100.0) / F.pow(F.lit(2.0), (F.lit(31) - x + 1) / 2) / F.col("n"), 9)
    return got.select("n", "worst", F.round("average", 4).alias("average"), bound(F.col("worst")).alias("worst_fnr"), bound(F.col("average")).alias("average_fnr"))


@query(_image() + _whole() + _quantize("w", "w") + _gradient() + "SELECT id AS image_id, CASE WHEN g/180 > 0.5 THEN hash END AS hash, round(least(g/180, 1), 4) AS quality FROM hashedw JOIN grad USING (id)")
def hash_confident(spark, sf_dir):
    """The hash, null where the quality is 0.5 or less."""
    return H.confident(H.hash_frames(images(spark, sf_dir))).select("image_id", "hash", F.round("quality", 4).alias("quality"))


@query(_image() + _gradient() + "SELECT id AS image_id, round(least(g/180, 1), 4) AS quality FROM grad WHERE g/180 > 0.5")
def quality_filter(spark, sf_dir):
    return H.pdqf(images(spark, sf_dir)).where("quality > 0.5").select("image_id", F.round("quality", 4).alias("quality"))


@query(_image() + _whole() + _variants("w") + _quantize("dm") + "SELECT id//8 AS image_id, (id%8)::INT AS ord, hash FROM hashed")
def dihedral_hashes(spark, sf_dir):
    return H.hash_frames(images(spark, sf_dir), dihedrals=True).select("image_id", "ord", "hash")


# --- matrices of embeddings: the native expressions --------------------------------------


@query(_MATRIX + _gradient() + "SELECT id, round(g, 4) AS gradient FROM grad")
def gradient_sum(spark, sf_dir):
    return matrices(spark, sf_dir).select("id", F.round(X.gradient_sum(F.col("pdqf")), 4).alias("gradient"))


@query(_MATRIX + _gradient() + "SELECT id, round(least(g/180, 1), 4) AS quality FROM grad")
def quality_score(spark, sf_dir):
    return matrices(spark, sf_dir).select("id", F.round(X.quality(X.gradient_sum(F.col("pdqf"))), 4).alias("quality"))


@query(_MATRIX + _quantize() + "SELECT id, thr AS threshold, margin FROM thr")
def median_threshold(spark, sf_dir):
    return matrices(spark, sf_dir).select("id", X.lower_median(F.col("pdqf")).alias("threshold"), X.margin(F.col("pdqf")).alias("margin"))


@query(_MATRIX + _quantize() + ", mid AS (SELECT id, thr + margin/2 AS mid FROM thr), nibm AS (SELECT m.id, i//4 AS nb, sum(CASE WHEN v > mid THEN (1 << (i%4)) ELSE 0 END)::INT AS x FROM m JOIN mid USING (id) GROUP BY ALL), h AS (SELECT id, string_agg(substr('0123456789abcdef', x+1, 1), '' ORDER BY nb DESC) AS hash FROM nibm GROUP BY id) SELECT id, hash, round(mid, 6) AS threshold FROM h JOIN mid USING (id)")
def quantize_middle(spark, sf_dir):
    """Bits by the mean of the two middle coefficients, as exact kernels take it."""
    rows = matrices(spark, sf_dir).withColumn("at", X.middle(F.col("pdqf")))
    return rows.select("id", X.pack(F.col("pdqf"), F.col("at")).alias("hash"), F.round("at", 6).alias("threshold"))


@query(_MATRIX + _quantize() + "SELECT id, string_agg(CASE WHEN v > thr THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS bits FROM m JOIN thr USING (id) GROUP BY id")
def quantize_bits(spark, sf_dir):
    return matrices(spark, sf_dir).select("id", X.bits(F.col("pdqf"), X.lower_median(F.col("pdqf"))).alias("bits"))


@query(_MATRIX + _quantize() + "SELECT id, hash FROM hashed")
def quantize_hex(spark, sf_dir):
    return H.quantize(matrices(spark, sf_dir)).select("id", "hash")


@query(_MATRIX + ", z AS (SELECT id, i//4 AS nb, sum(CASE WHEN v > 0.05 THEN (1 << (i%4)) ELSE 0 END)::INT AS x FROM m GROUP BY ALL) SELECT id, string_agg(substr('0123456789abcdef', x+1, 1), '' ORDER BY nb DESC) AS hash FROM z GROUP BY id")
def rethreshold(spark, sf_dir):
    return matrices(spark, sf_dir).select("id", X.pack(F.col("pdqf"), F.lit(0.05)).alias("hash"))


def _moved_sql(index: str, sign: str) -> str:
    return _MATRIX + f"SELECT id, ({index})::INT AS i, v * ({sign}) AS v FROM m"


def _moved(spark, sf_dir, f):
    return matrices(spark, sf_dir).select("id", F.posexplode(f(F.col("pdqf"))).alias("i", "v"))


@query(_moved_sql("(i%16)*16 + i//16", "1"))
def pdqf_transpose(spark, sf_dir):
    return _moved(spark, sf_dir, X.transpose)


@query(_moved_sql("i", "CASE WHEN i%2 = 0 THEN -1 ELSE 1 END"))
def negate_alt_cols(spark, sf_dir):
    return _moved(spark, sf_dir, X.negate_alt_cols)


@query(_moved_sql("i", "CASE WHEN i%2 = 1 THEN -1 ELSE 1 END"))
def negate_alt_cols_odd(spark, sf_dir):
    return _moved(spark, sf_dir, lambda p: X.negate_alt_cols(p, True))


@query(_moved_sql("i", "CASE WHEN (i//16)%2 = 0 THEN -1 ELSE 1 END"))
def negate_alt_rows(spark, sf_dir):
    return _moved(spark, sf_dir, X.negate_alt_rows)


@query(_moved_sql("i", "CASE WHEN (i//16)%2 = 1 THEN -1 ELSE 1 END"))
def negate_alt_rows_odd(spark, sf_dir):
    return _moved(spark, sf_dir, lambda p: X.negate_alt_rows(p, True))


@query(_moved_sql("i", "CASE WHEN (i%16 + i//16)%2 = 1 THEN -1 ELSE 1 END"))
def negate_off_diagonals(spark, sf_dir):
    return _moved(spark, sf_dir, X.negate_off_diagonals)


@query(_MATRIX + _variants() + _quantize("dm") + _gradient("dm") + "SELECT id//8 AS id, (id%8)::INT AS ord, hash, round(least(g/180, 1), 4) AS quality, thr AS threshold FROM hashed JOIN grad USING (id) JOIN thr USING (id)")
def dihedral_quality(spark, sf_dir):
    return H.dihedrals(matrices(spark, sf_dir)).select("id", "ord", "hash", F.round("quality", 4).alias("quality"), "threshold")


@query(_MATRIX + ", s AS (SELECT id, list_sort(list(v)) AS l FROM m GROUP BY id) SELECT id, sum((v > l[128])::INT)::BIGINT AS above, sum((v < l[128])::INT)::BIGINT AS below, sum((v = l[128])::INT)::BIGINT AS at_median FROM m JOIN s USING (id) GROUP BY id")
def threshold_diagnostic(spark, sf_dir):
    """How many coefficients lie above, below and at the threshold."""
    rows = matrices(spark, sf_dir).withColumn("t", X.lower_median(F.col("pdqf"))).select("id", "t", F.explode("pdqf").alias("v"))
    return rows.groupBy("id").agg(*(F.sum(c.cast("long")).alias(n) for n, c in (("above", F.col("v") > F.col("t")), ("below", F.col("v") < F.col("t")), ("at_median", F.col("v") == F.col("t")))))


# --- matching ----------------------------------------------------------------------------


def _matcher(spark, sf_dir, radius=31, strategy=None):
    return Matcher(needles(spark, sf_dir), radius, strategy), texts(spark, sf_dir, "documents", "doc_id")


@query(_MATCH + "SELECT needle_id, hash_id, dist FROM hits")
def find_all(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.all(hay)


@query(_MATCH + "SELECT needle_id, hash_id, dist FROM hits")
def match_mih(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir, strategy="index")
    return m.all(hay)


@query(_MATCH + "SELECT needle_id, hash_id, dist FROM hits")
def match_packed(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir, strategy="packed")
    return m.all(hay)


@query(_MATCH + "SELECT count(*) > 0 AS matched FROM hits")
def scan_exists(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.exists(hay)


@query(_MATCH + "SELECT hash_id, needle_id, dist FROM hits ORDER BY hash_id, needle_id LIMIT 1")
def find_first(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.first(hay)


@query(_MATCH + "SELECT needle_id, min(hash_id) AS hash_id, arg_min(dist, hash_id) AS dist FROM hits GROUP BY needle_id")
def find_first_per_needle(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.first_per_needle(hay)


@query(_MATCH + "SELECT needle_id, count(*) AS matches, min(dist) AS least, max(dist) AS most FROM hits GROUP BY needle_id")
def match_counts(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.counts(hay)


@query(_MATCH + "SELECT hash_id, hash FROM hay WHERE hash_id NOT IN (SELECT hash_id FROM hits)")
def match_anti(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.anti(hay).select("hash_id", "hash")


@query(_MATCH + "SELECT DISTINCT hash_id, hash FROM hay WHERE hash_id IN (SELECT hash_id FROM hits)")
def match_semi(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.semi(hay).select("hash_id", "hash").distinct()


@query(_MATCH + "SELECT needle_id, min(dist) AS dist FROM pairs GROUP BY needle_id")
def match_min_dist(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.nearest(hay).select("needle_id", "dist")


@query(_MATCH + "SELECT needle_id, hash_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY needle_id ORDER BY dist, hash_id) AS r FROM pairs) WHERE r = 1")
def match_nearest(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir)
    return m.nearest(hay).select("needle_id", "hash_id", "dist")


@query(_MATCH + "SELECT needle_id, hash_id, dist, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY needle_id ORDER BY dist, hash_id) AS r FROM pairs) WHERE r <= 3")
def match_rings(spark, sf_dir):
    """Three nearest rows at any distance: rings of the index, then a scan for needles that have fewer close ones."""
    hay = stored(texts(spark, sf_dir, "documents", "doc_id").select("hash_id", *WORDS), "rings")
    return Matcher(needles(spark, sf_dir), strategy="index").nearest(hay, 3)


@query(_MATCH + "SELECT needle_id, hash_id, dist, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY needle_id ORDER BY dist, hash_id) AS r FROM pairs WHERE dist <= 100) WHERE r <= 5")
def match_topk(spark, sf_dir):
    """Five nearest rows within 100 bits."""
    return Matcher(needles(spark, sf_dir), 100, "scan").top(_matcher(spark, sf_dir)[1], 5)


@query(_MATCH + "SELECT dist, count(*) AS pairs FROM pairs GROUP BY dist")
def hamming_histogram(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir, 256)
    return m.all(hay).groupBy("dist").agg(F.count(F.lit(1)).alias("pairs"))


@query(_MATCH + "SELECT needle_id, hash_id, dist FROM pairs WHERE dist <= 110")
def hamming_pairs(spark, sf_dir):
    m, hay = _matcher(spark, sf_dir, 110)
    return m.all(hay)


@query(_MATCH + "SELECT (needle_id % 4)::INT AS kind, count(*) AS planted, count(*) FILTER (WHERE dist <= 31) AS found FROM pairs WHERE needle_id = hash_id GROUP BY kind")
def threshold_boundary(spark, sf_dir):
    """Of needles with 0, 15, 31 and 32 flipped bits, how many find the row they came from."""
    m, hay = _matcher(spark, sf_dir)
    found = m.all(hay).where("needle_id = hash_id").select("needle_id", F.lit(1).alias("hit"))
    rows = needles(spark, sf_dir).join(found, "needle_id", "left")
    return rows.groupBy((F.col("needle_id") % 4).cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("planted"), F.count("hit").alias("found"))


@query(_MATCH + ", w(width) AS (VALUES (8), (16), (24), (32)) SELECT width, count(hash_id) AS matches FROM w LEFT JOIN hits ON needle_id < width GROUP BY width")
def find_8_16_24_32(spark, sf_dir):
    """Matches of needle batches of several widths, in one pass over the haystack."""
    m, hay = _matcher(spark, sf_dir)
    widths = spark.createDataFrame([(8,), (16,), (24,), (32,)], "width int")
    return widths.join(m.all(hay), F.col("needle_id") < F.col("width"), "left").groupBy("width").agg(F.count("hash_id").alias("matches"))


def _shards(spark, sf_dir):
    shards = [("documents", "doc_id", 0), ("pages", "page_id", 1_000_000_000)]
    parts = [texts(spark, sf_dir, n, k).select((F.col("hash_id") + off).alias("hash_id"), *WORDS) for n, k, off in shards]
    return parts[0].unionByName(parts[1])


@query(_MATCH + f", shards AS (SELECT hash_id, w0, w1, w2, w3 FROM hay UNION ALL SELECT hash_id + 1000000000, w0, w1, w2, w3 FROM ({_texts('pages', 'page_id')})) SELECT needle_id, hash_id, dist FROM (SELECT needle_id, hash_id, {_DIST} AS dist FROM shards h CROSS JOIN need n) WHERE dist <= 31")
def match_sharded(spark, sf_dir):
    """Two shards with offset ids, one pass."""
    return Matcher(needles(spark, sf_dir)).all(_shards(spark, sf_dir))


@query(_MATCH + f", shards AS (SELECT hash_id, w0, w1, w2, w3 FROM hay UNION ALL SELECT hash_id + 1000000000, w0, w1, w2, w3 FROM ({_texts('pages', 'page_id')})), batches AS (SELECT (needle_id % 3)::INT AS batch, needle_id, hash_id, {_DIST} AS dist FROM shards h CROSS JOIN need n) SELECT batch, needle_id, hash_id, dist FROM batches WHERE dist <= 31")
def resident_store(spark, sf_dir):
    """A store of documents to which pages are appended, asked with three batches of needles."""
    store = HashStore.create(spark, folder(spark, "store"), texts(spark, sf_dir, "documents", "doc_id"), buckets=16)
    store.append(texts(spark, sf_dir, "pages", "page_id").withColumn("hash_id", F.col("hash_id") + 1_000_000_000))
    asked = stored(needles(spark, sf_dir), "needles")
    found = [Matcher(asked.where(F.col("needle_id") % 3 == b), strategy="index").all(store).withColumn("batch", F.lit(b)) for b in range(3)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("batch", "needle_id", "hash_id", "dist")


def _screened_sql() -> str:
    return _image() + _whole() + _variants("w") + _quantize("dm") + f""", safe AS (SELECT id, hash, {_WORDS} FROM hashed),
hay AS (SELECT hash_id, w0, w1, w2, w3 FROM ({_texts('documents', 'doc_id')}) UNION ALL SELECT 1000000000 + id//8, w0, w1, w2, w3 FROM safe WHERE id%8 = 3)
SELECT n.id//8 AS image_id, (n.id%8)::INT AS ord, hash_id, {_DIST} AS dist FROM hay h JOIN safe n ON {_DIST} <= 31"""


@query(_screened_sql())
def screen_images(spark, sf_dir):
    """The flagship: eight hashes of each image against texts' hashes and the flipped images' own."""
    # needles and haystack both come from these hashes: frames are made and hashed once
    every = stored(H.hash_frames(images(spark, sf_dir), dihedrals=True).select("image_id", "ord", *WORDS), "screen")
    hay = texts(spark, sf_dir, "documents", "doc_id").select("hash_id", *WORDS).unionByName(every.where("ord = 3").select((F.col("image_id") + 1_000_000_000).alias("hash_id"), *WORDS))
    own = every.select((F.col("image_id") * 8 + F.col("ord")).alias("needle_id"), *WORDS)
    pairs = all_distinct(own, stored(hay, "screen"))
    return pairs.select(F.shiftright("needle_id", 3).alias("image_id"), F.col("needle_id").bitwiseAND(7).cast("int").alias("ord"), "hash_id", "dist")


@query(_screened_sql())
def sql_screen(spark, sf_dir):
    """The flagship in SQL: a table function makes the hashes; its needles and its haystack are compared by :func:`all_distinct`."""
    made = images(spark, sf_dir)
    T.register_made(spark, "pdq_dihedrals_of_part", made)
    made.rows.createOrReplaceTempView("lumisieve_parts")
    texts(spark, sf_dir, "documents", "doc_id").select("hash_id", *WORDS).createOrReplaceTempView("lumisieve_texts")
    every = spark.sql("SELECT image_id, h.ord, h.w0, h.w1, h.w2, h.w3 FROM lumisieve_parts, LATERAL pdq_dihedrals_of_part(image_id, p_size) h")
    stored(every, "screen").createOrReplaceTempView("lumisieve_variants")
    own = spark.sql("SELECT image_id * 8 + ord AS needle_id, w0, w1, w2, w3 FROM lumisieve_variants")
    hay = spark.sql("SELECT hash_id, w0, w1, w2, w3 FROM lumisieve_texts UNION ALL SELECT 1000000000 + image_id, w0, w1, w2, w3 FROM lumisieve_variants WHERE ord = 3")
    all_distinct(own, stored(hay, "screen")).createOrReplaceTempView("lumisieve_pairs")
    return spark.sql("SELECT shiftright(needle_id, 3) AS image_id, CAST(needle_id & 7 AS INT) AS ord, hash_id, dist FROM lumisieve_pairs")


@query(_BOTH + f", near AS (SELECT DISTINCT h.id FROM fast h JOIN slow n ON {_DIST} <= 39) SELECT h.id AS image_id, n.id AS needle_id, {_DIST} AS dist FROM slow h SEMI JOIN near USING (id) JOIN slow n ON {_DIST} <= 31")
def filter_then_verify(spark, sf_dir):
    """Precise hashes of the images as needles; a fast pass at radius 39, then precise hashes of what it lets through."""
    need = H.hash_frames(images(spark, sf_dir), "precise").select(F.col("image_id").alias("needle_id"), *WORDS)
    return verify(images(spark, sf_dir), need)


# --- encodings, sources, streams ---------------------------------------------------------


def _format(spec: str) -> Query:
    def run(spark, sf_dir):
        rows = H.quantize(matrices(spark, sf_dir)).withColumn("quality", X.quality(X.gradient_sum(F.col("pdqf"))))
        return rows.select("id", sinks.encode(F.col("hash"), F.col("quality"), spec).alias("line"))

    return run


_Q = "printf('%.3f:', least(g/180, 1)*100)"
_BITS = "(SELECT string_agg(CASE WHEN v > thr THEN '1' ELSE '0' END, '' ORDER BY i DESC) FROM m WHERE m.id = hashed.id)"
for _name, _spec, _line in (
    ("format_hex", "hex", "hash"),
    ("format_hex_upper", "HEX", "upper(hash)"),
    ("format_q_hex", "q+hex", f"{_Q} || hash"),
    ("format_q_hex_upper", "q+HEX", f"{_Q} || upper(hash)"),
    ("format_hex_crlf", "hex+crlf", "hash || chr(13) || chr(10)"),
    ("format_hex_nul", "hex+nul", None),
    ("format_base64", "base64", "base64(unhex(hash))"),
):
    QUERIES[_name] = _format(_spec)
    if _line:
        SQL[_name] = _MATRIX + _quantize() + _gradient() + f"SELECT id, {_line} AS line FROM hashed JOIN grad USING (id)"
for _name, _spec, _line in (("format_bin", "bin", "b"), ("format_q_bin", "q+bin", f"{_Q} || b")):
    QUERIES[_name] = _format(_spec)
    SQL[_name] = _MATRIX + _quantize() + _gradient() + f", bs AS (SELECT id, string_agg(CASE WHEN v > thr THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS b FROM m JOIN thr USING (id) GROUP BY id) SELECT id, {_line} AS line FROM bs JOIN grad USING (id)"


@query(_MATRIX + _quantize() + "SELECT id, octet_length(unhex(hash))::INT AS n_bytes, lower(hex(unhex(hash))) AS back FROM hashed")
def format_raw(spark, sf_dir):
    raw = sinks.raw_bytes(F.col("hash"))
    return H.quantize(matrices(spark, sf_dir)).select("id", F.octet_length(raw).alias("n_bytes"), F.lower(F.hex(raw)).alias("back"))


@query(
    _MATRIX
    + _variants()
    + _quantize("dm")
    + _gradient("dm")
    + """, cells AS (SELECT id, i, CASE WHEN v > first THEN '*' ELSE '' END || printf('%.5f', v) AS cell, CASE WHEN v > thr THEN '1' ELSE '0' END AS bit FROM dm JOIN thr USING (id) JOIN (SELECT id//8 AS image, thr AS first FROM thr WHERE id%8 = 0) ON id//8 = image),
lines AS (SELECT id, i//16 AS r, string_agg(cell, chr(9) ORDER BY i) AS line FROM cells GROUP BY ALL),
body AS (SELECT id, string_agg(line, chr(10) ORDER BY r) AS body FROM lines GROUP BY id),
bits AS (SELECT id, string_agg(bit, '' ORDER BY i DESC) AS bits FROM cells GROUP BY id)
SELECT id//8 AS image_id, (id%8)::INT AS ord, CASE WHEN id%8 = 0 THEN '["original"]' ELSE '[Dihedrals { packed: ' || (((xx & 255)::BIGINT << 24) + ((xy & 255)::BIGINT << 16) + ((yx & 255)::BIGINT << 8) + (yy & 255)::BIGINT) || ' }]' END
  || chr(10) || 'Index: ' || (id%8) || chr(10) || printf('Quality: %.3f', least(g/180, 1)*100) || chr(10) || printf('Threshold: %.7f', thr) || chr(10) || 'Hash:' || chr(10) || bits || chr(10) || 'PDQF:' || chr(10) || body || chr(10) AS report
FROM bits JOIN body USING (id) JOIN thr USING (id) JOIN grad USING (id) JOIN dih ON ord = id%8"""
)
def format_diagnostic(spark, sf_dir):
    return sinks.diagnostic(H.dihedrals(matrices(spark, sf_dir).withColumnRenamed("id", "image_id"))).select("image_id", "ord", "report")


@query("SELECT l_orderkey, l_linenumber, len // 262144 AS frames, CASE WHEN len % 262144 = 0 THEN 'complete' WHEN len % 512 = 0 THEN 'dropped' ELSE 'error' END AS tail FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 5) * 262144 + (l_suppkey % 3) * 512 + (CASE WHEN l_linenumber % 4 = 0 THEN 7 ELSE 0 END) AS len FROM lineitem)")
def frame_split(spark, sf_dir):
    """The end-of-file rule over file lengths made from lineitem."""
    length = (F.col("l_partkey") % 5) * 262144 + (F.col("l_suppkey") % 3) * 512 + F.when(F.col("l_linenumber") % 4 == 0, 7).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", length.alias("length"))
    return rows.select("l_orderkey", "l_linenumber", F.floor(F.col("length") / 262144).alias("frames"), S.tail(F.col("length"), "luma8").alias("tail"))


@query("SELECT date_trunc('second', ts) AS second, count(*) AS n FROM events GROUP BY 1")
def stats_fps(spark, sf_dir):
    return pipe.per_second(table(spark, sf_dir, "events"), F.col("ts"))


@query()
def random_source(spark, sf_dir):
    """Hashes of seeded random frames, one for each part."""
    return H.hash_frames(S.random_made(_dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id")), "image_id"))).select("image_id", "hash", "quality")


@query(_RGB.replace("@Q", _quantize("rgb") + _gradient()))
def hash_rgb(spark, sf_dir):
    return H.hash_frames(images(spark, sf_dir, "rgb8")).select("image_id", "hash", F.round("quality", 4).alias("quality"))


@query(_RGB.replace("@Q", _quantize("rgb") + _gradient()))
def hash_rgba(spark, sf_dir):
    return H.hash_frames(images(spark, sf_dir, "rgba8")).select("image_id", "hash", F.round("quality", 4).alias("quality"))


@query(_image() + _whole() + _quantize("w", "w") + _gradient() + "SELECT id AS image_id, hash, round(least(g/180, 1), 4) AS quality FROM hashedw JOIN grad USING (id)")
def stream_hash(spark, sf_dir):
    """part as a stream: frames made, hashed and appended to a table until all rows there are taken."""
    base = folder(spark, "stream")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # a pattern, as the stream source takes a plain path for a folder
    stream = spark.readStream.schema(table(spark, sf_dir, "part").schema).parquet(f"{sf_dir}/part.parque[t]").select(*parts.columns)
    out = pipe.pipe(S.synthetic(_dealt(stream, "p_partkey"))).select("image_id", "hash", F.round("quality", 4).alias("quality"))
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(
    _image() + _whole() + _quantize("w", "w") + _gradient() + f""", safe AS (SELECT id, hash, {_WORDS} FROM hashedw),
    good AS (SELECT safe.* FROM safe JOIN grad USING (id) WHERE g > 90)
    SELECT n.id AS needle_id, h.id AS image_id, {_DIST} AS dist, (1 - h.id % 2)::BIGINT AS batch FROM good h JOIN safe n ON {_DIST} <= 31
    WHERE CASE WHEN h.id % 2 = 1 THEN n.id % 3 = 0 ELSE n.id % 3 = 1 OR n.id % 6 = 3 END"""
)
def stream_changing_needles(spark, sf_dir):
    """part as a stream, odd keys first, against images' hashes: needles are added and retired between the batches."""
    base = folder(spark, "watch")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    own = stored(H.hash_frames(images(spark, sf_dir)).select(F.col("image_id").alias("needle_id"), *WORDS), "needles")
    kind = F.col("needle_id") % 3
    book = watch.NeedleBook.create(spark, f"{base}/book", own.where(kind == 0))
    for turn in (1, 0):
        parts.where(F.col("p_partkey") % 2 == turn).coalesce(1).write.mode("append").parquet(f"{base}/in")
        frames = S.synthetic(_dealt(spark.readStream.schema(parts.schema).parquet(f"{base}/in"), "p_partkey"))
        watch.watch(frames, f"{base}/book", f"{base}/out", f"{base}/log").awaitTermination()
        if turn:
            book.add(own.where(kind == 1))
            book.retire(own.where((kind == 0) & (F.col("needle_id") % 2 == 0)))
    return watch.found(spark, f"{base}/out")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
