"""URL filters: explicit host and path rules first, then mined association rules.

Explicit rules name a host and a path prefix, fit all subdomains, and the longest that
fits wins.  Urls that none fits are judged by rules that Spark's FP-growth mines from
labelled urls: token combinations that imply a bad label, pruned by support (LEAST_PAGES
bad pages, however many are labelled), by confidence, whose lower bound must exceed the
share of bad pages, and by shorter rules that imply them.  Tokens that occur in the same
labelled urls stand for one another: only the least is mined, so that copies of one long
url do not multiply combinations.  Mined rules are an inverted index under
their rarest token, with one row for each token, so a url meets each of its tokens once
and no pair of url and rule is written out.

Labels: a page is bad if its document is toxic or of quality 0.

Edge cases: a null url, or one without ``://``, has an empty host and path and no tokens,
and is allowed; repeated pages are judged alike; without bad labels nothing is mined;
html and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Support: the least bad labelled pages that hold a rule's tokens, at every size.
LEAST_PAGES = 10
CONFIDENCE = 0.6
#: Standard errors below the confidence that must still exceed the share of bad pages (many rules are tried).
DEVIATIONS = 3.0
SALTS = 16
BAD = "label=bad"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host_of: Column, path_of: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host_of == h) | F.endswith(host_of, F.lit("." + h))) & F.startswith(path_of, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct words and numbers of host, path and query; rare ones fall to the support."""
    after = F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.filter(F.split(after, r"[^a-z0-9_\x80-\x{10FFFF}-]+"), lambda t: F.length(t) > 0))


def _lower(share: Column, n: Column, z: float = DEVIATIONS) -> Column:
    """Wilson's lower bound of a share of n."""
    root = F.sqrt(share * (1 - share) / n + F.lit(z * z / 4) / (n * n))
    return (share + F.lit(z * z / 2) / n - z * root) / (1 + F.lit(z * z) / n)


def _salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _baskets(rows: DataFrame, least: int) -> DataFrame:
    """Items of each row (row, url, tokens, bad): its tokens of enough rows, one for those that share their rows, and the label."""
    each = rows.select("row", F.explode("tokens").alias("t"), *(F.xxhash64("url", F.lit(k)).cast("decimal(38,0)").alias(f"h{k}") for k in range(2)))
    places = each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("h0").alias("a"), F.sum("h1").alias("b")).where(F.col("n") >= least)
    single = places.groupBy("n", "a", "b").agg(F.min("t").alias("t")).select("t")
    mined = each.select("row", "t", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")).join(_salt(single), ["t", "salt"])
    items = mined.groupBy("row").agg(F.collect_list("t").alias("items"))
    return rows.join(items, "row").select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))


def mine(labelled: DataFrame, least: int = LEAST_PAGES, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, support, confidence) of rules; labelled: url, bad (boolean)."""
    from pyspark.ml.fpm import FPGrowth

    scratch = Scratch(labelled.sparkSession, "urlrules")
    rows = labelled.select(F.monotonically_increasing_id().alias("row"), "url", tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad"))
    rows = scratch.table(rows.where(F.size("tokens") > 0))
    total, bad_pages = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    baskets, filled = scratch.counted(_baskets(rows, least))
    if not filled or bad_pages < least:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, support double, confidence double")
    # half a page less, since the least count is the product rounded up
    sets = scratch.table(FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / filled)).fit(baskets).freqItemsets)
    plain = sets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("all"))
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1) & (F.col("freq") >= least)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), "freq")
    rules = bad.join(plain, "tokens").withColumn("confidence", F.col("freq") / F.col("all"))
    rules = rules.where((F.col("confidence") >= confidence) & (_lower(F.col("confidence"), F.col("all")) > bad_pages / total)).select("tokens", (F.col("freq") / total).alias("support"), "confidence")
    # a rule that drops one token and holds as well says the same about more urls
    rules = scratch.table(rules)
    shorter = rules.select(F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("less"), "tokens", "confidence")
    idle = shorter.join(rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("other")), "less").where("other >= confidence").select("tokens").distinct()
    return rules.join(idle, "tokens", "left_anti")


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, sets): rules under their rarest token among urls (with column tokens)."""
    often = urls.select(F.explode("tokens").alias("t")).groupBy("t").count()
    each = rules.select("tokens", F.explode("tokens").alias("t")).join(often, "t", "left")
    rare = each.groupBy("tokens").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), F.col("t").alias("t"))).alias("x"))
    return rare.groupBy(F.col("x.t").alias("t")).agg(F.collect_list("tokens").alias("sets"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule matched) for pages (page_id, url) and labels (doc_id, quality, toxic)."""
    scratch = Scratch(pages.sparkSession, "urlrules")
    pages = pages.select("page_id", "url")
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    found = mine(pages.join(marks, "page_id").select("url", "bad"))
    urls = scratch.table(pages.where("url is not null").select("url", tokens(F.col("url")).alias("tokens")).distinct())
    at = urls.select("url", "tokens", F.explode("tokens").alias("t")).join(index(found, urls), "t")
    hit = at.where(F.exists("sets", lambda s: F.size(F.array_except(s, F.col("tokens"))) == 0)).select("url").distinct().withColumn("mined", F.lit(True))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(_salt(hit), ["url", "salt"], "left").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.coalesce("mined", F.lit(False)).alias("mined"))
    out = out.withColumn("x", explicit(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.coalesce("x.verdict", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
