"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join of the possible hits.

A rule is a host and the beginning of a path.  A URL meets it under one of a few keys: a suffix of its host at a dot,
with the beginning of its path of a length that the list has.  A blocked Bloom filter keeps all bits of a key in one
block of 64 bits, so testing keys is an equi-join with a small table of blocks.  Keys that pass are joined with the
rules themselves, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import jobs

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Keys of a block, bits set for a key, and blocks up to which the filter is sent to every task (16 bytes each).
KEYS, BITS, BROADCAST_BLOCKS = 4, 5, 4_000_000


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    mixed = F.xxhash64(key, F.lit("bits"))
    bits = []
    for k in range(BITS):
        bits.append(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftright", mixed, F.lit(6 * k)).bitwiseAND(F.lit(63).cast("bigint")).cast("int")))
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def verdicts(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) of urls; rule is null where none fits.

    rules: (rule_host, rule_path, verdict).  A rule fits its host and all subdomains if the path starts with the
    rule's; the longest host and path together win, then the longest host, then `block`.  Empty hosts and rules with
    nulls fit nothing.  Without a fitting rule the verdict is `default`: nothing is listed that the filter could hit.
    """
    rules = rules.where("rule_host is not null and rule_path is not null and verdict is not null").withColumn("rule_host", lowered(F.col("rule_host")))
    rules = rules.withColumn("key", F.concat_ws("/", F.col("rule_host"), F.col("rule_path"))).dropDuplicates(["key", "verdict"])
    shape = rules.agg(F.countDistinct("key").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    distinct = urls.select("host", "path").distinct()
    if not shape["n"]:
        return distinct.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = max(1, -(-shape["n"] // KEYS))
    filter_ = rules.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))
    if blocks <= BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    lengths = F.filter(F.array(*map(F.lit, shape["lengths"])), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.concat_ws("/", h, F.col("path").substr(F.lit(1), n)))))
    asked = distinct.where("host <> ''").withColumn("key", F.explode(keys))
    possible = asked.withColumn("block", _block(F.col("key"), blocks)).withColumn("mask", _mask(F.col("key"))).join(filter_, "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    hits = possible.select("host", "path", "key").join(rules.select("key", "rule_host", "rule_path", "verdict"), "key")
    size = F.length("rule_host") + F.length("rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), F.length("rule_host").alias("host_size"), F.col("verdict"), F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with the columns host, path, rule and verdict, which replace columns of these names."""
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    found = verdicts(pages, rules, default)
    same = (F.col("page.host") == F.col("judged.host")) & (F.col("page.path") == F.col("judged.path"))
    joined = pages.alias("page").join(found.alias("judged"), same, "left")
    return joined.select("page.*", "judged.rule", F.coalesce("judged.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `pages` under the four rules."""
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, verdict string")
    return judge(jobs.table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
  SELECT p.*, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS nth
  FROM parts p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE nth = 1
"""
