"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes.

A URL is expanded into every host suffix (its host and all parent domains) combined
with every prefix of its path that has the length of some rule's path.  The
expressions and the rules meet in an equi-join on the first bytes of their digests;
the full digests are then compared, and of the rules that fit the longest wins.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: then up to ``?``, ``#`` or the end.  A null URL, or one without ``://``, has
both empty and fits no rule (a rule has a host).  URLs that fit no rule get the
default verdict.  Equal (host, path) pairs are expanded once; with an empty rule table
every URL gets the default.  Of rules with the same expression the smallest verdict
counts (allow before block).  A host has no more suffixes than the longest rule host has labels, whatever its own
length, and a path no more prefixes than rules have lengths, so that very long URLs cost their length once.  An empty table
of pages gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import table

#: Hexadecimal digits of the digest prefix that the join runs on.
PREFIX = 8
#: Rules of the query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The lower-cased host, empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path from its first slash, empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/?[^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    """Hexadecimal digest of a host and path expression."""
    return F.sha2(F.encode(F.concat(host, F.lit("\n"), path), "UTF-8"), 256)


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the winning rule, for the distinct (host, path) pairs of ``urls`` that fit one.

    ``rules`` has host, path (from its slash, or empty) and verdict.
    """
    rules = rules.where("host is not null and host != ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict"))
    rules = rules.select(digest(F.col("host"), F.col("path")).alias("__full"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("__hl"), F.length("path").alias("__pl"), F.size(F.split("host", r"\.")).alias("__labels"))
    lengths = sorted(int(r[0]) for r in rules.select("__pl").distinct().collect())  # no more numbers than the longest path has characters
    most = rules.agg(F.max("__labels")).collect()[0][0] or 1
    labels = F.split("host", r"\.")
    tail = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - most + 1), F.lit(most))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda i: F.array_join(F.slice(tail, i, F.lit(most)), "."))
    prefixes = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())) if lengths else F.array().cast("array<string>")
    pairs = urls.select("host", "path").where("host != ''").distinct()
    expanded = pairs.select("host", "path", F.explode(suffixes).alias("__s")).select("host", "path", "__s", F.explode(prefixes).alias("__p"))
    expanded = expanded.select("host", "path", digest(F.col("__s"), F.col("__p")).alias("__d"))
    short = expanded.withColumn("__k", F.substring("__d", 1, PREFIX))
    joined = short.join(rules.withColumn("__k", F.substring("__full", 1, PREFIX)), "__k").where(F.col("__d") == F.col("__full"))
    rank = F.struct((F.col("__hl") + F.col("__pl")).alias("n"), "__hl", "rule", "verdict")
    return joined.groupBy("host", "path").agg(F.max(rank).alias("__w")).select("host", "path", "__w.rule", "__w.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = match(parsed, rules)
    return parsed.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


_ORACLE_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP10_SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {_ORACLE_RULES}),
parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*(/?[^?#]*)', 1, 's'), '') AS path
  FROM pages),
urls AS (SELECT DISTINCT host, path FROM parsed),
fits AS (
  SELECT host, path, rh || rp AS rule, rv AS verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS place
  FROM urls JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.place = 1
"""
