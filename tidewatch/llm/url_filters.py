"""URL filters: host suffixes and path prefixes looked up by short hash prefixes, confirmed by full digests.

A rule names a host and the start of a path. It fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's path. Each URL is expanded into the expressions (last k labels of the host, first m characters of
the path) for the shapes (k, m) that rules have, so neither a host of a thousand labels nor a long path makes more
expressions than there are shapes. Expressions meet rules by the first PREFIX_HEX digits of their SHA-256; what shares
them by chance goes when full digests are compared. Of the rules that fit, the longest one decides.

Everything is built of DataFrame functions. URLs keep a row number of their own, so repeated URLs and hot hosts are spread
like any other rows; rules are broadcast up to BROADCAST_RULES, and beyond that expressions are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written

#: Hexadecimal digits of a digest that the equi-join compares: 32 bits.
PREFIX_HEX = 8
#: Rules up to here (some 20 MB) are sent to every executor; more are shuffled, each to SALTS places.
BROADCAST_RULES, SALTS = 100_000, 16
#: Verdict where no rule fits.
DEFAULT = "allow"
#: The rules of the registered query: host, start of the path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded) and path (from there up to ``?``, ``#`` or the end).

    Both are empty for null and without ``://``.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _CAPITALS, _SMALL), path


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules once each: labels and chars (their shape), digest, prefix, and rank, of which the highest one decides.

    rules: host, path, verdict (allow or block). A rule without a host or a verdict fits nothing; a null path is empty. The
    longer rule (characters of host and path together) ranks higher, of equally long ones that with the longer host; a
    rule listed with both verdicts blocks. Rules that fit one URL are ends of one host and starts of one path, so rank holds
    their two lengths and the verdict, and the rule can be read off the URL again.
    """
    host, path = F.translate("host", _CAPITALS, _SMALL), F.coalesce("path", F.lit(""))
    each = rules.where("host <> '' AND verdict IS NOT NULL").select(host.alias("host"), path.alias("path"), (F.col("verdict") == "block").cast("long").alias("blocks"))
    once = each.groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    long_host, long_path = F.length("host").cast("long"), F.length("path")
    rank = (long_host + long_path) * F.lit(1 << 32) + long_host * 2 + F.col("blocks")
    shaped = once.select(_labels(F.col("host")).alias("labels"), long_path.alias("chars"), _digest(F.col("host"), F.col("path")).alias("digest"), rank.alias("rank"))
    return shaped.withColumn("prefix", F.left("digest", F.lit(PREFIX_HEX)))


def _digest(host: Column, path: Column) -> Column:
    """Of an expression; the host's length comes first, so that no other pair reads the same."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def expressions(shapes: list[tuple[int, int]], host: Column, path: Column) -> Column:
    """The expressions (array of struct<host, path>) that rules of these shapes could be equal to."""
    if not shapes:
        return F.array().cast("array<struct<host: string, path: string>>")
    listed = F.array(*(F.struct(F.lit(k).alias("labels"), F.lit(m).alias("chars")) for k, m in shapes))
    possible = F.filter(listed, lambda s: (_labels(host) >= s["labels"]) & (F.length(path) >= s["chars"]))
    return F.transform(possible, lambda s: F.struct(F.call_function("substring_index", host, F.lit("."), -s["labels"]).alias("host"), F.left(path, s["chars"]).alias("path")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (host and path; null if none fits), verdict.

    Null URLs and those without ``://`` have an empty host and path; an empty path does not start with ``/``. Repeated rows are
    judged each for itself, a null page_id stays null, extra columns are ignored. Without rules every URL gets the default;
    an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    urls = written(pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")), "urls")
    known = written(prepared(rules), "rules")
    shapes = sorted((r["labels"], r["chars"]) for r in known.select("labels", "chars").distinct().collect())  # labels of hosts x lengths of paths
    each = urls.select("row", F.explode(expressions(shapes, F.col("host"), F.col("path"))).alias("e"))
    keyed = each.select("row", _digest(F.col("e.host"), F.col("e.path")).alias("seen")).withColumn("prefix", F.left("seen", F.lit(PREFIX_HEX)))
    sought = known.select("prefix", "digest", "rank")
    if known.count() <= BROADCAST_RULES:
        met = keyed.join(F.broadcast(sought), "prefix")
    else:
        salted = sought.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"])
    best = met.where("seen = digest").groupBy("row").agg(F.max("rank").alias("rank"))
    long_host = F.expr("cast((rank % 4294967296) div 2 AS int)")
    rule = F.concat(F.right("host", long_host), F.left("path", F.expr("cast(rank div 4294967296 AS int)") - long_host))
    verdict = F.when(F.col("rank") % 2 == 1, "block").when(F.col("rank") % 2 == 0, "allow").otherwise(default)
    return urls.join(best, "row", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def url_report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page under RULES."""
    return judge(pages, pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string"))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
#: url_report in DuckDB SQL.
REPORT_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {_RULES_SQL}) AS r(rule_host, rule_path, rule_verdict)),
cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT n, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS name FROM cut),
parsed AS (SELECT n, page_id, translate(name, '{_CAPITALS}', '{_SMALL}') AS host, regexp_extract(substr(rest, length(name) + 1), '^[^?#]*') AS path FROM named),
fits AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{DEFAULT}') AS verdict FROM parsed LEFT JOIN (SELECT n, rule, rule_verdict FROM fits WHERE place = 1) AS f USING (n)
"""
