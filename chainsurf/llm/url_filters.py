"""URL filter lists: host-suffix and path-prefix expressions against hashed rules.

Every distinct (host, path) is expanded into its host suffixes, of as many labels as rules
have at most, times the path prefixes of the lengths that rules have.  Expressions meet rules by an equi-join on
the first four bytes of their SHA-256; the full digest then confirms, and the longest
rule wins (ties: the longer host, then block before allow).

Defined cases: a null url, or one without ``://``, has an empty host and path, which
no rule fits; without a fitting rule the verdict is ``default``; repeated rows each
get the verdict; an empty table or an empty rule list works; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hosts, with all their subdomains, that the method itself blocks where no rule fits.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, most: int) -> Column:
    """``a.b.c`` -> [c, b.c, a.b.c], as far as ``most`` labels."""
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    return F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(most))), lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def hashed(rules: DataFrame) -> DataFrame:
    """(prefix, digest, rule, rule_verdict, rule_host) of a table (verdict, host, path)."""
    rule = F.concat("host", "path")
    digest = F.sha2(F.concat("host", F.lit("\0"), "path"), 256)
    return rules.select(F.substring(digest, 1, 8).alias("prefix"), digest.alias("digest"), rule.alias("rule"), F.col("verdict").alias("rule_verdict"), F.col("host").alias("rule_host")).distinct()


def expressions(sites: DataFrame, lengths: list[int], labels: int) -> DataFrame:
    """(host, path, prefix, digest) for each expression of each row of ``sites`` (host, path), of ``labels`` host labels at most."""
    pieces = F.filter(F.transform(F.array(*[F.lit(x) for x in lengths]), lambda n: F.when(F.length("path") >= n, F.expr("path").substr(F.lit(1), n))), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    out = sites.withColumn("suffix", F.explode(host_suffixes(F.col("host"), labels))).withColumn("piece", F.explode(pieces))
    digest = F.sha2(F.concat("suffix", F.lit("\0"), "piece"), 256)
    return out.select("host", "path", F.substring(digest, 1, 8).alias("prefix"), digest.alias("found"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", blocked: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``.

    ``blocked`` (host): a further list that blocks hosts where no rule fits, by the same
    hashed expressions.

    The distinct lengths of rule paths (at most the longest path's length) and the most
    labels of a rule host are read first: no longer expression can fit, however many labels
    a url has.  A third of all urls on one host is harmless: only distinct sites are
    expanded, and urls without a host meet no rule at all.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    hosts = rules.select("host") if blocked is None else rules.select("host").union(blocked.select("host"))
    labels = hosts.agg(F.max(F.length("host") - F.length(F.translate("host", ".", "")) + 1)).first()[0] or 1
    known = hashed(rules).withColumn("listed", F.lit(False))
    if blocked is not None:
        known = known.unionByName(hashed(blocked.select(F.lit("block").alias("verdict"), "host", F.lit("").alias("path"))).withColumn("listed", F.lit(True)))
        lengths = sorted({0, *lengths})
    split = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    sites = split.filter("host <> ''").select("host", "path").distinct()
    won = F.max(F.struct(~F.col("listed"), F.length("rule"), F.length("rule_host"), "rule_verdict", F.when(~F.col("listed"), F.col("rule")).alias("rule")))
    best = (
        expressions(sites, lengths, labels)
        .join(known, "prefix")
        .filter("found = digest")
        .groupBy("host", "path")
        .agg(won.alias("won"))
        .select("host", "path", F.col("won.rule").alias("rule"), F.col("won.rule_verdict").alias("rule_verdict"))
    )
    judged = split.filter("host <> ''").join(best, ["host", "path"], "left").select(key, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(split.filter("host = ''").select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
