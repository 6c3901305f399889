"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Every URL is expanded into the host suffixes and path prefixes that a rule could have. The
expressions meet the rules in an equi-join on the first digits of a digest; the full digest
confirms a match and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumentab.llm.words import lower_ascii

#: Hex digits of the digest that the join uses.
PREFIX = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = lower_ascii(F.regexp_extract(text, r"://([^/?#]*)", 1))
    return host, F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # a host has no slash, so the first one ends it
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def _rule_table(rules: DataFrame) -> DataFrame:
    """One row per rule; where a rule is given with both verdicts, block holds."""
    clean = rules.select(
        lower_ascii(F.coalesce("host", F.lit(""))).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        "verdict",
    ).filter("verdict in ('allow', 'block')")
    one = clean.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return one.withColumn("rule_digest", digest).withColumn("key", F.substring("rule_digest", 1, PREFIX))


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, key, digest``: the expressions of each distinct host and path.

    Only suffixes and prefixes as long as some rule's are made, so a URL yields at most its
    host labels times the distinct path lengths, however long it is. The two length lists are
    bounded by the longest rule and reach the scan as scalar subqueries.
    """
    urls = urls.withColumn("host_lengths", rules.agg(F.collect_set(F.length("rule_host"))).scalar())
    urls = urls.withColumn("path_lengths", rules.agg(F.collect_set(F.length("rule_path"))).scalar())
    host, path = F.col("host"), F.col("path")
    n = F.length(host)
    fits = lambda k: (k == n) | ((k > 0) & (k < n) & (F.substr(host, n - k, F.lit(1)) == "."))
    hosts = F.transform(F.filter("host_lengths", fits), lambda k: F.right(host, k))
    paths = F.transform(F.filter("path_lengths", lambda k: k <= F.length(path)), lambda k: F.left(path, k))
    wide = urls.withColumn("suffix", F.explode(hosts)).withColumn("prefix", F.explode(paths))
    digest = _digest(F.col("suffix"), F.col("prefix"))
    return wide.select("host", "path", digest.alias("digest")).withColumn("key", F.substring("digest", 1, PREFIX))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and the host's subdomains where
    the path starts with the rule's. The longest rule (host and path together, then the longer
    host) decides; without one ``rule`` is null and ``verdict`` is ``default``.

    Defined cases: a null URL or one without ``://`` has an empty host and path and is judged
    like any other; null and repeated ids keep their rows; an empty rule table gives the default
    everywhere; other columns of ``pages`` are not read. Equal URLs are judged once: distinct
    host and path pairs are combined before the shuffle, so a host that holds a third of all
    rows costs its distinct paths only, and the join back may be split by key skew.
    """
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    table = _rule_table(rules)
    found = (
        expressions(urls.select("host", "path").distinct(), table)
        .join(table, "key")
        .filter(F.col("digest") == F.col("rule_digest"))
    )
    rule = F.concat("rule_host", "rule_path")
    best = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), F.col("verdict"))).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
