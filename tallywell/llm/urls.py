"""URL filters: host suffixes and path prefixes joined to rules through short hashes.

A URL is expanded into expressions: every suffix of its host at a label boundary, with every prefix of its path that is
empty or ends in a slash. A rule is one expression too: its host, with its path up to the last slash. URLs and rules
meet in an equi-join on the first PREFIX hex digits of the expression's SHA-256, are confirmed on the full digest, and
then on the rest of the rule's path. Of the rules that fit a URL, the highest precedence wins, then the longest rule,
then the longer host, then `block`. All of it is DataFrame work without Python code.

Distinct URLs are judged once and joined back to their pages, so a URL that many pages share costs as much as any other.
Expressions are limited to as many labels and slashes as the rules have, which loses none that could meet a rule.

Defined results: a null URL, and one without `://`, has an empty host and path, fits no rule and gets the default
verdict; rows that repeat a page get a row each; an empty table of rules leaves the default. Other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: str) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: str) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the full digest of an expression and the short hash that the join uses."""
    rows = rows.withColumn("digest", F.sha2("expression", 256))
    return rows.withColumn("short", F.substring("digest", 1, PREFIX))


def keyed_rules(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict, precedence."""
    rules = rules.select(_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict", "precedence")
    upto = F.regexp_extract("rule_path", r"(?s)^(.*/)", 1)
    return _keyed(rules.withColumn("expression", F.concat("rule_host", upto)))


def expressions(urls: DataFrame, labels: int, slashes: int) -> DataFrame:
    """One row per URL and expression, of at most so many labels and slashes."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    pieces = F.split("path", "/")
    depth = F.least(F.size(pieces) - 1, F.lit(slashes))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/"))))
    return (urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
            .select("url", "path", F.concat("suffix", "prefix").alias("expression")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: page_id, url, host, path, rule_host, rule_path, precedence (null without a rule), verdict."""
    size = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"),
                     F.max(F.size(F.split("path", "/")) - 1).alias("slashes")).first()
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    urls = urls.select("url", host_of("url").alias("host"), path_of("url").alias("path"))
    met = (_keyed(expressions(urls, size["labels"] or 1, size["slashes"] or 0)).alias("u")
           .join(keyed_rules(rules).alias("r"), "short")
           .where((F.col("u.digest") == F.col("r.digest")) & F.startswith("path", "rule_path")))
    order = F.struct("precedence", (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("labels"),
                     "verdict", "rule_host", "rule_path")
    best = met.groupBy("url").agg(F.max(order).alias("best"))
    return (pages.select("page_id", "url").join(best, "url", "left")
            .select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"), "best.rule_host", "best.rule_path",
                    "best.precedence", F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
