"""URL rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the (host suffix, path prefix) expressions that a rule could name. The
expressions' SHA-256 digests meet the rules in an equi-join on a short prefix of the digest; the
full digest then confirms a candidate, and precedence picks one rule.

Only label counts and path lengths that some rule has are expanded, so a URL gives at most
(label counts) x (path lengths) expressions however long it is, and none that could fit is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join is on: 32 bits.
PREFIX_HEX = 8
#: Rules up to this number are broadcast; beyond it the join shuffles.
BROADCAST_RULES = 100_000

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _check(rules: Sequence[Rule]) -> None:
    seen = set()
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or (path and path[0] != "/"):
            raise ValueError(f"not a rule: {(verdict, host, path)}")
        if (host, path) in seen:
            raise ValueError(f"two rules for {host}{path}")
        seen.add((host, path))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row (id, host, path, rule, verdict) per row of ``pages``.

    rules are (verdict, host, path). A rule fits its host and all its subdomains if the URL's path
    starts with the rule's path. Of the rules that fit, the one with the longest host and path
    together wins, then the one with the longer host. URLs that no rule fits get ``default`` and a
    null rule; so do null URLs and those without ``://``, whose host and path are empty. Repeated
    rows give repeated results; other columns are not looked at.
    """
    _check(rules)
    known = _short_table(pages, rules)
    labels = sorted({host.count(".") + 1 for _, host, _ in rules})
    lengths = sorted({len(path) for _, _, path in rules})

    judged = pages.select(col(id_col).alias("id"), col(url_col).alias("url"))
    judged = judged.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    suffixes = F.array_distinct(F.array(F.lit(""), *(F.substring_index("host", ".", -k) for k in labels)))
    prefixes = F.array_distinct(F.array(*(F.substring("path", 1, n) for n in lengths or [0])))
    # an empty host suffix fits no rule; it keeps every row in the count below
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = judged.select("id", "host", "path", F.posexplode(pairs).alias("at", "expression"))
    asked = asked.withColumn("asked", F.sha2("expression", 256)).withColumn("short", F.substring("asked", 1, PREFIX_HEX))
    # one row per short prefix, so the join adds no rows
    met = asked.join(F.broadcast(known) if len(rules) <= BROADCAST_RULES else known, "short", "left")
    fits = F.filter("rules", lambda r: r["digest"] == F.col("asked"))
    found = met.select("id", "host", "path", F.col("at"), F.array_max(fits)["rule"].alias("rule"))
    # a URL's expressions lie in one task, so the partial aggregate sends on one row for each URL
    found = found.groupBy("id", "host", "path").agg(F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("rows"), F.max("rule").alias("rule"))
    return found.select(
        F.col("id").alias(id_col), "host", "path",
        F.concat("rule.host", "rule.path").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("copy"),
    ).drop("copy")


def _short_table(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules by the short prefix of their digest; rule is ordered as precedence asks."""
    by_short: dict[str, list] = {}
    for verdict, host, path in rules:
        digest = hashlib.sha256((host + path).encode()).hexdigest()
        by_short.setdefault(digest[:PREFIX_HEX], []).append((digest, (len(host) + len(path), len(host), host, path, verdict)))
    schema = "short string, rules array<struct<digest: string, rule: struct<size: int, host_size: int, host: string, path: string, verdict: string>>>"
    return pages.sparkSession.createDataFrame(sorted(by_short.items()), schema)
