"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.tables import lower_ascii, shielded

#: Hexadecimal digits of the digest that the join compares first.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?``, ``#``; A-Z in lower case; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def url_path(url: Column) -> Column:
    """Text after the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    """Host and path cannot run into each other: a host holds no ``/`` and a path that is not empty starts with it."""
    return F.sha2(F.encode(F.concat(host, path), "UTF-8"), 256)


@shielded
def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all hosts below it if the
    path starts with the rule's path. The longest fitting rule (characters of host and path) wins; of equally long ones
    the one that blocks, then the first by text. URLs that no rule fits get ``default`` and a null rule. Null or
    malformed URLs have an empty host and path, which only a rule with both empty would fit; rules with a null host,
    path or verdict are left out. Rows that repeat are all returned; columns of ``urls`` with the added names are replaced.

    Each distinct host and path is judged once. Its expressions are all host suffixes at dots times the path prefixes of
    the lengths that rules have, so their number does not depend on the number of rules. The lengths are read from the
    rules when the plan is built: at most as many as the longest path has characters.
    """
    rules = rules.select("host", "path", "verdict").filter("host is not null and path is not null and verdict is not null")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    keyed = rules.distinct().select(
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    judged = urls.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    parts = judged.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    starts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    fitting = F.filter(starts, lambda n: n <= F.length("path"))
    expressions = (
        parts.withColumn("suffix", F.explode(suffixes))
        .withColumn("n", F.explode(fitting))
        .withColumn("digest", _digest(F.col("suffix"), F.expr("substring(path, 1, n)")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    rank = F.struct(
        F.length("rule").alias("length"), (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict"
    )
    best = (
        expressions.join(keyed, "prefix")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(rank).alias("best"))
    )
    return judged.join(best, ["host", "path"], "left").select(
        *judged.columns,
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
