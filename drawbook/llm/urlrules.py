"""URL rules by hashed host-suffix and path-prefix expressions.

Each distinct URL is expanded into host suffixes times directory prefixes. An expression and a rule meet where the first
32 bits of their SHA-256 agree; the whole digest of the rule's own length of path then confirms the hit, and the longest
confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.llm.rows import Numbered

RESULTS = ["host", "path", "rule", "verdict"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where ``://`` is missing."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def directory(path: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(path, r"^[\s\S]*/", 0)


def short_hash(expression: Column) -> Column:
    return F.substring(F.sha2(expression, 256), 1, 8)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``; rules with a null host or path are ignored. A rule fits its host and
    all subdomains where the URL's path starts with the rule's path. The longest rule (host and path together) wins; of
    equally long ones that with the longer host, then ``block`` before ``allow``. URLs that no rule fits get ``default``.
    Every input row gives one output row, repeated rows too; input columns with the four names are replaced.
    """
    rules = (
        rules.where("host is not null and path is not null")
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .distinct()
        .withColumn("r_rule", F.concat("r_host", "r_path"))
        .withColumn("r_digest", F.sha2("r_rule", 256))
        .withColumn("r_short", short_hash(F.concat(F.col("r_host"), directory(F.col("r_path")))))
    )
    # No rule is deeper than these, so longer suffixes and prefixes of a URL can't meet one.
    depth = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.size(F.split("r_path", "/")) - 1).alias("slashes")).first()
    labels, slashes = depth["labels"] or 0, depth["slashes"] or 0

    table = Numbered(pages, RESULTS)
    host, path = split_url(table.column(url_col))
    judged = table.rows.withColumns({"host": host, "path": path})
    parts, steps = F.split("u_host", r"\."), F.split("u_path", "/")
    suffixes = F.transform(F.sequence(F.greatest(F.size("u_labels") - F.lit(labels - 1), F.lit(1)), F.size("u_labels")),
                           lambda i: F.array_join(F.slice("u_labels", i, F.size("u_labels")), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size("u_steps") - 1, F.lit(slashes))),
                           lambda i: F.concat(F.array_join(F.slice("u_steps", F.lit(1), i), "/"), F.when(i > 0, F.lit("/")).otherwise(F.lit(""))))
    expressions = (
        judged.select(F.col("host").alias("u_host"), F.col("path").alias("u_path")).distinct()
        .withColumns({"u_labels": parts, "u_steps": steps})
        .select("u_host", "u_path", suffixes.alias("u_suffixes"), F.explode(prefixes).alias("u_prefix"))
        .select("u_host", "u_path", "u_prefix", F.explode("u_suffixes").alias("u_suffix"))
        .withColumn("u_short", short_hash(F.concat("u_suffix", "u_prefix")))
    )
    confirmed = (F.col("r_host") == F.col("u_suffix")) & (F.col("r_digest") == F.sha2(F.concat(F.col("u_suffix"), F.expr("left(u_path, length(r_path))")), 256))
    winner = F.max_by(F.struct("r_rule", "r_verdict"), F.struct(F.length("r_rule"), F.length("r_host"), F.col("r_verdict") == "block", "r_rule"))
    verdicts = (
        expressions.join(rules, (F.col("u_short") == F.col("r_short")) & confirmed)
        .groupBy("u_host", "u_path").agg(winner.alias("u_won"))
    )
    return (
        judged.join(verdicts, (F.col("host") == F.col("u_host")) & (F.col("path") == F.col("u_path")), "left")
        .select(*table.restored(RESULTS), "host", "path", F.col("u_won.r_rule").alias("rule"), F.coalesce("u_won.r_verdict", F.lit(default)).alias("verdict"))
    )
