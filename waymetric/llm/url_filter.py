"""Operator 1: URL filters by hashed host-suffix and path-prefix expressions.

Each URL expands into every (host suffix, path prefix) expression that a rule
could name; the expressions meet the rules in an equi-join on a 32-bit prefix of
their SHA-256; full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, ascii_lower

#: (action, host, path) as the contract states them.
PAGE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def filter_urls(df: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id_col, host, path, rule, verdict.

    A rule fits its host and all subdomains when the path starts with the rule's
    path.  The longest rule (host and path together) wins; between equally long
    ones the longer host, then block.  Rules repeated or without host or path are
    dropped.  No fitting rule: rule null, verdict `default`.  A null URL, or one
    without ://, has empty host and path and fits no rule.  Other input columns
    are ignored, so clashing names do no harm; repeated and null ids each keep
    their row.  Empty rules or an empty table are fine.

    Work per URL is label counts x path lengths that rules have, never x rules, however
    long the host or the path; a very long URL is one row as any other.
    Spark broadcasts the rules only under its size threshold; beyond it the
    join is a sort-merge join on the hash prefix that AQE can split.
    """
    rules = (
        rules.where("host is not null and path is not null and action in ('allow', 'block')")
        .groupBy(F.lower("host").alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("action").alias("r_action"))  # block after allow
        .withColumn("rule", F.concat("r_host", "r_path"))
        .withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
        .withColumn("prefix", _prefix(F.col("r_digest")))
    )
    # distinct path lengths of the rules: at most the longest path's length
    lengths = [r[0] for r in rules.select(F.length("r_path")).distinct().collect()]
    pages = Rows.of(df).select(id=F.col(id_col), host=url_host(F.col(url_col)), path=url_path(F.col(url_col)))
    # suffixes only of as many labels as rules have, so that a host of very many labels costs no more
    counts = [r[0] for r in rules.select(F.size(F.split("r_host", r"\.")).alias("n")).distinct().collect()]
    n_labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    ends = [F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in counts]
    suffixes = F.array_compact(F.array(*ends).cast("array<string>"))
    lens = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expr = (
        pages.where("host <> ''")
        .select("row", "path", F.explode(suffixes).alias("suffix"))
        .select("row", "suffix", F.explode(F.transform(lens, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("start"))
        .select("row", F.sha2(F.concat_ws("\n", "suffix", "start"), 256).alias("digest"))
        .withColumn("prefix", _prefix(F.col("digest")))
    )
    best = (
        expr.join(rules, "prefix")
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy("row")
        .agg(F.max(F.struct(F.length("rule").alias("len"), F.length("r_host").alias("host_len"), F.col("r_action"), F.col("rule"))).alias("best"))
    )
    return pages.join(best, "row", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_action", F.lit(default)).alias("verdict")
    )


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
