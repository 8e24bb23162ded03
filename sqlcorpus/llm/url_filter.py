"""URL filters: host suffixes and path prefixes looked up by short hashes, confirmed by whole digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX_DIGITS = 8  # hexadecimal digits of the digest that the join uses


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    # a path is empty or starts with a slash, which no host has: the two cannot run together
    return F.sha2(F.concat(host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` for every page.

    ``rules``: ``host``, ``path`` (empty, or with a leading slash), ``verdict``. A rule fits its
    host and all below it, if the path starts with the rule's. The longest fitting rule wins
    (of equally long ones the one with the longer host; of equal rules a block). A URL is expanded only
    to the host depths and path lengths that occur among the rules, which loses nothing.
    No fitting rule, or a null URL: ``rule`` is null and the verdict the default. Rules with a null
    host, path or verdict fit nothing. Repeated pages are each judged; extra columns are not read.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    one = rules.groupBy("r_host", "r_path").agg(F.max(F.struct((F.col("r_verdict") == "block").alias("b"), "r_verdict")).alias("v"))
    known = one.select(
        digest(F.col("r_host"), F.col("r_path")).alias("r_digest"),
        F.concat("r_host", F.when(F.col("r_path") == "", "").otherwise(F.col("r_path"))).alias("rule"),
        (F.length("r_host") + F.length("r_path")).alias("long"), F.length("r_host").alias("host_long"),
        F.col("v.r_verdict").alias("r_verdict")).withColumn("short", F.substring("r_digest", 1, PREFIX_DIGITS))
    # depths of hosts and lengths of paths: no more values than a URL has characters
    shapes = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.", -1)))).alias("depths"),
        F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths")).first()
    depths, lengths = (F.array(*[F.lit(v) for v in vs]).cast("array<int>") for vs in (shapes["depths"], shapes["lengths"]))

    urls = pages.select("url").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.filter(depths, lambda d: d <= F.size(labels)),
                           lambda d: F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    terms = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: digest(s, p))))
    expanded = urls.where("url is not null").select("url", F.explode(terms).alias("digest")).withColumn(
        "short", F.substring("digest", 1, PREFIX_DIGITS))
    best = (
        expanded.join(known, "short").where("digest = r_digest").groupBy("url")
        .agg(F.max(F.struct("long", "host_long", "rule", "r_verdict")).alias("best"))
        .select(F.col("url").alias("b_url"), "best.rule", "best.r_verdict")
    )
    rows = pages.select(F.col("page_id"), F.col("url"))
    return rows.join(best, rows["url"] == best["b_url"], "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("r_verdict", F.lit(default)).alias("verdict"))
