"""Quality rules with verdicts on hosts: failures per host, shrunk by a prior fitted over hosts. All on the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sqlcorpus.llm.tables import split_words, stage

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SYMBOLS = "#*$%&|<>"
MAX_HOST_RATE = 0.5  # a host whose shrunk rate of failing documents is above this loses them all
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, ``host`` and the base measures of each text (null: no words)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    # windows as (hash, place), sorted: equal ones are neighbours, so no place is compared with all others
    places = F.sequence(F.lit(1), F.col("n") - 2)
    windows = F.when(F.col("n") >= 3, F.sort_array(F.transform(places, lambda i: F.struct(
        F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)).alias("h"), i.alias("i")))))
    same = F.zip_with(
        F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.when(F.size("s") >= 2, F.size(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    return (
        docs.select(
            F.col("doc_id").alias("doc_id"), F.col(host).alias("host"), split_words(F.col("text")).alias("w"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
        .withColumn("n", F.size("w")).withColumn("s", windows)
        .select("doc_id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    )


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host``, ``n_docs``, ``n_failed``, ``rate`` (shrunk), ``host_kept``, one row per non-null host.

    The prior is a beta distribution with the mean and variance of the hosts' rates (method of
    moments); it weighs as much as one document where hosts do not differ or there is one only.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = stage(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()  # one row
    mean = moments["m"] if moments["m"] is not None else 0.0
    spread = moments["v"] or 0.0
    weight = max(1.0, mean * (1 - mean) / spread - 1) if spread > 0 else 1.0
    shrunk = (F.col("n_failed") + F.lit(float(mean * weight))) / (F.col("n_docs") + F.lit(float(weight)))
    return hosts.withColumn("rate", shrunk).withColumn("host_kept", F.col("rate") <= max_rate)


def judge_quality(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Base measures, ``base_failed``, the host's shrunk ``host_rate``, and ``kept``.

    ``kept`` is false if the document fails itself or its host is rejected. A document with no
    host (null) is judged by itself, ``host_rate`` null. Null and empty texts have no words and
    fail. Repeated rows count as documents of their own; an empty table gives an empty one.
    Other columns are not read.
    """
    rows = stage(measures(docs, host))
    hosts = host_verdicts(rows, max_rate).select("host", F.col("rate").alias("host_rate"), "host_kept")
    return rows.join(hosts, "host", "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).drop("host_kept")
