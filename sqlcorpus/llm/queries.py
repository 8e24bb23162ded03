"""Each operator as a query over its whole table, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus.llm import (
    forest, langid, line_dedup, main_text, minhash, mixing, quality, repair, sentence_pieces, substring_dedup, suffix_dedup, url_filter,
    whitening,
)
from sqlcorpus.llm.repair_sql import REPAIR_SQL

PIECE_MODEL = "piece_bpe_32k.model"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(PIECE_MODEL), "rb") as file:
        return file.read()


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_shingles").cast("long"), "component_id", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentence_pieces.encode(docs, piece_model(), ("n_tokens", "ids_sha256", "decoded_sha256"))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.element_at("ends", -1).cast("long").alias("n_source_bytes"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, F.col("doc_id").isNotNull() & ~held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.report(repair.repair_conversations(rows, times="times"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_minhash_near_dedup, op2_quality_rules, op3_mix_sources, op4_url_filter, op5_suffix_array_dedup,
        op6_embedding_near_dedup, op7_sentence_pieces, op8_substring_dedup, op9_line_dedup, op10_language_id,
        op11_conversation_repair, op12_main_text, op13_embedding_whitening)}


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
BLANK_SQL = r"'[\x20\x09-\x0D]'"

QUALITY_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
often AS (SELECT r, a, b, c FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows JOIN often USING (r, a, b, c), range(3) t(k) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_replace(line, {BLANK_SQL}, '', 'g') <> '' GROUP BY r),
measured AS (
  SELECT base.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, {BLANK_SQL}, '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN lines ON base.r = lines.r LEFT JOIN covered ON base.r = covered.r),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(1, m * (1 - m) / v - 1) ELSE 1 END AS s
  FROM (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts)),
verdicts AS (SELECT source, (f + m * s) / (n + s) <= {quality.MAX_HOST_RATE} AS good FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(good, true) AS kept
FROM judged LEFT JOIN verdicts ON judged.source = verdicts.source
"""

URL_SQL = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM pages),
rules(h, p, v) AS (VALUES """ + ", ".join(str(r) for r in RULES) + """),
fits AS (
  SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)
"""

# ids are unique in the given tables, so that id and place order all windows
LINE_STEPS = """
{name}_lines AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM {source}),
{name}_windows AS (
  SELECT doc_id, i, [l[i], l[i + 1], l[i + 2]] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM {name}_lines)),
{name}_later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, i) AS k FROM {name}_windows) WHERE k > 1),
{name}_gone AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM {name}_later, range(3) t(k) GROUP BY doc_id),
{name} AS (
  SELECT a.doc_id, a.text IS NULL AS void, len(l) AS n_lines, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN a.text
      ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text
  FROM {name}_lines a LEFT JOIN {name}_gone b ON a.doc_id = b.doc_id)
"""
LINE_SQL = "WITH " + LINE_STEPS.format(name="cut", source="documents") + """
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY_SQL, "op4_url_filter": URL_SQL, "op9_line_dedup": LINE_SQL, "op11_conversation_repair": REPAIR_SQL}
