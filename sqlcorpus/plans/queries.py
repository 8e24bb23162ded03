"""Every operator of the library as a query over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus.functions import (
    duration_text, prompt, requote, run_label, scale_step, table_name,
)
from sqlcorpus.operators import curves, evaluate, runs, split
from sqlcorpus.operators.consolidate import from_source, index_in_file_order, of_class, tag_source, unite
from sqlcorpus.operators.normalize import normalize, with_kind
from sqlcorpus.plans import corpus, golden, training
from sqlcorpus.plans.raw_folder import file_of, fresh_folder, shown, write_raw
from sqlcorpus.plans.templates import DATASETS, PART, TEMPLATES, dataset, datasets_long
from sqlcorpus.plans.views import Given, moment, pair_key
from sqlcorpus.schemas import (
    ALL_TABLE, CSV_NA_TOKENS, DATASET_PREFIX, GENERATION, GENERATION_TABLE, INSTRUCT_TABLE, LOSS_SUFFIX,
)
from sqlcorpus.sinks.files import (
    Buckets, bucket_count, export_datasets, name_files, write_csv, write_json_arrays, write_jsonl, write_routed,
)
from sqlcorpus.sinks.tables import create_table, open_store
from sqlcorpus.sources import catalog
from sqlcorpus.sources.files import read_csv, read_json, read_jsonl
from sqlcorpus.sources.discover import discover_sources
from sqlcorpus.sources.large_csv import read_large_csv
from sqlcorpus.sources.runs import curve_source as read_curves, read_run_records
from sqlcorpus.sources.tables import key_by_key, list_datasets as stored_datasets, load_dataset_by_name, scan_table, table_in

Query = Callable[[Given], DataFrame]
QUERIES: dict[str, Query] = {}

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SPLIT_SEED = 7
GOLDEN_DAY = dt.date(1997, 1, 15)


def query(run: Query) -> Query:
    # a closing underscore keeps a function apart from the library's own
    QUERIES[run.__name__.rstrip("_")] = run
    return run


# --- sources ---------------------------------------------------------------

@query
def scan_parquet(g: Given) -> DataFrame:
    return g.table("documents")


def store(g: Given) -> str:
    """A database of this query's own, whose tables lie in the staging folder."""
    folder = fresh_folder(g)
    return open_store(g.spark, "q_" + folder.rpartition("/")[2], folder)


@query
def scan_table_(g: Given) -> DataFrame:
    name = table_in(store(g), "stored_supplier")
    create_table(g.table("supplier"), name)
    return scan_table(g.spark, name)


@query
def table_sink(g: Given) -> DataFrame:
    """The three union tables and a table per file, stored twice over; one row per stored row."""
    database = store(g)
    staged = corpus.stage_sources(g.spark, write_raw(g), fresh_folder(g))
    tables = corpus.corpus_tables(staged)
    for _ in range(2):  # the second time replaces
        corpus.store_tables(staged, tables, database)
    names = corpus.store_source_tables(staged, database)
    names |= {name: name for name in (GENERATION_TABLE, INSTRUCT_TABLE, ALL_TABLE)}
    stored = [(name, g.spark.table(table_in(database, table))) for name, table in names.items()]
    return unite([
        df.select(F.regexp_replace(F.lit(name), r"-\d{5}$", "").alias("table"), F.col("index").alias("idx"),
                  file_of(F.col("source")).alias("file"), "question", "text") for name, df in stored])


@query
def ctas_sink(g: Given) -> DataFrame:
    """A dataset created as a table; creating it again is an error, unless overwriting is asked for."""
    database = store(g)
    corpus.create_datasets(g, ["chatbot"], database=database)
    try:
        corpus.create_datasets(g, ["chatbot"], database=database)
    except AnalysisException as error:
        refused = error.getCondition()
    corpus.create_datasets(g, ["chatbot"], overwrite=True, database=database)
    return g.spark.table(table_in(database, DATASET_PREFIX + "chatbot")).withColumn("refused", F.lit(refused))


@query
def list_datasets(g: Given) -> DataFrame:
    """The stored datasets by name, with the number of rows and characters of each."""
    database = store(g)
    corpus.create_datasets(g, ["translation", "sys_prompt", "chatbot"], database=database)
    create_table(g.table("nation"), table_in(database, "no_dataset"))
    return unite([
        g.spark.table(table_in(database, name)).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars")).select(
            F.lit(name).alias("name"), "n_rows", "n_chars")
        for name in stored_datasets(g.spark, database=database)])


@query
def source_catalog(g: Given) -> DataFrame:
    kept = F.concat(F.lit("doc-"), "doc_id")
    manifest = F.to_json(F.struct(
        F.lit("https://example.org/datasets").alias("base_url"),
        F.array(F.struct(
            F.concat("lang", F.lit("/"), "source").alias("name"),
            F.array(F.concat(F.lit("data/"), kept, F.lit(".parquet")), F.concat(kept, F.lit(".csv"))).alias("files"),
        )).alias("datasets"),
    ))
    return catalog.source_catalog(g.table("documents").select(catalog.parse_provider(manifest).alias("provider")))


@query
def load_dataset_by_name_(g: Given) -> DataFrame:
    database = store(g)
    corpus.create_datasets(g, ["translation"], database=database)
    return load_dataset_by_name(g.spark, "Translation dataset", database)


@query
def run_labels(g: Given) -> DataFrame:
    return g.table("events").select(
        "event_id",
        run_label(F.concat("event_type", F.lit(LOSS_SUFFIX)), F.concat(F.lit("user_"), "user_id")).alias("name"),
    )


@query
def json_map_explode(g: Given) -> DataFrame:
    test = F.struct(
        F.col("q").alias("input"), F.col("c").alias("context"), F.col("a").alias("expected"),
        F.when(F.col("a").isNotNull(), F.upper("conv_id")).alias("accepted"),
    )
    return catalog.golden_tests(g.pairs().select(F.to_json(F.create_map(pair_key(), test)).alias("value")))


@query
def json_predictions_explode(g: Given) -> DataFrame:
    answers = F.create_map("role", F.create_map(pair_key(), F.col("text")))
    return catalog.predictions(g.table("conversations").select(F.to_json(answers).alias("value")))


@query
def json_models_explode(g: Given) -> DataFrame:
    model = F.struct(
        F.concat(F.lit("owner-"), "s_nationkey", F.lit("/"), "s_name").alias("name"),
        (F.col("s_acctbal") > 0).alias("isCausal"), F.lit(False).alias("isLocal"),
    )
    found = catalog.models(g.table("supplier").select(F.to_json(F.array(model)).alias("value")))
    return evaluate.registry_names(found)


# --- file round trips: the sink and the source of a format, over whole tables ----

@query
def csv_source(g: Given) -> DataFrame:
    path = fresh_folder(g)
    write_csv(g.pairs().select("conv_id", "turn", "q", "c", "a"), path)
    return read_csv(g.spark, path)


@query
def csv_source_large(g: Given) -> DataFrame:
    """As ``csv_source``, by the reader that splits files between tasks."""
    path = fresh_folder(g)
    rows = g.pairs().select("conv_id", "turn", "q", "c", "a")
    write_csv(rows, path)
    return read_large_csv(g.spark, [path], tuple(rows.columns), CSV_NA_TOKENS)


@query
def jsonl_source(g: Given) -> DataFrame:
    path = fresh_folder(g)
    write_jsonl(g.table("pages").select("url", "page_id", "html"), path)
    return read_jsonl(g.spark, path)


@query
def json_source(g: Given) -> DataFrame:
    path = fresh_folder(g)
    write_json_arrays(g.table("conversations").select("turn", "conv_id", "text", "role"), path)
    return read_json(g.spark, path)


@query
def normalize_source(g: Given) -> DataFrame:
    """Files of every format, one scan per shape; names with pattern characters, and a column that the store calls its own."""
    return shown(corpus.normalize_sources(g.spark, write_raw(g)), "class_")


@query
def union_all_indexed(g: Given) -> DataFrame:
    """All files after staging, indexed in file order."""
    staged = corpus.stage_sources(g.spark, write_raw(g), fresh_folder(g))
    indexed = index_in_file_order(staged)
    return shown(indexed, "class_", "index").withColumnRenamed("index", "idx")


@query
def export_datasets_(g: Given) -> DataFrame:
    """All datasets as files, read again with the prompts of a row next to each other: whoever packs them finds the text that they share."""
    buckets = Buckets(table_in(store(g), "exported"), PART, bucket_count(g.text_bytes() * len(DATASETS)))
    export_datasets(datasets_long(g, parted=True).drop("source"), fresh_folder(g), compression="gzip", buckets=buckets)
    return key_by_key(scan_table(g.spark, buckets.table), [PART, "idx"], "dataset").select("dataset", "idx", "text")


# --- normalisers ----------------------------------------------------------------

@query
def normalize_combined_text(g: Given) -> DataFrame:
    text = prompt("###question:", F.col("q"), "###answer:", F.col("a"), "###context:", F.col("c"))
    return normalize(g.pairs().select(text.alias("combined_text")), "csv").rows


@query
def normalize_three_col(g: Given) -> DataFrame:
    return normalize(g.table("pages").select("page_id", "url", "html"), "csv").rows


@query
def normalize_tail_extra(g: Given) -> DataFrame:
    source = F.when(F.col("lang") != "en", F.col("source")).alias("source")
    return normalize(g.table("documents").select("doc_id", "text", "lang", source, "n_chars"), "csv").rows


@query
def normalize_json_keep(g: Given) -> DataFrame:
    return normalize(g.table("conversations").select("conv_id", "turn", "role", "text"), "json").rows


@query
def normalize_questions(g: Given) -> DataFrame:
    return normalize(g.pairs().select(F.col("q").alias("Questions"), F.col("a").alias("SQL")), "jsonl").rows


@query
def normalize_sourced(g: Given) -> DataFrame:
    return normalize(g.table("documents").select("text", "lang", "source"), "jsonl").rows


@query
def normalize_jsonl_generic(g: Given) -> DataFrame:
    orders = g.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderstatus")
    return normalize(orders.toDF("z", "b", "a", "k", "j"), "jsonl").rows


@query
def normalize_parquet_swap(g: Given) -> DataFrame:
    return normalize(g.table("documents").select("doc_id", "text", "lang", "source", "n_chars"), "parquet").rows


@query
def route_instruct(g: Given) -> DataFrame:
    return with_kind(normalize(g.table("benchmark").select("item_id", "text"), "parquet"))


# --- projections ------------------------------------------------------------------

@query
def project_summary(g: Given) -> DataFrame:
    return g.table("orders").select("o_orderpriority", "o_totalprice", "o_orderkey")


@query
def quote_replace(g: Given) -> DataFrame:
    return g.table("pages").select("page_id", requote(F.col("html")).alias("html"))


@query
def null_propagation(g: Given) -> DataFrame:
    return g.pairs().select(
        "conv_id", "turn", prompt(F.col("q"), " ", F.col("c"), " ", F.col("a")).alias("text")
    )


@query
def tag_source_(g: Given) -> DataFrame:
    return tag_source(g.table("orders")).select("o_orderkey", "o_custkey", "source")


@query
def dense_index(g: Given) -> DataFrame:
    return g.gen()


@query
def seconds_to_hms(g: Given) -> DataFrame:
    return g.table("lineitem").select(
        "l_orderkey", "l_linenumber", duration_text(F.col("l_extendedprice")).alias("runtime_hms")
    )


@query
def step_scale(g: Given) -> DataFrame:
    return g.table("events").select("event_id", scale_step(F.col("event_id")).alias("x"))


@query
def source_table_names(g: Given) -> DataFrame:
    return g.table("pages").select("page_id", table_name(F.substring_index("url", "/", -1)).alias("table_name"))


# --- filters -----------------------------------------------------------------------

@query
def filter_source_eq(g: Given) -> DataFrame:
    return from_source(g.table("documents"), "src1")


@query
def filter_source_in(g: Given) -> DataFrame:
    return from_source(g.table("documents"), "src2", "src3", "src5")


def _building(g: Given) -> DataFrame:
    return g.table("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))


@query
def allowlist_semi(g: Given) -> DataFrame:
    return runs.allowed_only(g.losses(), _building(g), "user_id").select("run", "event_id", "loss")


@query
def drop_null_loss(g: Given) -> DataFrame:
    return runs.drop_null_loss(g.pairs(), "a").select("conv_id", "turn", "a")


def _routed(g: Given) -> list[DataFrame]:
    """Rows of both classes with folder and source."""
    shaped = [
        ("texts", "documents.jsonl", normalize(g.table("documents").select("text", "lang", "source"), "jsonl")),
        ("web", "pages.jsonl", normalize(g.table("pages").select("page_id", "url", "html"), "csv")),
        ("texts", "benchmark.jsonl", normalize(g.table("benchmark").select("text"), "csv")),
    ]
    return [with_kind(n).withColumns({"folder": F.lit(folder), "source": F.lit(source)}) for folder, source, n in shaped]


@query
def filter_class(g: Given) -> DataFrame:
    """From the routed store, where a class is a folder."""
    path = fresh_folder(g)
    write_routed(unite(_routed(g)), path)
    kept = of_class(corpus.read_staged(g.spark, path), GENERATION)
    return kept.filter("folder = 'texts'").select("question", "context", "answer", "extra", "class", "text")


@query
def routed_sink(g: Given) -> DataFrame:
    """Both classes by routes, as lines; then one source anew, which leaves the others as they are."""
    path, rows = fresh_folder(g), _routed(g)
    write_routed(unite(rows), path, save="jsonl")
    write_routed(rows[1].withColumn("extra", F.concat(F.lit("again "), "question")), path, "routes", "jsonl")
    schema = "question string, context string, answer string, extra string, text string, class string, folder string, source string"
    return g.spark.read.schema(schema).json(path)


# --- unions -------------------------------------------------------------------------

def _generation_files(g: Given) -> list[DataFrame]:
    shaped = {
        "conversations.json": normalize(g.table("conversations").select("conv_id", "turn", "role", "text"), "json"),
        "documents.jsonl": normalize(g.table("documents").select("text", "lang", "source"), "jsonl"),
        "pages.csv": normalize(g.table("pages").select("page_id", "url", "html"), "csv"),
    }
    return [n.rows.withColumn("source", F.lit(file)) for file, n in shaped.items()]


def _instruct_files(g: Given) -> list[DataFrame]:
    shaped = {
        "benchmark.csv": normalize(g.table("benchmark").select("text"), "csv"),
        "pairs.jsonl": normalize(g.pairs().select(F.col("q").alias("input"), F.col("a").alias("output")), "jsonl"),
    }
    return [n.rows.withColumn("source", F.lit(file)) for file, n in shaped.items()]


@query
def union_generation(g: Given) -> DataFrame:
    return unite(_generation_files(g))


@query
def union_instructs(g: Given) -> DataFrame:
    return unite(_instruct_files(g))


@query
def union_all(g: Given) -> DataFrame:
    return unite(_generation_files(g) + _instruct_files(g))


# --- datasets -------------------------------------------------------------------------

for _name in DATASETS:
    QUERIES[f"dataset_{_name}"] = lambda g, name=_name: dataset(name, g)


@query
def datasets_long_(g: Given) -> DataFrame:
    return datasets_long(g)


# --- split ----------------------------------------------------------------------------

def _translations(g: Given) -> DataFrame:
    template = next(t for t in TEMPLATES if t.dataset == "translation")
    return g.gen_keyed().select("key", template.text().alias("text"))


@query
def train_test_split(g: Given) -> DataFrame:
    return split.train_test_split(_translations(g), "key", SPLIT_SEED, keys=g.gen_keys())


@query
def split_counts(g: Given) -> DataFrame:
    return split.split_counts(split.train_test_split(g.gen_keys(), "key", SPLIT_SEED))


@query
def eval_cap(g: Given) -> DataFrame:
    return split.eval_rows(_translations(g), "key", SPLIT_SEED, keys=g.gen_keys())


@query
def split_stored_dataset(g: Given) -> DataFrame:
    """A dataset whose index repeats between branches, stored with its row keys and split as it lies."""
    database = store(g)
    corpus.create_datasets(g, ["text_instruct"], keyed=True, database=database)
    return training.split_stored_dataset(g.spark, "Instruct dataset", SPLIT_SEED, database=database)


# --- run analytics ----------------------------------------------------------------------

@query
def unpivot_curves(g: Given) -> DataFrame:
    sheet = g.table("lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("project"),
        F.col("l_quantity").alias("bright-sky-1" + LOSS_SUFFIX),
        F.col("l_tax").alias("bright-sky-1" + LOSS_SUFFIX + "__MIN"),
        F.col("l_tax").alias("bright-sky-1" + LOSS_SUFFIX + "__MAX"),
        F.nullif("l_discount", F.lit(0.0)).alias("calm-sea-2" + LOSS_SUFFIX),
    )
    long = curves.unpivot_curves(sheet, ["l_orderkey", "step", "project"], F.col("project"))
    return long.select("l_orderkey", "step", "run", "loss")


def _placed(g: Given) -> DataFrame:
    return curves.curve_axis(g.losses(), ["ts", "event_id"], moment())


@query
def curve_axis(g: Given) -> DataFrame:
    return _placed(g).select("run", "event_id", "x", "loss")


@query
def pivot_curves(g: Given) -> DataFrame:
    """One sheet per user: a column per event type."""
    sheet = _placed(g).select("user_id", "x", F.col("event_type").alias("run"), "loss")
    return curves.pivot_curves(sheet, ["user_id", "x"], EVENT_TYPES)


@query
def describe_runs(g: Given) -> DataFrame:
    described = curves.runs_by_min(curves.describe_runs(g.losses()))
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")]
    return described.select("run", "n", "min", "max", *rounded)


@query
def loss_bands(g: Given) -> DataFrame:
    return curves.loss_bands(g.losses())


@query
def band_curves(g: Given) -> DataFrame:
    return curves.band_curves(g.losses()).select("band", "run", "event_id", "loss")


def _run_records(g: Given) -> DataFrame:
    last = F.struct("ts", "event_id")
    at = moment()
    return g.losses().groupBy("event_type", "user_id").agg(
        F.max_by("loss", last).alias("eval/loss"), F.min("loss").alias("train/learning_rate"),
        F.count(F.lit(1)).alias("_step"), ((F.max(at) - F.min(at)) / F.lit(1e6)).alias("_runtime"),
    ).select(
        "user_id", F.col("event_type").alias("run"), F.concat(F.lit("user_"), "user_id").alias("project"),
        "eval/loss", "train/learning_rate", "_step", "_runtime",
    )


@query
def run_records(g: Given) -> DataFrame:
    """Summaries as exported, one JSON object per line, with their labels."""
    path = fresh_folder(g)
    write_jsonl(_run_records(g).drop("user_id"), path)
    return runs.label_runs(read_run_records(g.spark, path))


@query
def summary_sink(g: Given) -> DataFrame:
    path = fresh_folder(g)
    summary = runs.run_summary(runs.label_runs(_run_records(g)), _building(g), "user_id")
    write_csv(summary, path)
    return g.spark.read.schema(summary.schema).csv(path, header=True, quote='"', escape='"')


@query
def curve_source(g: Given) -> DataFrame:
    """A wide sheet per event type, with headers of different widths."""
    folder = fresh_folder(g)
    for number, kind in enumerate(EVENT_TYPES):
        event = g.table("events").filter(F.col("event_type") == kind)
        sheet = event.select(
            F.col("user_id").alias("User"), F.col("event_id").alias("Step"), F.col("value").alias(f"{kind}-1{LOSS_SUFFIX}"),
            F.col("value").alias(f"{kind}-1{LOSS_SUFFIX}__MIN"),
            *(F.when(F.col("event_id") % (k + 2) == 0, F.col("value")).alias(f"{kind}-{k + 2}{LOSS_SUFFIX}") for k in range(number)))
        write_csv(sheet, f"{folder}/written/{number}")
        name_files(g.spark, f"{folder}/written/{number}", f"{folder}/sheets [1]", f"sheet {kind}.csv")
    found = discover_sources(g.spark, f"{folder}/sheets [1]").collect()  # one row per sheet
    curves_ = read_curves(g.spark, [row["path"] for row in found])
    return curves_.withColumn("run", F.regexp_replace("run", r"-\d{5}\)$", ")"))


@query
def discover_sources_(g: Given) -> DataFrame:
    found = discover_sources(g.spark, write_raw(g))
    return found.filter("length > 0").select("folder", file_of(F.col("file")).alias("file"), "ext").distinct()


@query
def run_summary(g: Given) -> DataFrame:
    return runs.run_summary(runs.label_runs(_run_records(g)), _building(g), "user_id")


# --- golden workload ----------------------------------------------------------------------

@query
def golden_filter_lt(g: Given) -> DataFrame:
    return golden.filter_less(g.table("customer"), "c_acctbal", 0)


@query
def golden_project_filter(g: Given) -> DataFrame:
    return golden.project_filter(g.table("orders"), ["o_orderkey", "o_custkey", "o_totalprice"], "o_totalprice", 50000)


@query
def golden_date_eq(g: Given) -> DataFrame:
    return golden.on_date(g.table("orders"), "o_orderdate", GOLDEN_DAY)


@query
def golden_distinct(g: Given) -> DataFrame:
    return golden.distinct_values(g.table("part"), "p_brand")


@query
def golden_like(g: Given) -> DataFrame:
    return golden.ends_with(g.table("customer"), "c_name", "7").select("c_name")


@query
def golden_string_eq(g: Given) -> DataFrame:
    return golden.equals(g.table("customer"), "c_mktsegment", "BUILDING")


@query
def golden_join_filter(g: Given) -> DataFrame:
    customer, nation = g.table("customer"), g.table("nation")
    return golden.join_filter(
        customer, nation, customer.c_nationkey == nation.n_nationkey, F.col("n_regionkey") == 1
    )


@query
def golden_left_join(g: Given) -> DataFrame:
    return golden.left_join(
        g.table("customer").select("c_custkey", "c_name", "c_acctbal"),
        g.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "c_custkey", "o_custkey",
    ).drop("o_custkey")


@query
def golden_left_join_count(g: Given) -> DataFrame:
    # lines are counted per supplier before they meet the other tables
    per_supplier = g.table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"))
    suppliers = golden.left_join(
        g.table("nation").select("n_nationkey", "n_name"), g.table("supplier").select("s_nationkey", "s_suppkey"),
        "n_nationkey", "s_nationkey",
    )
    counted = golden.left_join(suppliers, per_supplier, "s_suppkey", "l_suppkey")
    return counted.groupBy("n_name").agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))


@query
def golden_in_subquery(g: Given) -> DataFrame:
    dear = g.table("orders").filter("o_totalprice > 400000").select("o_custkey")
    return golden.in_subquery(g.table("customer"), "c_custkey", dear)


@query
def golden_group_count(g: Given) -> DataFrame:
    return golden.group_count(g.table("customer"), g.table("nation"), "c_nationkey", "n_nationkey", "n_name")


@query
def golden_revenue(g: Given) -> DataFrame:
    return golden.revenue(
        g.table("lineitem"), g.table("part"), "l_partkey", "p_partkey", "l_quantity", "p_retailprice"
    )


@query
def golden_top_spender(g: Given) -> DataFrame:
    return golden.top_spender(g.table("customer"), g.table("orders"), g.table("lineitem"), g.table("part"), {
        "user": "c_custkey", "user_name": "c_name", "order": "o_orderkey", "order_user": "o_custkey",
        "detail_order": "l_orderkey", "detail_product": "l_partkey", "product": "p_partkey",
        "quantity": "l_quantity", "price": "p_retailprice",
    })


# --- evaluation ------------------------------------------------------------------------------

@query
def score_leaderboard(g: Given) -> DataFrame:
    scores = g.table("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("score")).select(
        F.concat(F.lit("user-"), "user_id").alias("model"), F.col("event_type").alias("criterion"), "score"
    )
    return evaluate.leaderboard(scores, EVENT_TYPES)


@query
def prediction_match(g: Given) -> DataFrame:
    """Four answerers: one exact but for blanks, one in lower case, one by the other form to every second test, one off the point."""
    asked = g.pairs().select(pair_key().alias("test_id"), "turn", "q", "a")
    tests = asked.select("test_id", F.col("a").alias("expected"), F.col("q").alias("accepted"))
    answers = F.create_map(
        F.lit("spaced"), F.concat(F.lit("  "), F.replace("a", F.lit(" "), F.lit("  ")), F.lit(" ;")),
        F.lit("lowered"), F.lower("a"),
        F.lit("other"), F.col("q"),
        F.lit("wrong"), F.concat(F.lit("not "), "q"),
    )
    predicted = asked.select("test_id", "turn", F.explode(answers).alias("model", "sql")).filter("model <> 'other' OR turn % 4 = 0")
    return evaluate.prediction_match(tests, predicted)


@query
def resultset_diff(g: Given) -> DataFrame:
    """Customers with orders against the same by a plain join, which repeats them."""
    customer, orders = g.table("customer"), g.table("orders")
    wanted = golden.in_subquery(customer, "c_custkey", orders.select("o_custkey")).select("c_custkey", "c_name")
    got = customer.join(orders, customer.c_custkey == orders.o_custkey).select("o_custkey", "c_name")
    return evaluate.resultset_diff(wanted, got)


@query
def score_vs_loss(g: Given) -> DataFrame:
    scores = g.table("orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("score")).select(
        F.concat(F.lit("user-"), "o_custkey").alias("model"), F.col("o_orderstatus").alias("criterion"), "score"
    )
    summary = g.losses().groupBy("user_id").agg(F.min("loss").alias("eval/loss")).select(
        F.concat(F.lit("user-"), "user_id").alias("name"), "eval/loss"
    )
    return evaluate.score_vs_loss(evaluate.score_totals(scores, ["F", "O", "P"]), summary)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: lambda spark, sf_dir, run=run: run(Given(spark, sf_dir)) for name, run in sorted(QUERIES.items())
    }
