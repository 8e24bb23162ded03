"""The same questions as ``queries`` in SQL another engine can answer."""

from __future__ import annotations

from sqlcorpus.schemas import CSV_NA_TOKENS

PAIRS = """
turns AS (
  SELECT conv_id, turn, role, text,
         lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
pairs AS (
  SELECT t.conv_id, t.turn, t.text AS q,
         CASE WHEN t.next_role = 'assistant' THEN t.next_text END AS a,
         coalesce(s.text, 'NULL') AS c
  FROM turns t
  LEFT JOIN conversations s ON s.conv_id = t.conv_id AND s.role = 'system'
  WHERE t.role = 'user'
)"""

GEN = PAIRS + """,
gen AS (
  SELECT CAST(row_number() OVER (ORDER BY source, k1, k2) - 1 AS BIGINT) AS idx,
         key, question, context, answer, extra, source
  FROM (
    SELECT conv_id AS k1, turn AS k2, 'conversations:' || conv_id || '-' || turn AS key,
           q AS question, c AS context, a AS answer, 'NULL' AS extra, 'conversations' AS source
    FROM pairs
    UNION ALL
    SELECT doc_id, 0, 'documents:' || doc_id, 'NULL', text, lang, 'NULL', 'documents' FROM documents
  )
)"""

INS = """
ins AS (
  SELECT CAST(row_number() OVER (ORDER BY source, k1, k2) - 1 AS BIGINT) AS idx, text, input, output, source
  FROM (
    SELECT conv_id AS k1, turn AS k2, CAST(NULL AS VARCHAR) AS text, q AS input, a AS output,
           'conv' || (conv_id % 4) AS source
    FROM pairs
    UNION ALL
    SELECT doc_id, 0, text, NULL, NULL, source FROM documents
  )
)"""

_C, _A = "replace(context, '\"', '''')", "replace(answer, '\"', '''')"
# The prompt texts are the format.
GEN_TEXTS = {
    "text_generation": "question || ' ' || context || ' ' || answer",
    "text_completition":
        f"'### Instruction: ' || question || ' ### Input: ' || {_C} || ' ### Response: ' || {_A}",
    "chatbot": f"'### Human: ' || question || ' ' || {_C} || '### Assistant: ' || {_A}",
    "chatbot_instruct":
        "'<|system|> You are a chatbot who can help making SQL queries!</s> <|user|> ' || question"
        f" || ' ' || {_C} || '</s> <|assistant|>' || {_A}",
    "text_instruct":
        f"'<s> [INST] ' || question || ' The context is: ' || {_C} || ' [/INST] ' || {_A} || '</s>'",
    "translation": f"'Translate to SQL: ' || question || ' ' || {_C} || ' SQL: ' || {_A}",
}
INS_TEXTS = (
    ("text_completition", "input || output", "source IN ('conv0', 'conv1', 'conv2')"),
    ("text_instruct", "text", "source = 'src1'"),
    ("text_instruct", "'<s> ' || input || ' ' || output || '</s>'", "source IN ('conv0', 'conv3')"),
    ("text_instruct", "'<s> ' || text || '</s>'", "source = 'src2'"),
)


def _dataset(name: str) -> str:
    branches = [f"SELECT idx, {GEN_TEXTS[name]} AS text FROM gen"]
    branches += [f"SELECT idx, {text} FROM ins WHERE {rows}" for n, text, rows in INS_TEXTS if n == name]
    return f"WITH {GEN}, {INS} " + " UNION ALL ".join(branches)


def _long(columns: str) -> str:
    branches = [f"SELECT '{n}' AS dataset, idx, source, {t} AS text FROM gen" for n, t in GEN_TEXTS.items()]
    branches += [f"SELECT '{n}', idx, source, {t} FROM ins WHERE {rows}" for n, t, rows in INS_TEXTS]
    branches.append("SELECT 'sys_prompt', NULL, NULL, text FROM benchmark")
    return f"WITH {GEN}, {INS} SELECT {columns} FROM (" + " UNION ALL ".join(branches) + ")"


def _instruct() -> str:
    """The dataset with the most branches, with row keys: class, number of the template, index."""
    branches = [f"SELECT 'generation:0:' || idx AS row_key, idx, {GEN_TEXTS['text_instruct']} AS text FROM gen"]
    own = [(text, rows) for name, text, rows in INS_TEXTS if name == "text_instruct"]
    branches += [f"SELECT 'instruct:{k}:' || idx, idx, {text} FROM ins WHERE {rows}" for k, (text, rows) in enumerate(own, 1)]
    return f"WITH {GEN}, {INS}, instruct AS (" + " UNION ALL ".join(branches) + ")"


SPLIT = f"""WITH {GEN},
ranked AS (
  SELECT key, {GEN_TEXTS['translation']} AS text,
         row_number() OVER (ORDER BY md5(key || '#7'), key) AS place,
         CAST(ceil(CAST(0.3 AS DOUBLE) * count(*) OVER ()) AS BIGINT) AS n_test
  FROM gen
)"""

_NA = ", ".join(f"'{t}'" for t in ("", *CSV_NA_TOKENS))

LOSSES = """
losses AS (
  SELECT event_type || '-' || user_id AS run, event_type, user_id, ts, event_id, value AS loss FROM events
)"""

PLACED = LOSSES + """,
placed AS (
  SELECT *, CAST(250 * row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS BIGINT) AS x FROM losses
)"""

# The borders of the bands.
BANDS = LOSSES + """,
least AS (SELECT run, min(loss) AS "min" FROM losses GROUP BY run),
members AS (
  SELECT 1 AS band, run, "min" FROM least WHERE "min" >= 3.2
  UNION ALL SELECT 2, run, "min" FROM least WHERE "min" <= 3.2 AND "min" >= 1
  UNION ALL SELECT 3, run, "min" FROM least WHERE "min" <= 1 AND "min" >= 0.0004
  UNION ALL SELECT 4, run, "min" FROM least WHERE "min" < 0.0004
)"""

_MONEY = "CAST(l_quantity AS DECIMAL(8,2)) * CAST(p_retailprice AS DECIMAL(9,2))"

GENERATION_FILES = """
SELECT CAST(conv_id AS VARCHAR) AS question, CAST(turn AS VARCHAR) AS context, role AS answer,
       'NULL' AS extra, text, 'conversations.json' AS source FROM conversations
UNION ALL SELECT 'NULL', text, lang, 'NULL', NULL, 'documents.jsonl' FROM documents
UNION ALL SELECT CAST(page_id AS VARCHAR), url, html, 'NULL', NULL, 'pages.csv' FROM pages"""


_RAW_COLUMNS = ("kind", "folder", "file", "question", "context", "answer", "extra", "more", "text", "class", "k1", "k2")
_NO = "CAST(NULL AS VARCHAR)"


def _raw_file(file: str, table: str, key: str, **columns: str) -> str:
    kind = "generation" if "question" in columns else "instruct"
    missing = {"extra": "'NULL'"} if kind == "generation" else {}
    own = {"kind": f"'{kind}'", "folder": "'set [1]'", "file": f"'{file}'", "k1": key, "k2": "0", **missing, **columns}
    return "SELECT " + ", ".join(f"{own.get(c, _NO)} AS {c}" for c in _RAW_COLUMNS) + f" FROM {table}"


def _number(name: str) -> str:
    return f"CAST({name} AS VARCHAR)"


RAW = "raw AS (" + " UNION ALL ".join((
    _raw_file("a b.jsonl", "pages", "page_id", question=_number("page_id"), context="url", answer="html"),
    _raw_file("a%20b.jsonl", "documents", "doc_id", question="'NULL'", context="text", answer="lang"),
    _raw_file("a1.jsonl", "orders", "o_orderkey", question=_number("o_orderkey"), context="o_orderstatus", answer="o_orderpriority"),
    _raw_file("a[1].jsonl", "customer", "c_custkey", question=_number("c_custkey"), context="c_name", answer=_number("c_nationkey"),
              extra="c_mktsegment"),
    _raw_file("a{b}.jsonl", "conversations", "conv_id", question=_number("conv_id"), context=_number("turn"), answer="role", more="text",
              k2="turn"),
    _raw_file("kinds.jsonl", "benchmark", "item_id", text="text", **{"class": _number("item_id")}),
    _raw_file("x+y.jsonl", "part", "p_partkey", question=_number("p_partkey"), context="p_brand", answer="p_name"),
)) + ")"
_SHOWN = ", ".join(_RAW_COLUMNS[:-2])


def _clean(text: str) -> str:
    spaced = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'), ' ')"
    return f"regexp_replace({spaced}, '[ ;]+$', '')"


def _hit(fold: str) -> str:
    answer, right, other = (f"{fold}({_clean(c)})" if fold else _clean(c) for c in ("sql", "expected", "accepted"))
    return f"coalesce({answer} = {right} OR coalesce({answer} = {other}, false), false)"


def _per_type(value: str, condition: str = "") -> str:
    return ", ".join(
        f"{value.format(t=t)} AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")
    ) + condition


_CSV_SOURCE = f"""WITH {PAIRS}
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
           CASE WHEN q NOT IN ({_NA}) THEN q END AS q, CASE WHEN c NOT IN ({_NA}) THEN c END AS c,
           CASE WHEN a NOT IN ({_NA}) THEN a END AS a
    FROM pairs"""


_SUMMARY = f"""WITH {LOSSES},
        finished AS (
          SELECT event_type || ' - (user_' || user_id || ')' AS name,
                 arg_max(loss, (ts, event_id)) AS last_loss, min(loss) AS rate, count(*) AS steps,
                 CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS seconds
          FROM losses
          WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
          GROUP BY event_type, user_id
        )
        SELECT name, last_loss AS "eval/loss", rate AS "train/learning_rate", steps * 250 AS _step,
               CAST(floor(seconds / 3600) AS BIGINT) || 'h '
               || CAST(floor((seconds % 3600) / 60) AS BIGINT) || 'm '
               || CAST(floor(seconds % 60) AS BIGINT) || 's' AS runtime_hms
        FROM finished WHERE last_loss IS NOT NULL"""

ORACLE: dict[str, str] = {
    "scan_parquet": "SELECT * FROM documents",
    "scan_table": "SELECT * FROM supplier",
    "table_sink": f"""WITH {RAW},
        stored AS (
          SELECT replace(file, '.jsonl', '') AS "table", * FROM raw
          UNION ALL SELECT CASE kind WHEN 'generation' THEN 'raw_text_generation' ELSE 'raw_instructs' END, * FROM raw
          UNION ALL SELECT 'all_datasets', * FROM raw
        )
        SELECT "table", CAST(row_number() OVER (PARTITION BY "table" ORDER BY file, k1, k2) - 1 AS BIGINT) AS idx, file, question, text
        FROM stored""",
    "ctas_sink": f"SELECT *, 'TABLE_OR_VIEW_ALREADY_EXISTS' AS refused FROM ({_dataset('chatbot')})",
    "list_datasets": " UNION ALL ".join(
        f"SELECT 'dataset_{name}' AS name, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ({sql})"
        for name, sql in (("chatbot", _dataset("chatbot")), ("sys_prompt", "SELECT text FROM benchmark"), ("translation", _dataset("translation")))),
    "source_catalog": """
        SELECT lang || '/' || source AS name, file,
               'https://example.org/datasets/' || lang || '/' || source || '/resolve/main/' || file
                 || '?download=true' AS url,
               source || '-' || short AS local_name
        FROM (
          SELECT lang, source, 'data/doc-' || doc_id || '.parquet' AS file, 'doc-' || doc_id || '.parquet' AS short
          FROM documents
          UNION ALL
          SELECT lang, source, 'doc-' || doc_id || '.csv', 'doc-' || doc_id || '.csv' FROM documents
        )""",
    "load_dataset_by_name": _dataset("translation"),
    "run_labels": "SELECT event_id, event_type || ' - (user_' || user_id || ')' AS name FROM events",
    "json_map_explode": f"""WITH {PAIRS}
        SELECT conv_id || '-' || turn AS test_id, q AS input, c AS context, a AS expected,
               CASE WHEN a IS NOT NULL THEN CAST(conv_id AS VARCHAR) END AS accepted
        FROM pairs""",
    "json_predictions_explode":
        "SELECT role AS model, conv_id || '-' || turn AS test_id, text AS sql FROM conversations",
    "json_models_explode": """
        SELECT 'owner-' || s_nationkey || '/' || s_name AS name, s_acctbal > 0 AS "isCausal",
               false AS "isLocal", s_name AS model FROM supplier""",
    "csv_source": _CSV_SOURCE,
    "csv_source_large": _CSV_SOURCE,
    "jsonl_source": "SELECT url, CAST(page_id AS VARCHAR) AS page_id, html FROM pages",
    "json_source":
        "SELECT CAST(turn AS VARCHAR) AS turn, CAST(conv_id AS VARCHAR) AS conv_id, text, role FROM conversations",
    "normalize_source": f"WITH {RAW} SELECT {_SHOWN} FROM raw",
    "union_all_indexed": f"""WITH {RAW}
        SELECT CAST(row_number() OVER (ORDER BY file, k1, k2) - 1 AS BIGINT) AS idx, {_SHOWN} FROM raw""",
    "export_datasets": _long("dataset, idx, text"),
    "normalize_combined_text": f"""WITH {PAIRS},
        tagged AS (
          SELECT '###question:' || q || '###answer:' || a || '###context:' || c AS extra FROM pairs
        ),
        parts AS (
          SELECT extra, regexp_extract(extra, '###question:(.*?)###answer:(.*?)###context:(.*?)\\n?$',
                 ['question', 'answer', 'context'], 's') AS p FROM tagged
        )
        SELECT p.question AS question, p.context AS context, p.answer AS answer, extra FROM parts""",
    "normalize_three_col":
        "SELECT CAST(page_id AS VARCHAR) AS question, url AS context, html AS answer, 'NULL' AS extra FROM pages",
    "normalize_tail_extra": """
        SELECT CAST(doc_id AS VARCHAR) AS question, text AS context, lang AS answer,
               CASE WHEN lang <> 'en' THEN source || ' ' || n_chars ELSE CAST(n_chars AS VARCHAR) END AS extra
        FROM documents""",
    "normalize_json_keep": """
        SELECT CAST(conv_id AS VARCHAR) AS question, CAST(turn AS VARCHAR) AS context, role AS answer,
               'NULL' AS extra, text FROM conversations""",
    "normalize_questions": f"""WITH {PAIRS}
        SELECT q AS question, 'NULL' AS context, a AS answer, 'NULL' AS extra FROM pairs""",
    "normalize_sourced":
        "SELECT 'NULL' AS question, text AS context, lang AS answer, 'NULL' AS extra FROM documents",
    "normalize_jsonl_generic": """
        SELECT CAST(o_orderkey AS VARCHAR) AS question, o_orderstatus AS context, o_orderpriority AS answer,
               o_custkey || ' ' || o_orderstatus AS extra FROM orders""",
    "normalize_parquet_swap": """
        SELECT CAST(doc_id AS VARCHAR) AS question, lang AS context, text AS answer,
               source || ' ' || n_chars AS extra FROM documents""",
    "route_instruct": "SELECT item_id, text, 'instruct' AS class FROM benchmark",
    "project_summary": "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders",
    "quote_replace": "SELECT page_id, replace(html, '\"', '''') AS html FROM pages",
    "null_propagation": f"WITH {PAIRS} SELECT conv_id, turn, q || ' ' || c || ' ' || a AS text FROM pairs",
    "tag_source": "SELECT o_orderkey, o_custkey, 'orders.parquet' AS source FROM orders",
    "dense_index": f"WITH {GEN} SELECT idx, question, context, answer, extra, source FROM gen",
    "seconds_to_hms": """
        SELECT l_orderkey, l_linenumber,
               CAST(floor(l_extendedprice / 3600) AS BIGINT) || 'h '
               || CAST(floor((l_extendedprice % 3600) / 60) AS BIGINT) || 'm '
               || CAST(floor(l_extendedprice % 60) AS BIGINT) || 's' AS runtime_hms
        FROM lineitem""",
    "step_scale": "SELECT event_id, event_id * 250 AS x FROM events",
    "source_table_names": """
        SELECT page_id, replace(file, '.' || string_split(file, '.')[-1], '') AS table_name
        FROM (SELECT page_id, string_split(url, '/')[-1] AS file FROM pages)""",
    "filter_source_eq": "SELECT * FROM documents WHERE source = 'src1'",
    "filter_source_in": "SELECT * FROM documents WHERE source IN ('src2', 'src3', 'src5')",
    "allowlist_semi": f"""WITH {LOSSES}
        SELECT run, event_id, loss FROM losses
        WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "drop_null_loss": f"WITH {PAIRS} SELECT conv_id, turn, a FROM pairs WHERE a IS NOT NULL",
    "filter_class": """
        SELECT 'NULL' AS question, text AS context, lang AS answer, 'NULL' AS extra,
               'generation' AS class, CAST(NULL AS VARCHAR) AS text FROM documents""",
    "union_generation": GENERATION_FILES,
    "union_instructs": f"""WITH {PAIRS}
        SELECT text, CAST(NULL AS VARCHAR) AS input, CAST(NULL AS VARCHAR) AS output, 'benchmark.csv' AS source
        FROM benchmark
        UNION ALL SELECT NULL, q, a, 'pairs.jsonl' FROM pairs""",
    "union_all": f"""WITH {PAIRS}, files AS ({GENERATION_FILES})
        SELECT question, context, answer, extra, text, source,
               CAST(NULL AS VARCHAR) AS input, CAST(NULL AS VARCHAR) AS output FROM files
        UNION ALL SELECT NULL, NULL, NULL, NULL, text, 'benchmark.csv', NULL, NULL FROM benchmark
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'pairs.jsonl', q, a FROM pairs""",
    **{f"dataset_{name}": _dataset(name) for name in GEN_TEXTS},
    "dataset_sys_prompt": "SELECT text FROM benchmark",
    "datasets_long": _long("dataset, idx, source, text"),
    "train_test_split": SPLIT + """
        SELECT key, text, CASE WHEN place <= n_test THEN 'test' ELSE 'train' END AS side FROM ranked""",
    "split_counts": SPLIT + """
        SELECT CASE WHEN place <= n_test THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows
        FROM ranked GROUP BY 1""",
    "eval_cap": SPLIT + " SELECT key, text FROM ranked WHERE place <= least(1000, n_test)",
    "split_stored_dataset": _instruct() + """,
        ranked AS (
          SELECT *, row_number() OVER (ORDER BY md5(row_key || '#7'), row_key) AS place,
                 CAST(ceil(CAST(0.3 AS DOUBLE) * count(*) OVER ()) AS BIGINT) AS n_test FROM instruct
        )
        SELECT row_key, idx, text, CASE WHEN place <= n_test THEN 'test' ELSE 'train' END AS side FROM ranked""",
    "unpivot_curves": """
        SELECT l_orderkey, l_linenumber AS step, 'bright-sky-1 - (' || l_returnflag || ')' AS run,
               l_quantity AS loss FROM lineitem WHERE l_quantity IS NOT NULL
        UNION ALL
        SELECT l_orderkey, l_linenumber, 'calm-sea-2 - (' || l_returnflag || ')', l_discount
        FROM lineitem WHERE l_discount <> 0""",
    "curve_axis": f"WITH {PLACED} SELECT run, event_id, x, loss FROM placed",
    "pivot_curves": f"""WITH {PLACED}
        SELECT user_id, x, {_per_type("max(CASE WHEN event_type = '{t}' THEN loss END)")}
        FROM placed GROUP BY user_id, x""",
    "describe_runs": f"""WITH {LOSSES}
        SELECT run, count(loss) AS n, min(loss) AS "min", max(loss) AS "max",
               round(avg(loss), 6) AS mean, round(stddev_samp(loss), 6) AS std,
               round(quantile_cont(loss, 0.25), 6) AS q25, round(quantile_cont(loss, 0.5), 6) AS q50,
               round(quantile_cont(loss, 0.75), 6) AS q75
        FROM losses GROUP BY run""",
    "loss_bands": f'WITH {BANDS} SELECT band, run, "min" FROM members',
    "band_curves": f"""WITH {BANDS}
        SELECT m.band, l.run, l.event_id, l.loss FROM losses l JOIN members m ON m.run = l.run""",
    "run_summary": _SUMMARY,
    "summary_sink": _SUMMARY,
    "run_records": f"""WITH {LOSSES}
        SELECT event_type || ' - (user_' || user_id || ')' AS name, event_type AS run, 'user_' || user_id AS project,
               arg_max(loss, (ts, event_id)) AS "eval/loss", min(loss) AS "train/learning_rate", count(*) AS _step,
               CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS _runtime
        FROM losses GROUP BY event_type, user_id""",
    "curve_source": " UNION ALL ".join(
        f"SELECT '{kind}-{k + 1} - (sheet {kind})' AS run, event_id AS step, value AS loss FROM events "
        f"WHERE event_type = '{kind}' AND event_id % {k + 1} = 0 AND value IS NOT NULL"
        for number, kind in enumerate(("click", "error", "purchase", "signup", "view")) for k in range(number + 1)),
    "discover_sources": "SELECT * FROM (VALUES " + ", ".join(
        f"('set [1]', '{file}', '{file.rpartition('.')[2]}')"
        for file in ("a b.csv", "a%20b.jsonl", "a1.csv", "a[1].csv", "a{b}.json", "kinds.jsonl", "x+y.parquet")) + ") t(folder, file, ext)",
    "routed_sink": f"""
        SELECT 'NULL' AS question, text AS context, lang AS answer, 'NULL' AS extra, {_NO} AS text,
               'generation' AS class, 'texts' AS folder, 'documents.jsonl' AS source FROM documents
        UNION ALL SELECT CAST(page_id AS VARCHAR), url, html, 'again ' || page_id, NULL, 'generation', 'web', 'pages.jsonl' FROM pages
        UNION ALL SELECT NULL, NULL, NULL, NULL, text, 'instruct', 'texts', 'benchmark.jsonl' FROM benchmark""",
    "golden_filter_lt": "SELECT * FROM customer WHERE c_acctbal < 0",
    "golden_project_filter": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice < 50000",
    "golden_date_eq": "SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-01-15'",
    "golden_distinct": "SELECT DISTINCT p_brand FROM part",
    "golden_like": "SELECT c_name FROM customer WHERE c_name LIKE '%7'",
    "golden_string_eq": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "golden_join_filter":
        "SELECT c.* FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1",
    "golden_left_join": """
        SELECT c_custkey, c_name, c_acctbal, o_orderkey, o_totalprice
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
    "golden_left_join_count": """
        SELECT n_name, count(l_suppkey) AS n_lines
        FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey LEFT JOIN lineitem ON s_suppkey = l_suppkey
        GROUP BY n_name""",
    "golden_in_subquery":
        "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "golden_group_count":
        "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "golden_revenue": f"""
        SELECT CAST(sum({_MONEY}) AS DOUBLE) AS total_revenue FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "golden_top_spender": f"""
        SELECT name, CAST(spent AS DOUBLE) AS total_spent FROM (
          SELECT c_name AS name, sum({_MONEY}) AS spent
          FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
          JOIN part ON p_partkey = l_partkey
          GROUP BY c_name ORDER BY spent DESC, name LIMIT 1
        )""",
    "score_leaderboard": f"""
        WITH board AS (
          SELECT 'user-' || user_id AS model,
                 {_per_type("nullif(count(*) FILTER (WHERE event_type = '{t}'), 0)")},
                 count(*) AS total
          FROM events GROUP BY user_id
        )
        SELECT *, CAST(rank() OVER (ORDER BY total DESC) AS INTEGER) AS place FROM board""",
    "prediction_match": f"""WITH {PAIRS},
        tests AS (SELECT conv_id || '-' || turn AS test_id, turn, a AS expected, q AS accepted FROM pairs),
        answers AS (
          SELECT 'spaced' AS model, test_id, '  ' || replace(expected, ' ', '  ') || ' ;' AS sql FROM tests
          UNION ALL SELECT 'lowered', test_id, lower(expected) FROM tests
          UNION ALL SELECT 'other', test_id, accepted FROM tests WHERE turn % 4 = 0
          UNION ALL SELECT 'wrong', test_id, 'not ' || accepted FROM tests
        ),
        judged AS (
          SELECT model, CAST({_hit('')} AS BIGINT) AS strict_hit, CAST({_hit('lower')} AS BIGINT) AS folded_hit
          FROM answers JOIN tests USING (test_id)
        )
        SELECT model, count(*) AS answers, CAST(sum(strict_hit) AS BIGINT) AS strict,
               CAST(sum(folded_hit) AS BIGINT) AS folded, sum(strict_hit) / (SELECT count(*) FROM tests) AS strict_rate,
               sum(folded_hit) / (SELECT count(*) FROM tests) AS folded_rate
        FROM judged GROUP BY model""",
    "resultset_diff": """
        SELECT c_custkey, c_name, CAST(0 AS BIGINT) AS missing, count(*) - 1 AS surplus
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING count(*) > 1""",
    "score_vs_loss": """
        SELECT model, total, loss FROM
          (SELECT 'user-' || o_custkey AS model, count(*) AS total FROM orders GROUP BY o_custkey)
          LEFT JOIN (SELECT 'user-' || user_id AS model, min(value) AS loss FROM events GROUP BY user_id)
          USING (model)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
