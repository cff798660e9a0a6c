"""Tables, ad-hoc SQL and column profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text, tools
from groundwork.operators import profiling
from groundwork.plans.domain import SPACE
from groundwork.plans.registry import query
from groundwork.sources import tables as access
from groundwork.sources.tables import Tables

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    "list_tables",
    "\nUNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in GIVEN),
)
def list_tables(t: Tables) -> DataFrame:
    return access.list_tables(t)


DOCUMENT_COLUMNS = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))


@query(
    "table_schema",
    "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS data_type, "
        f"CAST(max(length(CAST({name} AS VARCHAR))) AS BIGINT) AS data_length FROM documents"
        for i, (name, kind) in enumerate(DOCUMENT_COLUMNS, 1)
    ),
)
def table_schema(t: Tables) -> DataFrame:
    return access.table_schema(t, "DOCUMENTS", measure=True)


@query("rag_stats", "SELECT count(*) AS total_documents FROM documents")
def rag_stats(t: Tables) -> DataFrame:
    return access.row_count(t["documents"])


LARGEST = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus <> :status ORDER BY o_totalprice DESC, o_orderkey"""


@query("run_sql_capped", "SELECT * FROM (" + LARGEST.replace(":status", "'P'") + ") LIMIT 1000")
def run_sql_capped(t: Tables) -> DataFrame:
    t.register_views("orders")
    return access.run_sql(t.spark, LARGEST, args={"status": "P"})


SEGMENTS = (
    "SELECT c_mktsegment, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey "
    "GROUP BY c_mktsegment ORDER BY n_orders DESC, c_mktsegment"
)


@query(
    "result_envelope",
    f"""WITH r AS ({SEGMENTS})
SELECT '{SEGMENTS}' AS sql_query, count(*) AS row_count,
       '[' || string_agg(CAST(json_object('c_mktsegment', c_mktsegment, 'n_orders', n_orders) AS VARCHAR), ','
                         ORDER BY n_orders DESC, c_mktsegment) || ']' AS sql_result
FROM r""",
)
def result_envelope(t: Tables) -> DataFrame:
    t.register_views("customer", "orders")
    return access.result_envelope(access.run_sql(t.spark, SEGMENTS), SEGMENTS)


@query(
    "result_pages",
    """WITH p AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 200 AS page, c_custkey, c_mktsegment FROM customer)
SELECT 'customers' AS sql_query, page, count(*) AS row_count,
       '[' || string_agg(CAST(json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment) AS VARCHAR), ',' ORDER BY c_custkey) || ']' AS sql_result
FROM p GROUP BY page""",
)
def result_pages(t: Tables) -> DataFrame:
    """All customers as envelopes of 200 rows."""
    return access.result_pages(t["customer"].select("c_custkey", "c_mktsegment"), "customers", ["c_custkey"], 200)


@query("distinct_all", "SELECT DISTINCT p_name AS value FROM part WHERE p_name IS NOT NULL")
def distinct_all(t: Tables) -> DataFrame:
    return profiling.distinct_values(t["part"], "p_name")


@query("distinct_exact", "SELECT DISTINCT event_type AS value FROM events WHERE event_type = 'click'")
def distinct_exact(t: Tables) -> DataFrame:
    return profiling.distinct_values(t["events"], "event_type", "click", "exact")


@query("distinct_regex", "SELECT DISTINCT p_name AS value FROM part WHERE regexp_matches(p_name, 'RED.*g', 'i')")
def distinct_regex(t: Tables) -> DataFrame:
    return profiling.distinct_values(t["part"], "p_name", "RED.*g", "regex")


@query(
    "distinct_fuzzy",
    """SELECT DISTINCT c_mktsegment AS value FROM customer
WHERE jaro_winkler_similarity(c_mktsegment, 'MACHINE') * 100 >= 50""",
)
def distinct_fuzzy(t: Tables) -> DataFrame:
    return profiling.distinct_values(t["customer"], "c_mktsegment", "MACHINE")


@query("distinct_fallback", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_fallback(t: Tables) -> DataFrame:
    return profiling.distinct_values(t["customer"], "c_mktsegment", "NO SUCH SEGMENT", "exact")


@query(
    "distinct_capped",
    f"""WITH v AS (SELECT DISTINCT o_orderkey AS value FROM orders),
w AS (SELECT value, 1 + sum(length(CAST(value AS VARCHAR)) + 1) OVER (ORDER BY value) AS used FROM v)
SELECT value, (SELECT max(used) FROM w) > {profiling.MAX_CHARS} AS truncated FROM w WHERE used <= {profiling.MAX_CHARS}""",
)
def distinct_capped(t: Tables) -> DataFrame:
    return profiling.truncate_values(profiling.distinct_values(t["orders"], "o_orderkey"))


@query(
    "range_numeric",
    "SELECT 'p_retailprice' AS column_name, min(p_retailprice) AS min_value, max(p_retailprice) AS max_value FROM part",
)
def range_numeric(t: Tables) -> DataFrame:
    return profiling.range_values(t["part"], "p_retailprice")


@query(
    "range_footers",
    """SELECT 'p_retailprice' AS column_name, min(p_retailprice) AS min_value, max(p_retailprice) AS max_value FROM part""",
)
def range_footers(t: Tables) -> DataFrame:
    """The same bounds, from the footers of the files alone."""
    return profiling.range_from_footers(t.spark, t.path("part"), "p_retailprice")


@query(
    "sql_jaro_winkler",
    """SELECT DISTINCT c_mktsegment AS segment, round(jaro_winkler_similarity(c_mktsegment, 'MACHINES'), 6) AS score
FROM customer WHERE jaro_winkler_similarity(c_mktsegment, 'MACHINES') >= 0.45""",
)
def sql_jaro_winkler(t: Tables) -> DataFrame:
    """The similarity score called from SQL text, on distinct values."""
    tools.register(t.spark)
    t.register_views("customer")
    return t.spark.sql(
        """SELECT segment, round(jaro_winkler(segment, 'MACHINES'), 6) AS score
        FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer) WHERE jaro_winkler(segment, 'MACHINES') >= 0.45"""
    )


@query(
    "sql_distinct_values",
    "SELECT event_type AS key, CAST(user_id AS VARCHAR) AS value, count(*) AS n_rows FROM events GROUP BY 1, 2",
)
def sql_distinct_values(t: Tables) -> DataFrame:
    """A table function called from SQL text: the distinct users of each event type, from sorted partitions."""
    tools.register(t.spark)
    t.register_views("events")
    return t.spark.sql(
        "SELECT * FROM distinct_values_of(TABLE(SELECT event_type, user_id FROM events) PARTITION BY event_type ORDER BY user_id)"
    )


@query(
    "sql_trace_summary",
    """SELECT CAST(conv_id AS VARCHAR) AS execution, count(*) AS n_steps, count(*) FILTER (WHERE role = 'assistant' AND text <> '') AS n_done,
       CASE WHEN arg_max(role = 'assistant' AND text <> '', turn) THEN arg_max(text, turn) END AS answer
FROM conversations GROUP BY conv_id""",
)
def sql_trace_summary(t: Tables) -> DataFrame:
    """A table function called from SQL text: steps, results and answer of every conversation."""
    tools.register(t.spark)
    t.register_views("conversations")
    return t.spark.sql(
        """SELECT * FROM trace_summary(
            TABLE(SELECT conv_id AS execution, turn AS step, if(role = 'assistant', text, NULL) AS result FROM conversations)
            PARTITION BY execution ORDER BY step)"""
    )


@query("range_timestamp", "SELECT 'ts' AS column_name, min(ts) AS min_value, max(ts) AS max_value FROM events")
def range_timestamp(t: Tables) -> DataFrame:
    return profiling.range_values(t["events"], "ts")


def _bound_sql(column: str, finding: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, '{finding}' AS finding, 1 AS rank, "
        f"CAST({finding}({column}){' + 0.0' if column == 'value' else ''} AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS score FROM events"
    )


@query(
    "diagnose_empty",
    "\nUNION ALL ".join(_bound_sql(c, f) for c in ("value", "ts") for f in ("min", "max"))
    + "".join(
        f"""
UNION ALL SELECT '{c}', 'outside', 1, '{shown}', NULL FROM (SELECT min({c}) AS low, max({c}) AS high FROM events)
WHERE low > {value} OR high < {value}"""
        for c, shown, value in (("value", "1000000000.0", "1e9"), ("ts", "2031-01-01", "TIMESTAMP '2031-01-01'"))
    )
    + """
UNION ALL
SELECT 'event_type', 'nearest', CAST(row_number() OVER (ORDER BY score DESC, value) AS INTEGER), value, score
FROM (SELECT event_type AS value, round(jaro_winkler_similarity(event_type, 'clck'), 6) AS score
      FROM events GROUP BY event_type ORDER BY score DESC, value LIMIT 5)""",
)
def diagnose_empty(t: Tables) -> DataFrame:
    searched = [("event_type", "clck"), ("value", 1e9), ("ts", "2031-01-01")]
    return profiling.diagnose_empty(t["events"], searched)


@query("agent_slug", rf"SELECT p_partkey, regexp_replace(lower(p_name), '{SPACE}+', '_', 'g') AS agent_id FROM part")
def agent_slug(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", text.slug(F.col("p_name")).alias("agent_id"))


@query(
    "split_list",
    rf"""WITH parts AS (
  SELECT conv_id, turn,
         [x FOR x IN [regexp_replace(y, '^{SPACE}+|{SPACE}+$', '', 'g') FOR y IN string_split(text, ',')] IF x <> ''] AS items
  FROM conversations)
SELECT conv_id, turn, len(items) AS n_items, array_to_string(items, '|') AS joined FROM parts""",
)
def split_list(t: Tables) -> DataFrame:
    items = text.split_list(F.col("text"))
    return t["conversations"].select("conv_id", "turn", items.alias("items")).select(
        "conv_id", "turn", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", "|").alias("joined")
    )


@query(
    "extract_block",
    r"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '{"turn":' || turn || '}' END AS block,
       CASE WHEN role = 'assistant' THEN text || e'\n' || e'\nrest'
            WHEN role = 'user' THEN text || e'\n```chartjs\nnot json\n```\nrest' ELSE text END AS narrative
FROM conversations""",
)
def extract_block(t: Tables) -> DataFrame:
    fence = F.when(
        F.col("role") == "assistant",
        F.concat(F.lit('\n```chartjs\n{"turn":'), F.col("turn").cast("string"), F.lit("}\n```\nrest")),
    ).when(F.col("role") == "user", F.lit("\n```chartjs\nnot json\n```\nrest")).otherwise(F.lit(""))
    answers = t["conversations"].select("conv_id", "turn", F.concat("text", fence).alias("answer"))
    return answers.select(
        "conv_id", "turn", text.fenced_block(F.col("answer")).alias("block"), text.without_block(F.col("answer")).alias("narrative")
    )
