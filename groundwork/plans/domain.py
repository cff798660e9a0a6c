"""Business views over the given tables, each as a DataFrame and as the SQL that matches it.

The tables hold orders, parts, events and texts; the operators speak of agents, stock,
routes and logs. The mapping is ours and is the same on both sides.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators import graph
from groundwork.sources.tables import Tables

# --- agents -------------------------------------------------------------------------------

TOOL_LISTS = (
    '["run_sql","vector_search"]',
    '["run_sql","supply_graph","draft_transfer"]',
    '["vector_search"]',
    '["supply_graph"]',
)
TARGETS = ("HYBRID", "DB_NATIVE", "GCP_CONTAINER")


def agents(people: DataFrame, nation: DataFrame, key: str, name: str, nation_key: str, balance: str) -> DataFrame:
    """Agent records from a supplier- or customer-like table."""
    number = F.col(key)
    born = F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast({key} % 1000 as int))")
    return people.join(nation, F.col(nation_key) == F.col("n_nationkey")).select(
        F.concat(F.lit("agent_"), number.cast("string")).alias("agent_id"),
        F.col(name).alias("agent_name"),
        F.col("n_name").alias("domain_scope"),
        F.concat(F.lit("profile_"), F.col("n_regionkey").cast("string")).alias("model_profile"),
        F.element_at(F.array(*map(F.lit, TARGETS)), (number % 3 + 1).cast("int")).alias("deployment_target"),
        F.concat(F.lit("You audit "), F.col(name)).alias("system_role"),
        F.concat(F.lit("Report on "), F.col("n_name")).alias("task_instruction"),
        F.element_at(F.array(*map(F.lit, TOOL_LISTS)), (number % 4 + 1).cast("int")).alias("tools_json"),
        F.when(F.col(balance) >= 0, F.lit("ACTIVE")).otherwise(F.lit("DECOMMISSIONED")).alias("status"),
        born.alias("created_at"),
        born.alias("updated_at"),
    )


def _agents_sql(view: str, table: str, p: str) -> str:
    key = f"{p}_{'supp' if p == 's' else 'cust'}key"
    targets = ", ".join(f"'{t}'" for t in TARGETS)
    tools = ", ".join(f"'{t}'" for t in TOOL_LISTS)
    born = f"TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST({key} % 1000 AS INT))"
    return f"""{view} AS (
  SELECT 'agent_' || {key} AS agent_id, {p}_name AS agent_name, n_name AS domain_scope,
         'profile_' || n_regionkey AS model_profile,
         ([{targets}])[CAST({key} % 3 + 1 AS INT)] AS deployment_target,
         'You audit ' || {p}_name AS system_role, 'Report on ' || n_name AS task_instruction,
         ([{tools}])[CAST({key} % 4 + 1 AS INT)] AS tools_json,
         CASE WHEN {p}_acctbal >= 0 THEN 'ACTIVE' ELSE 'DECOMMISSIONED' END AS status,
         {born} AS created_at, {born} AS updated_at
  FROM {table} JOIN nation ON {p}_nationkey = n_nationkey)"""


def catalog(t: Tables) -> DataFrame:
    """Suppliers as provisioned agents."""
    return agents(t["supplier"], t["nation"], "s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def blueprints(t: Tables) -> DataFrame:
    """Customers as agents to provision; their ids overlap the catalogue's and go beyond it."""
    return agents(t["customer"], t["nation"], "c_custkey", "c_name", "c_nationkey", "c_acctbal")


CATALOG = _agents_sql("catalog", "supplier", "s")
BLUEPRINTS = _agents_sql("blueprints", "customer", "c")

# --- events as metrics, logs and audit trail ----------------------------------------------


def metrics(t: Tables) -> DataFrame:
    return t["events"].select(
        F.col("event_id").alias("execution_id"),
        F.col("user_id").alias("agent_id"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("execution_status"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tool_calls_count"),
        F.col("event_type").alias("executed_by"),
        F.col("ts").alias("executed_at"),
    )


METRICS = """metrics AS (
  SELECT event_id AS execution_id, user_id AS agent_id,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS execution_status,
         value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tool_calls_count,
         event_type AS executed_by, ts AS executed_at
  FROM events)"""

# One tag per event type; errors carry none, like text printed without a prefix.
EVENT_TAGS = {
    "click": "[Graph Agent] ",
    "view": "[Spatial Agent v2] ",
    "purchase": "[Action Agent]",
    "signup": "[ RAG engine ]  ",
}
EVENT_LEVELS = {"error": "ERROR", "signup": "WARNING"}


def log_line(event_type: str = "event_type", value: str = "value", props: str = "props"):
    """Column with the log text of an event."""
    tag = F.lit("")
    for kind, text in EVENT_TAGS.items():
        tag = F.when(F.col(event_type) == kind, text).otherwise(tag)
    return F.concat(tag, F.col(event_type), F.lit(" "), F.col(value).cast("string"), F.lit(" "), F.col(props))


def logs(t: Tables) -> DataFrame:
    """(event_id, ts, type, line), not yet parsed."""
    level = F.lit("INFO")
    for kind, name in EVENT_LEVELS.items():
        level = F.when(F.col("event_type") == kind, name).otherwise(level)
    return t["events"].select("event_id", "ts", level.alias("type"), log_line().alias("line"))


_TAG_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TAGS.items()) + " ELSE '' END"
_LEVEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_LEVELS.items()) + " ELSE 'INFO' END"

LOGS = f"""logs AS (
  SELECT event_id, ts, {_LEVEL_SQL} AS type,
         {_TAG_SQL} || event_type || ' ' || CAST(value AS VARCHAR) || ' ' || props AS line
  FROM events)"""


# The log format as one pattern, for the SQL side.
SPACE = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINE_END = r"\n\r\x{2028}\x{2029}"
LOG_LINE = rf"^\[([^\]{LINE_END}]*)\]{SPACE}*([^{LINE_END}]*)"


def parse_sql(view: str, source: str, columns: str) -> str:
    """SQL twin of ``telemetry.parse_logs`` + ``classify`` over a view with a ``line`` column."""
    return f"""{view}_tagged AS (
  SELECT {columns}, line, regexp_matches(line, '{LOG_LINE}') AS tagged,
         regexp_extract(line, '{LOG_LINE}', 1) AS raw_tag, regexp_extract(line, '{LOG_LINE}', 2) AS rest
  FROM {source}),
{view}_split AS (
  SELECT {columns}, line,
         nullif(regexp_replace(raw_tag, '^{SPACE}+|{SPACE}+$', '', 'g'), '') AS tag,
         CASE WHEN tagged AND rest <> '' THEN rest ELSE line END AS message
  FROM {view}_tagged),
{view} AS (
  SELECT *, CASE WHEN contains(tag, 'Graph Agent') THEN 'Graph Agent'
                 WHEN contains(tag, 'Spatial Agent') THEN 'Spatial Agent'
                 WHEN contains(tag, 'Database Agent') THEN 'Database Agent'
                 WHEN contains(tag, 'Action Agent') THEN 'Inventory Action Agent'
                 WHEN contains(tag, 'RAG') THEN 'RAG Agent' ELSE 'Server' END AS agent
  FROM {view}_split)"""


PARSED = LOGS + ",\n" + parse_sql("parsed", "logs", "event_id, ts, type")


def trail(t: Tables) -> DataFrame:
    return t["events"].select(
        "event_id",
        "ts",
        F.col("user_id").alias("actor"),
        F.col("event_type").alias("action"),
        F.get_json_object("props", "$.k").cast("bigint").alias("origin"),
    )


TRAIL = """trail AS (
  SELECT event_id, ts, user_id AS actor, event_type AS action,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS origin
  FROM events)"""


def allowed(t: Tables) -> DataFrame:
    """Actors cleared for sensitive actions: customers in good standing."""
    return t["customer"].where(F.col("c_acctbal") >= 5000).select("c_custkey")


ALLOWED = "allowed AS (SELECT c_custkey AS actor FROM customer WHERE c_acctbal >= 5000)"
SENSITIVE = ("error", "purchase")

# --- stock, shipments and routes ----------------------------------------------------------


def supplier_nation(t: Tables) -> DataFrame:
    return t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("s_nation"), F.col("n_regionkey").alias("s_region")
    )


def customer_nation(t: Tables) -> DataFrame:
    return t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("c_nation")
    )


def inventory(t: Tables) -> DataFrame:
    """(sku, warehouse, on_hand): open quantity per brand and supplier nation.

    Lines are summed per part and supplier first, so the joins carry one row for each.
    """
    held = (
        t["lineitem"]
        .where(F.col("l_linestatus") == "O")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").cast("bigint").alias("on_hand"))
    )
    return (
        held.join(supplier_nation(t), "l_suppkey")
        .join(t["part"].select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sku")), "l_partkey")
        .groupBy("sku", F.col("s_nation").alias("warehouse"))
        .agg(F.sum("on_hand").alias("on_hand"))
    )


INVENTORY = """inventory AS (
  SELECT p_brand AS sku, n_name AS warehouse, CAST(sum(l_quantity) AS BIGINT) AS on_hand
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
  WHERE l_linestatus = 'O' GROUP BY 1, 2)"""

# Smallest decimal types that hold the money and rate columns exactly.
PRICE = "decimal(12,2)"
RATE = "decimal(4,2)"

STATUS = {"O": "IN_TRANSIT", "P": "CUSTOMS_HOLD", "F": "DELIVERED"}
AT_RISK = 0.08


def shipments(t: Tables) -> DataFrame:
    """Shipments summed per part and order status: (product_id, status, and running sums)."""
    rate = F.col("l_discount").cast(RATE)
    status = F.coalesce(*[F.when(F.col("o_orderstatus") == k, v) for k, v in STATUS.items()])
    orders = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), status.alias("status"))
    return (
        t["lineitem"]
        .join(orders, "l_orderkey")
        .groupBy("l_partkey", "status")
        .agg(
            F.count("*").alias("n_shipments"),
            F.sum("l_quantity").cast("bigint").alias("quantity"),
            F.sum(rate).alias("risk_total"),
            F.count_if(rate >= F.lit(AT_RISK).cast(RATE)).alias("n_at_risk"),
        )
        .join(t["part"].select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_id")), "l_partkey")
    )


SHIPMENTS = f"""shipments AS (
  SELECT p_brand AS product_id,
         CASE o_orderstatus WHEN 'O' THEN 'IN_TRANSIT' WHEN 'P' THEN 'CUSTOMS_HOLD' WHEN 'F' THEN 'DELIVERED' END AS status,
         CAST(l_quantity AS BIGINT) AS quantity, CAST(l_discount AS {RATE}) AS risk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

MODES = {"A": "SEA", "N": "RAIL", "R": "TRUCK"}


def order_nation(t: Tables) -> DataFrame:
    """(l_orderkey, o_orderdate, c_nation): orders meet customers before the far larger lines do."""
    orders = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    return orders.join(customer_nation(t), "o_custkey").drop("o_custkey")


def lanes(t: Tables) -> DataFrame:
    """Lines summed per (supplier nation, supplier region, customer nation, return flag).

    The lines are shuffled once, on the order key, with the few columns needed; adaptive
    execution splits an order or supplier that holds very many of them. What leaves the last
    join is summed in each task first.
    """
    lag = F.datediff("l_shipdate", "o_orderdate")
    return (
        t["lineitem"]
        .join(supplier_nation(t), "l_suppkey")
        .join(order_nation(t), "l_orderkey")
        .groupBy("s_nation", "s_region", "c_nation", "l_returnflag")
        .agg(
            F.sum(F.when(lag >= 0, lag).otherwise(0)).cast("bigint").alias("lag_total"),
            F.count_if(lag >= 0).alias("n_lagged"),
            F.count("*").alias("n_lines"),
            F.sum(F.col("l_discount").cast(RATE)).alias("discount_total"),
            F.sum(F.col("l_extendedprice").cast(PRICE)).alias("price_total"),
        )
    )


LANES = f"""lanes AS (
  SELECT sn.n_name AS s_nation, sn.n_regionkey AS s_region, cn.n_name AS c_nation, l_returnflag,
         sum(CASE WHEN l_shipdate >= o_orderdate THEN date_diff('day', o_orderdate, l_shipdate) ELSE 0 END) AS lag_total,
         count(*) FILTER (WHERE l_shipdate >= o_orderdate) AS n_lagged, count(*) AS n_lines,
         sum(CAST(l_discount AS {RATE})) AS discount_total, sum(CAST(l_extendedprice AS {PRICE})) AS price_total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
       JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  GROUP BY 1, 2, 3, 4)"""

# Average of an exact total: one division, so both sides give the same double.
_AVG = "{0} / CAST({1} AS DOUBLE)"
LANE_FIGURES = ", ".join(
    [
        _AVG.format("CAST(sum(lag_total) AS DOUBLE)", "sum(n_lagged)") + " AS transit_days",
        _AVG.format("CAST(sum(price_total) AS DOUBLE)", "sum(n_lines)") + " AS {cost}",
        _AVG.format("CAST(sum(discount_total) AS DOUBLE)", "sum(n_lines)") + " AS {risk}",
    ]
)


def _lane_figures(cost: str, risk: str) -> list:
    def average(total: str, count: str, name: str):
        return F.try_divide(F.sum(total).cast("double"), F.sum(count).cast("double")).alias(name)

    return [
        average("lag_total", "n_lagged", "transit_days"),
        average("price_total", "n_lines", cost),
        average("discount_total", "n_lines", risk),
    ]


def routes(t: Tables) -> DataFrame:
    """(route_id, origin, destination, transport_mode, transit_days, cost_per_ton, risk_factor)."""
    mode = F.coalesce(*[F.when(F.col("l_returnflag") == k, v) for k, v in MODES.items()])
    return (
        lanes(t)
        .groupBy(F.col("s_nation").alias("origin"), F.col("c_nation").alias("destination"), mode.alias("transport_mode"))
        .agg(*_lane_figures("cost_per_ton", "risk_factor"))
        .withColumn("route_id", F.concat_ws("-", "origin", "destination", "transport_mode"))
    )


ROUTES = (
    LANES
    + f""",
routes AS (
  SELECT s_nation || '-' || c_nation || '-' || mode AS route_id, s_nation AS origin, c_nation AS destination,
         mode AS transport_mode, {LANE_FIGURES.format(cost="cost_per_ton", risk="risk_factor")}
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'SEA' WHEN 'N' THEN 'RAIL' WHEN 'R' THEN 'TRUCK' END AS mode FROM lanes)
  GROUP BY s_nation, c_nation, mode)"""
)

# --- graph --------------------------------------------------------------------------------


def vertices(t: Tables) -> DataFrame:
    """Suppliers in good standing, and a plant, port and warehouse for each place in use."""
    supplier, nation, region = t["supplier"], t["nation"], t["region"]
    plants = supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct().join(nation, "n_nationkey")
    warehouses = t["customer"].select(F.col("c_nationkey").alias("n_nationkey")).distinct().join(nation, "n_nationkey")

    def named(df: DataFrame, prefix: str, key: str, name: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"))

    return graph.vertices(
        {
            "Supplier": named(supplier.where(F.col("s_acctbal") >= 0), "S:", "s_suppkey", "s_name"),
            "Plant": named(plants, "P:", "n_name", "n_name"),
            "Port": named(region, "R:", "r_regionkey", "r_name"),
            "Warehouse": named(warehouses, "W:", "n_name", "n_name"),
        }
    )


VERTICES = """vertices AS (
  SELECT 'S:' || s_suppkey AS id, 'Supplier' AS label, s_name AS name FROM supplier WHERE s_acctbal >= 0
  UNION ALL SELECT 'P:' || n_name, 'Plant', n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'R:' || r_regionkey, 'Port', r_name FROM region
  UNION ALL SELECT 'W:' || n_name, 'Warehouse', n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer))"""


def _edge(src, dst, transit, cost, risk) -> list:
    return [
        src.alias("src"),
        dst.alias("dst"),
        transit.cast("double").alias("transit_days"),
        cost.cast("double").alias("cost"),
        risk.cast("double").alias("risk"),
    ]


def edges(t: Tables) -> DataFrame:
    """Supplier -> plant -> port -> warehouse, with transit days, cost and risk."""
    placed = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    supplier, plant = F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")), F.concat(F.lit("P:"), F.col("n_name"))
    port = F.concat(F.lit("R:"), F.col("n_regionkey").cast("string"))
    feeds = placed.select(
        *_edge(supplier, plant, F.lit(1), F.abs("s_acctbal"), F.when(F.col("s_acctbal") < 0, 0.5).otherwise(0.0))
    )
    exports = placed.groupBy("n_name", "n_regionkey").agg(F.count("*").alias("n")).select(
        *_edge(plant, port, F.lit(2), F.col("n"), F.lit(0.1))
    )
    ships = (
        lanes(t)
        .groupBy("s_region", "c_nation")
        .agg(*_lane_figures("cost", "risk"))
        .select(
            *_edge(
                F.concat(F.lit("R:"), F.col("s_region").cast("string")),
                F.concat(F.lit("W:"), F.col("c_nation")),
                F.col("transit_days"),
                F.col("cost"),
                F.col("risk"),
            )
        )
    )
    return feeds.unionByName(exports).unionByName(ships)


EDGES = (
    LANES
    + f""",
edges AS (
  SELECT 'S:' || s_suppkey AS src, 'P:' || n_name AS dst, CAST(1 AS DOUBLE) AS transit_days, abs(s_acctbal) AS cost,
         CASE WHEN s_acctbal < 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS risk
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'P:' || n_name, 'R:' || n_regionkey, CAST(2 AS DOUBLE), CAST(count(*) AS DOUBLE), CAST(0.1 AS DOUBLE)
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, n_regionkey
  UNION ALL
  SELECT 'R:' || s_region, 'W:' || c_nation, {LANE_FIGURES.format(cost="cost", risk="risk")}
  FROM lanes GROUP BY s_region, c_nation)"""
)


def supply(t: Tables) -> DataFrame:
    """Distinct (sku, supplier, plant, port, warehouse) served by order lines."""
    part = t["part"].select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sku"))
    return (
        t["lineitem"]
        .join(part, "l_partkey")
        .join(order_nation(t), "l_orderkey")
        .select("sku", "l_suppkey", "c_nation")
        .distinct()
        .join(supplier_nation(t), "l_suppkey")
        .select(
            "sku",
            F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("supplier"),
            F.concat(F.lit("P:"), F.col("s_nation")).alias("plant"),
            F.concat(F.lit("R:"), F.col("s_region").cast("string")).alias("port"),
            F.concat(F.lit("W:"), F.col("c_nation")).alias("warehouse"),
        )
    )


SUPPLY = """supply AS (
  SELECT DISTINCT p_brand AS sku, 'S:' || l_suppkey AS supplier, 'P:' || sn.n_name AS plant,
         'R:' || sn.n_regionkey AS port, 'W:' || cn.n_name AS warehouse
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey),
dependency AS (
  SELECT DISTINCT sku, 1 AS tier, supplier AS src, plant AS dst FROM supply
  UNION SELECT DISTINCT sku, 2, plant, port FROM supply
  UNION SELECT DISTINCT sku, 3, port, warehouse FROM supply)"""

# A nation is disrupted when more than this share of what it ships comes back.
RETURN_LIMIT = 0.33
SEVERE = 0.34


def disruptions(t: Tables) -> DataFrame:
    """(location_name, disruption_type, severity, impact_score, active_flag, delay_days) per nation."""
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("n_lines")).otherwise(0))
    share = returned / F.sum("n_lines")
    return (
        lanes(t)
        .groupBy(F.col("s_nation").alias("location_name"))
        .agg(share.alias("impact_score"), *_lane_figures("cost", "risk"))
        .select(
            "location_name",
            F.lit("Returned goods").alias("disruption_type"),
            F.when(F.col("impact_score") > SEVERE, "HIGH").otherwise("MEDIUM").alias("severity"),
            "impact_score",
            F.when(F.col("impact_score") > RETURN_LIMIT, "Y").otherwise("N").alias("active_flag"),
            F.col("transit_days").alias("delay_days"),
        )
    )


DISRUPTIONS = f"""disruption_base AS (
  SELECT s_nation AS location_name,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN n_lines ELSE 0 END) AS DOUBLE) / CAST(sum(n_lines) AS DOUBLE) AS impact_score,
         {_AVG.format("CAST(sum(lag_total) AS DOUBLE)", "sum(n_lagged)")} AS delay_days
  FROM lanes GROUP BY 1),
disruptions AS (
  SELECT *, 'Returned goods' AS disruption_type, CASE WHEN impact_score > {SEVERE} THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         CASE WHEN impact_score > {RETURN_LIMIT} THEN 'Y' ELSE 'N' END AS active_flag
  FROM disruption_base)"""

# --- retrieval ----------------------------------------------------------------------------


def contents(t: Tables) -> DataFrame:
    """(id, content): a vector's text is the document of the same number, where there is one."""
    return t["documents"].select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def rag_rows(t: Tables) -> DataFrame:
    """(id, content, metadata, embedding): chunks with their metadata as JSON text, where a document has a vector."""
    described = F.to_json(F.struct("lang", "source", F.struct(F.col("n_chars").alias("chars")).alias("size")))
    texts = t["documents"].select(F.col("doc_id").alias("id"), F.col("text").alias("content"), described.alias("metadata"))
    return texts.join(t["embeddings"].select(F.col("vec_id").alias("id"), "embedding"), "id")


def vectors(t: Tables) -> DataFrame:
    return t["embeddings"].select(F.col("vec_id").alias("id"), "embedding", "label")


def topic_vectors(t: Tables) -> DataFrame:
    """(query_id, embedding): the mean vector of each label, as many queries as labels."""
    # One running sum per label and task; the rounding hides the order of summation.
    mean = vector_to_array(Summarizer.mean(array_to_vector("embedding")))
    means = t["embeddings"].groupBy(F.col("label").cast("bigint").alias("query_id")).agg(mean.alias("embedding"))
    return means.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 9)))


TOPICS = """components AS (
  SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
topics AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS embedding FROM components GROUP BY 1)"""


def scores_sql(corpus: str = "embeddings", k: int = 5, name: str = "near") -> str:
    """SQL twin of the batch top-k of ``topics`` against a table with vec_id and embedding."""
    return f"""scored AS (
  SELECT query_id, vec_id AS id,
         round(-list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS distance
  FROM {corpus} c, topics q),
{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {k})"""
