"""Upserts, deletes, partial updates and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators import quality, upsert
from groundwork.plans import domain
from groundwork.plans.registry import query, with_views
from groundwork.sources import buckets
from groundwork.sources.scratch import scratch_dir
from groundwork.sources.tables import Tables
from groundwork.sources.versions import append

# Orders up to here are the stored table, later ones the change to merge.
CUT = "1997-01-01"
AS_OF = "2025-01-01 00:00:00"
MONEY = "decimal(18,2)"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _day(ts: str):
    return F.date_format(ts, "yyyy-MM-dd")


def _per_customer(orders: DataFrame) -> DataFrame:
    # Extremes of timestamps hash-aggregate; of formatted strings they would sort.
    totals = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.count("*").alias("n_orders"),
        F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("total"),
    )
    return totals.withColumns({"first_order": _day("first_order"), "last_order": _day("last_order")})


def _per_customer_sql(view: str, comparison: str) -> str:
    return f"""{view} AS (
  SELECT o_custkey AS custkey, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_order,
         max(strftime(o_orderdate, '%Y-%m-%d')) AS last_order, count(*) AS n_orders,
         CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS total
  FROM orders WHERE o_orderdate {comparison} TIMESTAMP '{CUT}' GROUP BY 1)"""


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(CUT).cast("timestamp_ntz")
    return t["orders"].where(F.col("o_orderdate") < cut), t["orders"].where(F.col("o_orderdate") >= cut)


@query(
    "merge_upsert",
    with_views(
        _per_customer_sql("stored", "<"),
        _per_customer_sql("changed", ">="),
        select="""SELECT coalesce(s.custkey, c.custkey) AS custkey,
       CASE WHEN s.custkey IS NULL THEN 'unknown' ELSE s.first_order END AS first_order,
       coalesce(c.last_order, s.last_order) AS last_order, coalesce(c.n_orders, s.n_orders) AS n_orders,
       coalesce(c.total, s.total) AS total, CASE WHEN s.custkey IS NULL THEN 'NEW' ELSE 'STORED' END AS tier
FROM stored s FULL JOIN changed c ON s.custkey = c.custkey""",
    ),
)
def merge_upsert(t: Tables) -> DataFrame:
    """Customer totals up to a day, brought up to date with the later ones."""
    before, after = _split(t)
    target = _per_customer(before).withColumn("tier", F.lit("STORED"))
    return upsert.merge_into(
        target,
        _per_customer(after).drop("first_order"),
        ["custkey"],
        ["last_order", "n_orders", "total"],
        {"first_order": F.lit("unknown"), "tier": F.lit("NEW")},
    )


@query(
    "merge_dedup",
    with_views(
        f"""later AS (
  SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)""",
        select="""SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, c_mktsegment, o_orderkey AS last_orderkey,
       o_orderpriority AS last_priority
FROM customer FULL JOIN later ON c_custkey = o_custkey""",
    ),
)
def merge_dedup(t: Tables) -> DataFrame:
    """Several changes per customer: only the newest order counts."""
    _, after = _split(t)
    changes = after.select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderkey").alias("last_orderkey"),
        F.col("o_orderpriority").alias("last_priority"),
        "o_orderdate",
    )
    newest = upsert.latest_per_key(changes, ["c_custkey"], ["o_orderdate", "last_orderkey"]).drop("o_orderdate")
    target = t["customer"].select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        F.lit(None).cast("bigint").alias("last_orderkey"),
        F.lit(None).cast("string").alias("last_priority"),
    )
    return upsert.merge_into(target, newest, ["c_custkey"], ["last_orderkey", "last_priority"])


_DESCRIBED = (
    "agent_name", "domain_scope", "model_profile", "deployment_target", "system_role", "task_instruction", "tools_json",
)

UPSERTED_SQL = with_views(
    domain.CATALOG,
    domain.BLUEPRINTS,
    select="SELECT coalesce(c.agent_id, b.agent_id) AS agent_id, "
    + ", ".join(f"CASE WHEN b.agent_id IS NULL THEN c.{c} ELSE b.{c} END AS {c}" for c in _DESCRIBED)
    + f""",
       CASE WHEN b.agent_id IS NULL THEN c.status ELSE 'ACTIVE' END AS status,
       coalesce(c.created_at, TIMESTAMP '{AS_OF}') AS created_at,
       CASE WHEN b.agent_id IS NULL THEN c.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
FROM catalog c FULL JOIN blueprints b ON c.agent_id = b.agent_id""",
)


@query("catalog_upsert", UPSERTED_SQL)
def catalog_upsert(t: Tables) -> DataFrame:
    provisioned = domain.blueprints(t).drop("status", "created_at", "updated_at")
    return upsert.catalog_upsert(domain.catalog(t), provisioned, _as_of())


@query(
    "soft_delete",
    with_views(
        domain.CATALOG,
        domain.BLUEPRINTS,
        "gone AS (SELECT agent_id FROM blueprints WHERE status = 'DECOMMISSIONED')",
        select=f"""SELECT agent_id, agent_name, CASE WHEN agent_id IN (SELECT agent_id FROM gone) THEN 'DECOMMISSIONED' ELSE status END AS status,
       CASE WHEN agent_id IN (SELECT agent_id FROM gone) THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
FROM catalog""",
    ),
)
def soft_delete(t: Tables) -> DataFrame:
    gone = domain.blueprints(t).where(F.col("status") == "DECOMMISSIONED").select("agent_id")
    after = upsert.soft_delete(domain.catalog(t), "agent_id", gone, _as_of())
    return after.select("agent_id", "agent_name", "status", "updated_at")


@query(
    "cascade_delete",
    """SELECT 'customer' AS table_name, c_custkey AS custkey, c_custkey AS row_key FROM customer WHERE c_acctbal >= 0
UNION ALL
SELECT 'orders', o_custkey, o_orderkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def cascade_delete(t: Tables) -> DataFrame:
    """Customers in debt leave with their orders; the rows that stay."""
    indebted = t["customer"].where(F.col("c_acctbal") < 0).select("c_custkey")
    parent, child = upsert.cascade_delete(t["customer"], t["orders"], "c_custkey", "o_custkey", indebted)

    def rows(df: DataFrame, name: str, custkey: str, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), F.col(custkey).alias("custkey"), F.col(key).alias("row_key"))

    return rows(parent, "customer", "c_custkey", "c_custkey").unionByName(rows(child, "orders", "o_custkey", "o_orderkey"))


@query(
    "patch_update",
    with_views(
        domain.CATALOG,
        domain.BLUEPRINTS,
        """changes AS (
  SELECT agent_id, CASE WHEN model_profile = 'profile_0' THEN '' ELSE agent_name END AS agent_name,
         CASE WHEN status = 'ACTIVE' THEN task_instruction END AS task_instruction,
         CASE WHEN model_profile = 'profile_1' THEN '' ELSE domain_scope END AS domain_scope
  FROM blueprints)""",
        select="""SELECT c.agent_id, coalesce(nullif(n.agent_name, ''), c.agent_name) AS agent_name,
       coalesce(nullif(n.task_instruction, ''), c.task_instruction) AS task_instruction,
       coalesce(n.domain_scope, c.domain_scope) AS domain_scope
FROM catalog c LEFT JOIN changes n ON c.agent_id = n.agent_id""",
    ),
)
def patch_update(t: Tables) -> DataFrame:
    changes = domain.blueprints(t).select(
        "agent_id",
        F.when(F.col("model_profile") == "profile_0", "").otherwise(F.col("agent_name")).alias("agent_name"),
        F.when(F.col("status") == "ACTIVE", F.col("task_instruction")).alias("task_instruction"),
        F.when(F.col("model_profile") == "profile_1", "").otherwise(F.col("domain_scope")).alias("domain_scope"),
    )
    after = upsert.patch(domain.catalog(t), changes, "agent_id", blank_allowed=["domain_scope"])
    return after.select("agent_id", "agent_name", "task_instruction", "domain_scope")


@query(
    "lookup_fallback",
    with_views(
        domain.CATALOG,
        domain.BLUEPRINTS,
        "asked AS (SELECT DISTINCT 'agent_' || user_id AS agent_id FROM events)",
        select="""SELECT a.agent_id, CASE WHEN c.agent_id IS NULL THEN b.agent_name ELSE c.agent_name END AS agent_name,
       CASE WHEN c.agent_id IS NULL THEN b.status ELSE c.status END AS status,
       CASE WHEN c.agent_id IS NOT NULL THEN 'primary' WHEN b.agent_id IS NOT NULL THEN 'fallback' END AS found_in
FROM asked a LEFT JOIN catalog c ON a.agent_id = c.agent_id LEFT JOIN blueprints b ON a.agent_id = b.agent_id""",
    ),
)
def lookup_fallback(t: Tables) -> DataFrame:
    """Each acting user as a provisioned agent, else as a blueprint."""
    asked = t["events"].select(F.concat(F.lit("agent_"), F.col("user_id").cast("string")).alias("agent_id")).distinct()
    return upsert.lookup(asked, "agent_id", domain.catalog(t), domain.blueprints(t), ["agent_name", "status"])


@query(
    "unique_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def unique_violations(t: Tables) -> DataFrame:
    return quality.unique_violations(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query(
    "check_in_set",
    """SELECT 'o_orderstatus settled' AS rule, count(*) AS n_rows,
       count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS n_violations FROM orders""",
)
def check_in_set(t: Tables) -> DataFrame:
    return quality.check_report(t["orders"], {"o_orderstatus settled": quality.in_set("o_orderstatus", ["O", "F"])})


def _checks_sql(table: str, rules: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS n_rows, count(*) FILTER (WHERE NOT ({rule})) AS n_violations FROM {table}"
        for name, rule in rules.items()
    )


@query(
    "check_report",
    _checks_sql(
        "lineitem",
        {
            "price present": "l_extendedprice IS NOT NULL",
            "flag known": "l_returnflag IN ('A', 'N')",
            "discount in range": "l_discount BETWEEN 0.02 AND 0.08",
            "price within 6,2": "abs(round(l_extendedprice, 2)) < 10000",
        },
    ),
)
def check_report(t: Tables) -> DataFrame:
    return quality.check_report(
        t["lineitem"],
        {
            "price present": quality.not_null("l_extendedprice"),
            "flag known": quality.in_set("l_returnflag", ["A", "N"]),
            "discount in range": quality.between("l_discount", 0.02, 0.08),
            "price within 6,2": quality.fits_precision("l_extendedprice", 6, 2),
        },
    )


@query(
    "fk_orphans",
    """SELECT 'line without order' AS finding, l_orderkey AS key, count(*) AS n_rows FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
UNION ALL
SELECT 'order without line', o_orderkey, count(*) FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 2""",
)
def fk_orphans(t: Tables) -> DataFrame:
    lines = quality.fk_orphans(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey")
    orders = quality.fk_orphans(t["orders"], "o_orderkey", t["lineitem"], "l_orderkey")
    columns = ["finding", "key", "n_rows"]
    return lines.withColumn("finding", F.lit("line without order")).select(*columns).unionByName(
        orders.withColumn("finding", F.lit("order without line")).select(*columns)
    )


@query(
    "contract_violations",
    "WITH "
    + domain.METRICS
    + ",\n"
    + domain.CATALOG
    + """,
results AS (
  SELECT m.execution_id, 'agent_' || m.agent_id AS agent, c.agent_name, c.domain_scope,
         CASE WHEN m.execution_status = 'FAILED' THEN 'ON_PREM' ELSE c.deployment_target END AS target,
         CASE WHEN m.execution_status = 'SUCCESS' THEN m.executed_by END AS data,
         m.latency_ms / 100 AS confidence, m.latency_ms - 1 AS latency
  FROM metrics m LEFT JOIN catalog c ON c.agent_id = 'agent_' || m.agent_id)
"""
    + _checks_sql(
        "results",
        {
            "executionId present": "execution_id IS NOT NULL",
            "agentId present": "agent IS NOT NULL",
            "agentName present": "agent_name IS NOT NULL",
            "domain present": "domain_scope IS NOT NULL",
            "deploymentTarget present": "target IS NOT NULL",
            "data present": "data IS NOT NULL",
            "deploymentTarget known": "target IN ('HYBRID', 'DB_NATIVE', 'GCP_CONTAINER')",
            "confidence in [0, 1]": "confidence BETWEEN 0 AND 1",
            "latencyMs not negative": "latency >= 0",
        },
    ),
)
def contract_violations(t: Tables) -> DataFrame:
    """Executions as result contracts; agents outside the catalogue lack a name and domain."""
    m = domain.metrics(t).withColumn("agent", F.concat(F.lit("agent_"), F.col("agent_id").cast("string")))
    c = domain.catalog(t).withColumnRenamed("agent_id", "agent")
    failed = F.col("execution_status") == "FAILED"
    results = m.join(c, "agent", "left").select(
        F.col("execution_id").alias("executionId"),
        F.col("agent").alias("agentId"),
        F.col("agent_name").alias("agentName"),
        F.col("domain_scope").alias("domain"),
        F.when(failed, F.lit("ON_PREM")).otherwise(F.col("deployment_target")).alias("deploymentTarget"),
        F.when(~failed, F.col("executed_by")).alias("data"),
        F.struct((F.col("latency_ms") / 100).alias("confidence"), (F.col("latency_ms") - 1).alias("latencyMs")).alias(
            "metadata"
        ),
    )
    return quality.contract_violations(results)


CONFIG = """config AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 'key_' || (n_nationkey % 7) AS key, n_name AS value,
  'agent_' || (n_nationkey // 7) AS agent FROM nation),
given AS (SELECT 'key_' || (s_suppkey % 9) AS key, 'agent_' || (s_suppkey // 9 % 5) AS agent, max(s_name) AS value FROM supplier GROUP BY 1, 2)"""


def _config(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Stored configuration and what is to replace or join it."""
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    stored = t["nation"].select(
        n.cast("bigint").alias("id"),
        F.concat(F.lit("key_"), (n % 7).cast("string")).alias("key"),
        F.col("n_name").alias("value"),
        F.concat(F.lit("agent_"), F.floor(n / 7).cast("string")).alias("agent"),
    )
    key = F.concat(F.lit("key_"), (s % 9).cast("string")).alias("key")
    agent = F.concat(F.lit("agent_"), (F.floor(s / 9) % 5).cast("string")).alias("agent")
    return stored, t["supplier"].groupBy(key, agent).agg(F.max("s_name").alias("value"))


@query(
    "config_replace",
    "WITH "
    + CONFIG
    + """,
fresh AS (
  SELECT key, agent, value, (SELECT max(id) FROM config) + row_number() OVER (ORDER BY agent, key) AS id
  FROM given WHERE (key, agent) NOT IN (SELECT (key, agent) FROM config))
SELECT c.id, c.key, coalesce(g.value, c.value) AS value, c.agent FROM config c LEFT JOIN given g ON c.key = g.key AND c.agent = g.agent
UNION ALL SELECT id, key, value, agent FROM fresh""",
)
def config_replace(t: Tables) -> DataFrame:
    return upsert.config_replace(*_config(t))


@query(
    "config_read",
    "WITH "
    + CONFIG
    + """
SELECT g.agent, g.key, c.value, CASE WHEN c.id IS NULL THEN 'no ' || g.key || ' configured for ' || g.agent END AS error
FROM given g LEFT JOIN config c ON c.key = g.key AND c.agent = g.agent""",
)
def config_read(t: Tables) -> DataFrame:
    stored, asked = _config(t)
    return upsert.config_values(stored, asked)


@query(
    "metric_append",
    "WITH "
    + domain.METRICS
    + """
SELECT execution_status, count(*) AS n_rows, count(DISTINCT agent_id) AS n_agents, max(execution_id) AS newest FROM metrics GROUP BY 1""",
)
def metric_append(t: Tables) -> DataFrame:
    """Executions appended to a fact table in two loads, and what it then holds."""
    facts = scratch_dir(t.spark, "metrics")
    rows = domain.metrics(t)
    for status in ("SUCCESS", "FAILED"):
        append(rows.where(F.col("execution_status") == status), facts)
    held = t.spark.read.parquet(facts).groupBy("execution_status")
    return held.agg(F.count("*").alias("n_rows"), F.count_distinct("agent_id").alias("n_agents"), F.max("execution_id").alias("newest"))


@query(
    "merge_buckets",
    with_views(
        _per_customer_sql("stored", "<"),
        _per_customer_sql("changed", ">="),
        select="""SELECT coalesce(s.custkey, c.custkey) AS custkey,
       CASE WHEN s.custkey IS NULL THEN 'unknown' ELSE s.first_order END AS first_order,
       coalesce(c.last_order, s.last_order) AS last_order, coalesce(c.n_orders, s.n_orders) AS n_orders,
       coalesce(c.total, s.total) AS total, CASE WHEN s.custkey IS NULL THEN 'NEW' ELSE 'STORED' END AS tier
FROM stored s FULL JOIN changed c ON s.custkey = c.custkey""",
    ),
)
def merge_buckets(t: Tables) -> DataFrame:
    """The merge of :func:`merge_upsert` on a table in buckets."""
    before, after = _split(t)
    target = _per_customer(before).withColumn("tier", F.lit("STORED"))
    table = buckets.create(target, scratch_dir(t.spark, "merge-buckets"), ["custkey"], 16)
    defaults = {"first_order": F.lit("unknown"), "tier": F.lit("NEW")}
    table.merge(_per_customer(after).drop("first_order"), ["last_order", "n_orders", "total"], defaults)
    return table.read()
