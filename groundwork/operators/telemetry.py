"""Log parsing, execution traces, execution metrics and the agent catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import LOG_LINE, bound, iso_utc, json_array, strip
from groundwork.operators.upsert import ACTIVE

SERVER = "Server"

# A tag containing one of the texts belongs to the agent; the first match wins.
# Deployments whose tags carry a vendor's name pass their own rules.
AGENT_RULES: Sequence[tuple[Sequence[str], str]] = (
    (("Graph Agent",), "Graph Agent"),
    (("Spatial Agent",), "Spatial Agent"),
    (("Database Agent",), "Database Agent"),
    (("Inventory Action Agent", "Action Agent"), "Inventory Action Agent"),
    (("RAG",), "RAG Agent"),
)

# What a trace shows when its last step has no result, and the buffer sizes.
NO_RESULT = "Analysis resolved."
LOG_BUFFER = 500
RECENT_METRICS = 50


def parse_logs(df: DataFrame, line: str) -> DataFrame:
    """Adds (tag, message) from ``[tag] message`` lines.

    No tag, or an empty one: tag is NULL. Nothing after the tag, or no tag: the message is the
    whole text. What follows a line end is dropped; a tag does not contain one.
    """
    blank = F.lit("")
    tag = strip(F.regexp_extract(line, LOG_LINE, 1))
    return df.withColumns(
        {
            "tag": F.nullif(tag, blank),
            "message": F.coalesce(F.nullif(F.regexp_extract(line, LOG_LINE, 2), blank), F.col(line)),
        }
    )


def agent_of(tag: Column, rules: Sequence[tuple[Sequence[str], str]] = AGENT_RULES) -> Column:
    def chosen(t: Column) -> Column:
        agent = F.lit(SERVER)
        for texts, name in reversed(rules):
            hit = F.lit(False)
            for text in texts:
                hit = hit | t.contains(text)
            agent = F.when(hit, F.lit(name)).otherwise(agent)
        return agent

    return bound(tag, chosen)


def classify(df: DataFrame, rules: Sequence[tuple[Sequence[str], str]] = AGENT_RULES) -> DataFrame:
    """Adds ``agent`` from ``tag``; no tag or an unknown one is the server."""
    return df.withColumn("agent", agent_of(F.col("tag"), rules))


def logs_of(df: DataFrame, agent: str | None = "all") -> DataFrame:
    """Events of one agent; "all" keeps every event."""
    return df if agent in (None, "all") else df.where(F.col("agent") == agent)


def last_events(df: DataFrame, ts: str, key: str, n: int = LOG_BUFFER) -> DataFrame:
    """The newest ``n`` events: what the live buffer holds."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def log_levels(df: DataFrame) -> DataFrame:
    """(agent, type, n_events) counts."""
    return df.groupBy("agent", "type").agg(F.count("*").alias("n_events"))


def step_message(query: Column, result: Column) -> Column:
    """Log text of a trace step."""
    return F.when(F.coalesce(result, F.lit("")) != "", F.concat(query, F.lit(" -> Result: "), result)).otherwise(query)


def trace_final(df: DataFrame, execution: str, step: str, result: str) -> DataFrame:
    """(execution, last_step, answer): the result of each execution's last step."""
    last = F.max_by(F.coalesce(F.col(result), F.lit("")), F.col(step))
    return df.groupBy(execution).agg(F.max(step).alias("last_step"), last.alias("answer")).withColumn(
        "answer", F.when(F.col("answer") == "", F.lit(NO_RESULT)).otherwise(F.col("answer"))
    )


def trace_progress(df: DataFrame, execution: str, step: str, query: str, result: str) -> DataFrame:
    """(execution, n_steps, n_done, log_chars): a step is done once it has a result."""
    done = F.coalesce(F.col(result), F.lit("")) != ""
    return df.groupBy(execution).agg(
        F.count(step).alias("n_steps"),
        F.count_if(done).alias("n_done"),
        F.sum(F.length(step_message(F.col(query), F.col(result)))).cast("bigint").alias("log_chars"),
    )


def latency_ms(start: str, end: str) -> Column:
    """Whole milliseconds between two timestamps, hours and days included."""
    return F.round(F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 1000).cast("bigint")


def metrics_recent(df: DataFrame, agent: str | int | None = None, n: int = RECENT_METRICS) -> DataFrame:
    """The newest ``n`` executions, of one agent if given, under their published names."""
    return _recent(df, agent, n).drop("executed_at")


def _recent(df: DataFrame, agent: str | int | None, n: int) -> DataFrame:
    # Without an agent there is no predicate at all.
    chosen = df if agent is None else df.where(F.col("agent_id") == F.lit(agent))
    return chosen.orderBy(F.desc("executed_at"), F.desc("execution_id")).limit(n).select(
        "executed_at",
        F.col("execution_id").alias("executionId"),
        F.col("agent_id").alias("agentId"),
        F.col("execution_status").alias("executionStatus"),
        F.col("latency_ms").alias("latencyMs"),
        F.col("tool_calls_count").alias("toolCallsCount"),
        F.col("executed_by").alias("executedBy"),
        iso_utc(F.col("executed_at")).alias("executedAt"),
    )


def metrics_json(df: DataFrame, agent: str | int | None = None, n: int = RECENT_METRICS) -> DataFrame:
    """One row (metrics_json): the newest ``n`` executions as a JSON array, "[]" when there are none."""
    recent = _recent(df, agent, n)
    published = [c for c in recent.columns if c != "executed_at"]
    entry = F.to_json(F.struct(*published), {"ignoreNullFields": "false"})
    # n entries, newest first; the published time has lost what is below a second.
    placed = F.struct(F.col("executed_at"), F.col("executionId"), entry.alias("entry"))
    newest = F.sort_array(F.collect_list(placed), asc=False)
    return recent.agg(F.array_join(F.transform(newest, lambda e: e["entry"]), ",").alias("entries")).select(
        F.concat(F.lit("["), "entries", F.lit("]")).alias("metrics_json")
    )


def metrics_by_agent(df: DataFrame) -> DataFrame:
    """(agent_id, invocations, last_execution) per agent."""
    return df.groupBy("agent_id").agg(
        F.count("*").alias("invocations"), F.max("executed_at").alias("last_execution")
    )


def metrics_totals(metrics: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row (total_executions, active_agents); decommissioned agents do not count."""
    executions = metrics.agg(F.count("*").alias("total_executions"), F.lit(0).cast("bigint").alias("active_agents"))
    agents = catalog.where(F.col("status") == ACTIVE).agg(
        F.lit(0).cast("bigint").alias("total_executions"), F.count("*").alias("active_agents")
    )
    return executions.unionByName(agents).agg(
        F.sum("total_executions").alias("total_executions"), F.sum("active_agents").alias("active_agents")
    )


def catalog_active(catalog: DataFrame) -> DataFrame:
    """Active agents with their creation time in ISO form."""
    return catalog.where(F.col("status") == ACTIVE).select(
        "agent_id",
        "agent_name",
        "domain_scope",
        "model_profile",
        "deployment_target",
        "status",
        iso_utc(F.col("created_at")).alias("created_at"),
    )


def catalog_json(catalog: DataFrame) -> DataFrame:
    """(agent_id, agent_json): one JSON object per agent, whatever its status.

    One row per agent instead of one array: the list grows with the catalogue, a row does not.
    """
    entry = F.struct(
        F.col("agent_id").alias("agentId"),
        F.col("agent_name").alias("agentName"),
        F.col("domain_scope").alias("domainScope"),
        F.col("model_profile").alias("modelProfile"),
        F.col("deployment_target").alias("deploymentTarget"),
        F.col("status").alias("status"),
        F.col("system_role").alias("systemRole"),
        F.col("task_instruction").alias("taskInstruction"),
        json_array(F.col("tools_json")).alias("tools"),
        iso_utc(F.col("created_at")).alias("createdAt"),
        iso_utc(F.col("updated_at")).alias("updatedAt"),
    )
    return catalog.select("agent_id", F.to_json(entry, {"ignoreNullFields": "false"}).alias("agent_json"))


def agents_with_tool(catalog: DataFrame, tool: str) -> DataFrame:
    """Catalogue rows whose tool list holds ``tool``."""
    return catalog.where(F.array_contains(json_array(F.col("tools_json")), tool))
