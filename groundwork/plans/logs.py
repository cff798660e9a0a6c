"""Logs, traces, execution metrics, the agent catalogue and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators import telemetry
from groundwork.plans import domain
from groundwork.plans.registry import query, with_views
from groundwork.plans.writes import AS_OF, UPSERTED_SQL
from groundwork.sources import buckets
from groundwork.sources.scratch import is_directory, scratch_dir
from groundwork.sources.tables import Tables
from groundwork.sources.versions import publish, read_latest
from groundwork.streaming import jobs, traces


@query(
    "log_parse",
    with_views(
        "spoken AS (SELECT conv_id, turn, '[' || role || '] ' || text AS line FROM conversations)",
        domain.parse_sql("parsed", "spoken", "conv_id, turn"),
        select="SELECT conv_id, turn, tag, message FROM parsed",
    ),
)
def log_parse(t: Tables) -> DataFrame:
    """Conversation turns as log lines: real texts with line ends and brackets."""
    spoken = t["conversations"].select(
        "conv_id", "turn", F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text")).alias("line")
    )
    return telemetry.parse_logs(spoken, "line").drop("line")


def _parsed(t: Tables) -> DataFrame:
    return telemetry.classify(telemetry.parse_logs(domain.logs(t), "line"))


@query("log_classify", with_views(domain.PARSED, select="SELECT event_id, tag, agent, message FROM parsed"))
def log_classify(t: Tables) -> DataFrame:
    return _parsed(t).select("event_id", "tag", "agent", "message")


@query(
    "logs_by_agent",
    with_views(domain.PARSED, select="SELECT event_id, ts, type, message FROM parsed WHERE agent = 'RAG Agent'"),
)
def logs_by_agent(t: Tables) -> DataFrame:
    return telemetry.logs_of(_parsed(t), "RAG Agent").select("event_id", "ts", "type", "message")


@query(
    "logs_last_500",
    with_views(
        domain.PARSED, select="SELECT event_id, ts, type, agent, message FROM parsed ORDER BY ts DESC, event_id DESC LIMIT 500"
    ),
)
def logs_last_500(t: Tables) -> DataFrame:
    newest = telemetry.last_events(domain.logs(t), "ts", "event_id")
    return telemetry.classify(telemetry.parse_logs(newest, "line")).select("event_id", "ts", "type", "agent", "message")


@query("log_levels", with_views(domain.PARSED, select="SELECT agent, type, count(*) AS n_events FROM parsed GROUP BY 1, 2"))
def log_levels(t: Tables) -> DataFrame:
    return telemetry.log_levels(_parsed(t))


@query(
    "trace_final",
    """SELECT conv_id, max(turn) AS last_step,
       CASE WHEN arg_max(coalesce(text, ''), turn) = '' THEN 'Analysis resolved.' ELSE arg_max(coalesce(text, ''), turn) END AS answer
FROM conversations GROUP BY conv_id""",
)
def trace_final(t: Tables) -> DataFrame:
    return telemetry.trace_final(t["conversations"], "conv_id", "turn", "text")


@query(
    "trace_progress",
    """SELECT conv_id, count(*) AS n_steps, count(*) FILTER (WHERE text <> '' AND role = 'assistant') AS n_done,
       CAST(sum(CASE WHEN text <> '' AND role = 'assistant' THEN length(role || ' -> Result: ' || text) ELSE length(role) END) AS BIGINT) AS log_chars
FROM conversations GROUP BY conv_id""",
)
def trace_progress(t: Tables) -> DataFrame:
    """Turns as trace steps; only the assistant's turns carry a result."""
    steps = t["conversations"].select(
        "conv_id", "turn", "role", F.when(F.col("role") == "assistant", F.col("text")).alias("result")
    )
    return telemetry.trace_progress(steps, "conv_id", "turn", "role", "result")


_RECENT = """SELECT {first}execution_id AS "executionId", agent_id AS "agentId", execution_status AS "executionStatus",
       latency_ms AS "latencyMs", tool_calls_count AS "toolCallsCount", executed_by AS "executedBy",
       strftime(executed_at, '%Y-%m-%dT%H:%M:%SZ') AS "executedAt"
FROM metrics {where} ORDER BY executed_at DESC, execution_id DESC LIMIT 50"""


@query("metrics_recent_all", with_views(domain.METRICS, select=_RECENT.format(first="", where="")))
def metrics_recent_all(t: Tables) -> DataFrame:
    return telemetry.metrics_recent(domain.metrics(t))


@query("metrics_recent_one", with_views(domain.METRICS, select=_RECENT.format(first="", where="WHERE agent_id = 7")))
def metrics_recent_one(t: Tables) -> DataFrame:
    return telemetry.metrics_recent(domain.metrics(t), agent=7)


@query(
    "metrics_json",
    with_views(
        domain.METRICS,
        "recent AS (" + _RECENT.format(first="executed_at, ", where="") + ")",
        select="""SELECT '[' || string_agg(CAST(json_object('executionId', "executionId", 'agentId', "agentId",
       'executionStatus', "executionStatus", 'latencyMs', "latencyMs", 'toolCallsCount', "toolCallsCount",
       'executedBy', "executedBy", 'executedAt', "executedAt") AS VARCHAR), ','
       ORDER BY executed_at DESC, "executionId" DESC) || ']' AS metrics_json FROM recent""",
    ),
)
def metrics_json(t: Tables) -> DataFrame:
    return telemetry.metrics_json(domain.metrics(t))


@query(
    "metrics_by_agent",
    with_views(
        domain.METRICS,
        select="SELECT agent_id, count(*) AS invocations, max(executed_at) AS last_execution FROM metrics GROUP BY 1",
    ),
)
def metrics_by_agent(t: Tables) -> DataFrame:
    return telemetry.metrics_by_agent(domain.metrics(t))


@query(
    "metrics_totals",
    with_views(
        domain.METRICS,
        domain.CATALOG,
        select="""SELECT (SELECT count(*) FROM metrics) AS total_executions,
       (SELECT count(*) FROM catalog WHERE status = 'ACTIVE') AS active_agents""",
    ),
)
def metrics_totals(t: Tables) -> DataFrame:
    return telemetry.metrics_totals(domain.metrics(t), domain.catalog(t))


@query(
    "latency_ms",
    """SELECT user_id, CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS latency_ms
FROM events GROUP BY 1""",
)
def latency_ms(t: Tables) -> DataFrame:
    """First to last event of each user: days, where adding minutes and seconds would fail."""
    spans = t["events"].groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return spans.select("user_id", telemetry.latency_ms("started", "ended").alias("latency_ms"))


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "catalog_active",
    with_views(
        domain.CATALOG,
        select=f"""SELECT agent_id, agent_name, domain_scope, model_profile, deployment_target, status,
       {_ISO.format("created_at")} AS created_at FROM catalog WHERE status = 'ACTIVE'""",
    ),
)
def catalog_active(t: Tables) -> DataFrame:
    return telemetry.catalog_active(domain.catalog(t))


@query(
    "catalog_json",
    with_views(
        domain.CATALOG,
        select=f"""SELECT agent_id, CAST(json_object('agentId', agent_id, 'agentName', agent_name, 'domainScope', domain_scope,
       'modelProfile', model_profile, 'deploymentTarget', deployment_target, 'status', status, 'systemRole', system_role,
       'taskInstruction', task_instruction, 'tools', CAST(tools_json AS JSON), 'createdAt', {_ISO.format("created_at")},
       'updatedAt', {_ISO.format("updated_at")}) AS VARCHAR) AS agent_json FROM catalog""",
    ),
)
def catalog_json(t: Tables) -> DataFrame:
    return telemetry.catalog_json(domain.catalog(t))


@query(
    "agents_with_tool",
    with_views(
        domain.CATALOG,
        select="""SELECT agent_id, agent_name, tools_json FROM catalog
WHERE list_contains(CAST(CAST(tools_json AS JSON) AS VARCHAR[]), 'supply_graph')""",
    ),
)
def agents_with_tool(t: Tables) -> DataFrame:
    return telemetry.agents_with_tool(domain.catalog(t), "supply_graph").select("agent_id", "agent_name", "tools_json")


def _feed(t: Tables, name: str, schema: str) -> DataFrame:
    """The files of a table as a stream, whether it is one file or a directory of them."""
    path = t.path(name)
    if is_directory(t.spark, path):
        return jobs.read_feed(t.spark, path, schema)
    return jobs.read_feed(t.spark, t.directory, schema, f"{name}.parquet")


EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query(
    "stream_logs",
    with_views(domain.PARSED, select="SELECT event_id, ts, tag, agent, message FROM parsed"),
)
def stream_logs(t: Tables) -> DataFrame:
    """The event files as a stream of log lines, parsed into Parquet and read back."""
    work = scratch_dir(t.spark, "stream-logs")
    feed = _feed(t, "events", EVENT_SCHEMA)
    lines = feed.select("event_id", "ts", domain.log_line().alias("line"))
    jobs.stream_logs(lines, "line", f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{work}/out").select("event_id", "ts", "tag", "agent", "message")


@query("stream_text_logs", with_views(domain.PARSED, select="SELECT tag, agent, message FROM parsed"))
def stream_text_logs(t: Tables) -> DataFrame:
    """Raw text files of log lines, followed as a stream."""
    work = scratch_dir(t.spark, "stream-text")
    domain.logs(t).select("line").write.text(f"{work}/in")
    jobs.stream_logs(jobs.read_lines(t.spark, f"{work}/in"), "line", f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{work}/out").select("tag", "agent", "message")


CONVERSATION_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@query(
    "stream_traces",
    """SELECT CAST(conv_id AS VARCHAR) AS execution_id,
       CASE WHEN bool_or(role = 'system' AND length(text) > 400) THEN 'error'
            WHEN arg_max(role = 'assistant' AND text <> '', turn) THEN 'completed' ELSE 'processing' END AS state,
       count(*) AS n_steps, count(*) FILTER (WHERE role = 'assistant' AND text <> '') AS n_done, max(turn) AS last_step,
       CASE WHEN arg_max(role = 'assistant' AND text <> '', turn) THEN arg_max(text, turn) END AS answer
FROM conversations GROUP BY conv_id""",
)
def stream_traces(t: Tables) -> DataFrame:
    """Conversations as executions followed live: assistant turns are results, long system turns failures."""
    work = scratch_dir(t.spark, "stream-traces")
    feed = _feed(t, "conversations", CONVERSATION_SCHEMA)
    steps = feed.select(
        F.col("conv_id").alias("execution_id"),
        F.col("turn").alias("step"),
        F.timestamp_seconds(F.col("turn")).alias("at"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("result"),
        ((F.col("role") == "system") & (F.length("text") > 400)).alias("failed"),
    )
    traces.stream_traces(steps, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return traces.read_traces(t.spark, f"{work}/out")


@query(
    "stream_agent_counts",
    """SELECT date_trunc('day', ts) AS window_start, user_id AS agent_id, count(*) AS invocations, max(ts) AS last_execution
FROM events GROUP BY 1, 2""",
)
def stream_agent_counts(t: Tables) -> DataFrame:
    work = scratch_dir(t.spark, "stream-counts")
    feed = _feed(t, "events", EVENT_SCHEMA)
    jobs.stream_agent_counts(feed, "ts", "user_id", f"{work}/out", f"{work}/checkpoint").awaitTermination()
    counts = jobs.read_agent_counts(t.spark, f"{work}/out")
    return counts.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "last_execution")}
    )


CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _provisioned(t: Tables, root: str, checkpoint: str) -> None:
    """The customer files as a stream of agents to provision, merged into the catalogue at ``root``."""
    people = _feed(t, "customer", CUSTOMER_SCHEMA)
    provisioned = domain.agents(people, t["nation"], "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    jobs.stream_upsert(
        provisioned.drop("status", "created_at").withColumnRenamed("updated_at", "sent_at"),
        root,
        checkpoint,
        ["sent_at"],
        lambda: F.lit(AS_OF).cast("timestamp_ntz"),
    ).awaitTermination()


@query("stream_upsert", UPSERTED_SQL)
def stream_upsert(t: Tables) -> DataFrame:
    """Agents provisioned by a stream, in a catalogue that is written whole."""
    work = scratch_dir(t.spark, "stream-upsert")
    publish(domain.catalog(t), f"{work}/table", 0)
    _provisioned(t, f"{work}/table", f"{work}/checkpoint")
    return read_latest(t.spark, f"{work}/table").drop("sent_at")


@query("stream_upsert_buckets", UPSERTED_SQL)
def stream_upsert_buckets(t: Tables) -> DataFrame:
    """Agents provisioned by a stream, in a catalogue of which only the touched buckets are written."""
    work = scratch_dir(t.spark, "stream-buckets")
    table = buckets.create(domain.catalog(t), f"{work}/table", ["agent_id"], 16)
    _provisioned(t, table.root, f"{work}/checkpoint")
    return table.read().drop("sent_at")
