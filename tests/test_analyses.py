import pytest
from pyspark.sql import functions as F

from groundwork.functions import text
from groundwork.operators import audit, ledger, telemetry
from groundwork.operators.charts import monthly_trend


def money(spark, data):
    return spark.createDataFrame(data, "k int, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def test_ledger_breaks(spark, rows):
    debits = money(spark, [(1, 10.0), (2, 5.0), (2, 5.0), (3, 7.0), (5, 1.5)])
    credits = money(spark, [(1, 10.5), (2, 10.0), (4, 3.0), (5, 0.5)])
    assert rows(ledger.ledger_breaks(debits, credits, "k")) == [(3, 7.0, None, 7.0, "debit only"), (4, None, 3.0, -3.0, "credit only")]
    assert [r.k for r in ledger.ledger_breaks(debits, credits, "k", 0.4).collect() if r.side == "both"] == [1, 5]


def test_large_disbursements_of_a_month(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, timestamp_ntz'2024-01-31 23:59:59', 60000), (2, timestamp_ntz'2024-02-01 00:00:00', 60000),
        (3, timestamp_ntz'2024-02-29 12:00:00', 50000), (4, timestamp_ntz'2024-02-29 12:00:00', 50001), (5, timestamp_ntz'2024-03-01 00:00:00', 70000) AS t(id, ts, amount)"""
    )
    assert [r.id for r in ledger.large_disbursements(df, "ts", "amount").orderBy("id").collect()] == [1, 2, 4, 5]
    february = ledger.large_disbursements(df, "ts", "amount", as_of="2024-02-10").orderBy("id").collect()
    assert [(r.id, r.month) for r in february] == [(2, "2024-02"), (4, "2024-02")]


def test_month_filter_reaches_the_scan(tables, plan):
    text = plan(ledger.large_disbursements(tables["orders"], "o_orderdate", "o_totalprice", as_of="1997-03-15"))
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed and "GreaterThan(o_totalprice" in pushed


def test_outliers_skip_constant_groups(spark, rows):
    data = [("a", float(i % 5)) for i in range(100)] + [("a", 100.0)] + [("b", 1.0)] * 5 + [("c", 9.0)]
    df = spark.createDataFrame(data, "g string, v double")
    assert rows(ledger.zscore_outliers(df, "g", "v"), "g", "v") == [("a", 100.0)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.9,), (50.0,), (99.9,), (100.0,), (None,)], "v double")
    found = {r.bucket: r.n_rows for r in ledger.value_histogram(df, "v", 0, 100, 10).collect()}
    assert found == {0: 1, 1: 2, 6: 1, 10: 1, 11: 1}


TRAIL = """SELECT * FROM VALUES
 (1, timestamp_ntz'2024-01-01 05:59:59', 7, 'grant', 1), (2, timestamp_ntz'2024-01-01 06:00:00', 7, 'read', 1),
 (3, timestamp_ntz'2024-01-01 19:59:59', 7, 'grant', 2), (4, timestamp_ntz'2024-01-01 20:00:00', 8, 'grant', 2),
 (5, timestamp_ntz'2024-01-01 12:00:00', 9, 'read', 2) AS t(event_id, ts, actor, action, origin)"""


def test_audit(spark, rows):
    trail = spark.sql(TRAIL)
    allowed = spark.createDataFrame([(8,), (8,)], "id int")
    assert rows(audit.unauthorised_actions(trail, ["grant"], allowed), "event_id") == [(1,), (3,)]
    assert rows(audit.off_hours_activity(trail), "actor", "n_actions", "n_off_hours") == [(7, 3, 1), (8, 1, 1)]
    assert rows(audit.origin_rollup(trail)) == [(1, 2, 1), (2, 3, 3)]
    risk = {r.actor: r for r in audit.risk_levels(trail, ["grant"], allowed).collect()}
    assert risk[7].n_unauthorised == 2 and risk[7].level == "HIGH"
    assert risk[8].n_unauthorised == 0 and risk[8].level == "MEDIUM"
    assert risk[9].score == pytest.approx(0.1) and risk[9].level == "LOW"


def test_compliance_and_correlation(spark, rows):
    df = spark.createDataFrame([("h", "https", 1.0, 2.0), ("h", "http", 2.0, 4.0), ("i", None, 5.0, 1.0)], "host string, scheme string, x double, y double")
    assert rows(audit.compliance_ratio(df, "host", F.col("scheme") == "https")) == [("h", 2, 1, 0.5), ("i", 1, 0, 0.0)]
    corr = {r.sensor: r.correlation for r in audit.telemetry_corr(df, "host", "x", "y").collect()}
    assert corr["h"] == 1.0


LINES = {
    "[Graph Agent] Retrieving": ("Graph Agent", "Graph Agent", "Retrieving"),
    "[My Spatial Agent v2]   x": ("My Spatial Agent v2", "Spatial Agent", "x"),
    "[AI Database Agent] q": ("AI Database Agent", "Database Agent", "q"),
    "[Action Agent]go": ("Action Agent", "Inventory Action Agent", "go"),
    "[ RAG engine ] y": ("RAG engine", "RAG Agent", "y"),
    "[RAG for the Graph Agent] z": ("RAG for the Graph Agent", "Graph Agent", "z"),
    "[other] z": ("other", "Server", "z"),
    "[]": (None, "Server", "[]"),
    "[ ] z": (None, "Server", "z"),
    "[Graph Agent]  ": ("Graph Agent", "Graph Agent", "[Graph Agent]  "),
    "no tag [Graph Agent]": (None, "Server", "no tag [Graph Agent]"),
    "[Graph\nAgent] x": (None, "Server", "[Graph\nAgent] x"),
    "[a] first\nsecond": ("a", "Server", "first"),
    "[a]\nfirst": ("a", "Server", "first"),
    "[a]b] c": ("a", "Server", "b] c"),
    "": (None, "Server", ""),
}


def test_log_lines(spark):
    df = spark.createDataFrame([(line,) for line in LINES] + [(None,)], "line string")
    parsed = {r.line: (r.tag, r.agent, r.message) for r in telemetry.classify(telemetry.parse_logs(df, "line")).collect()}
    assert parsed.pop(None) == (None, "Server", None)
    assert parsed == LINES


def test_log_rules_can_be_replaced(spark):
    df = spark.createDataFrame([("Vendor Query",)], "tag string")
    assert telemetry.classify(df, [(("Vendor",), "Warehouse Agent")]).first().agent == "Warehouse Agent"


def test_log_views(spark, rows):
    df = spark.createDataFrame([(1, "a", "INFO"), (2, "b", "ERROR"), (3, "a", "INFO")], "id int, agent string, type string")
    assert rows(telemetry.logs_of(df, "a"), "id") == [(1,), (3,)]
    assert telemetry.logs_of(df).count() == 3
    assert rows(telemetry.log_levels(df)) == [("a", "INFO", 2), ("b", "ERROR", 1)]
    assert rows(telemetry.last_events(df, "id", "id", 2), "id") == [(2,), (3,)]


def test_traces(spark, rows):
    df = spark.createDataFrame([(1, 0, "q", "r0"), (1, 1, "q2", None), (2, 5, "q", "done"), (2, 1, "q", "")], "e int, s int, q string, r string")
    assert rows(telemetry.trace_final(df, "e", "s", "r")) == [(1, 1, "Analysis resolved."), (2, 5, "done")]
    assert rows(telemetry.trace_progress(df, "e", "s", "q", "r")) == [(1, 2, 1, len("q -> Result: r0") + 2), (2, 2, 1, len("q -> Result: done") + 1)]


def test_latency_counts_hours_and_days(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS a, timestamp_ntz'2024-01-02 01:00:00.0015' AS b")
    assert df.select(telemetry.latency_ms("a", "b")).first()[0] == 25 * 3600 * 1000 + 2


def test_recent_metrics_without_agent_have_no_predicate(tables, plan):
    from groundwork.plans import domain

    text = plan(telemetry.metrics_recent(domain.metrics(tables)))
    assert "Filter" not in text.replace("PartitionFilters", "").replace("PushedFilters", "").replace("DataFilters", "")
    assert "TakeOrderedAndProject" in text


def test_metrics_json_is_newest_first(spark, tables):
    import json

    from groundwork.plans import domain

    metrics = domain.metrics(tables)
    listed = json.loads(telemetry.metrics_json(metrics, n=3).first().metrics_json)
    assert [e["executionId"] for e in listed] == [999, 998, 997]
    assert telemetry.metrics_json(metrics, agent=-1).first().metrics_json == "[]"


def test_text_functions(spark):
    df = spark.createDataFrame([(" New \t Agent X ", "a, b ,, \n c ,")], "name string, items string")
    row = df.select(text.slug(F.col("name")).alias("s"), text.split_list(F.col("items")).alias("l")).first()
    assert row.s == "_new_agent_x_" and row.l == ["a", "b", "c"]


def test_current_time_has_the_given_format(spark):
    import re

    row = spark.range(1).select(text.now_text().alias("a"), text.now_text("yyyy").alias("b")).first()
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}", row.a) and row.b == row.a[:4]


BLOCKS = {
    'x\n```chartjs\n{"a": 1}\n```\ny': ('{"a": 1}', "x\n\ny"),
    'x```chartjs{"a":1}```y```chartjs{"b":2}```': ('{"a":1}', 'xy```chartjs{"b":2}```'),
    "x ```chartjs not json ``` y": (None, "x ```chartjs not json ``` y"),
    "no block": (None, "no block"),
    "```chartjs open": (None, "```chartjs open"),
}


def test_fenced_blocks(spark):
    df = spark.createDataFrame([(k,) for k in BLOCKS], "t string")
    found = {r.t: (r.b, r.w) for r in df.select("t", text.fenced_block(F.col("t")).alias("b"), text.without_block(F.col("t")).alias("w")).collect()}
    assert found == BLOCKS


def test_monthly_trend(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-31 10:00:00', 1), (timestamp_ntz'2024-02-01 00:00:00', 2) AS t(ts, v)")
    assert rows(monthly_trend(df, "ts", F.sum("v"))) == [("2024-01", 1, 1), ("2024-02", 1, 2)]
