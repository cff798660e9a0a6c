"""Ledger, outliers, fuzzy names and the audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators import audit, fuzzy, ledger, quantiles
from groundwork.plans import domain
from groundwork.plans.registry import query, with_views
from groundwork.sources.tables import Tables


@query(
    "ledger_breaks",
    f"""WITH d AS (SELECT o_orderkey AS orderkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS debit FROM orders GROUP BY 1),
c AS (SELECT l_orderkey AS orderkey,
             sum(CAST(l_extendedprice AS {domain.PRICE}) * CAST(1 - l_discount AS {domain.RATE}) * CAST(1 + l_tax AS {domain.RATE})) AS credit
      FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(d.orderkey, c.orderkey) AS orderkey, debit, credit, coalesce(debit, 0) - coalesce(credit, 0) AS gap
      FROM d FULL JOIN c ON d.orderkey = c.orderkey)
SELECT orderkey, CAST(round(debit, 2) AS DOUBLE) AS debit, CAST(round(credit, 2) AS DOUBLE) AS credit,
       CAST(round(gap, 2) AS DOUBLE) AS difference,
       CASE WHEN credit IS NULL THEN 'debit only' WHEN debit IS NULL THEN 'credit only' ELSE 'both' END AS side
FROM j WHERE abs(gap) > 1.0""",
)
def ledger_breaks(t: Tables) -> DataFrame:
    """Orders whose total differs from what their lines add up to."""
    debits = t["orders"].select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").cast(ledger.MONEY).alias("amount")
    )
    net = (
        F.col("l_extendedprice").cast(domain.PRICE)
        * (1 - F.col("l_discount")).cast(domain.RATE)
        * (1 + F.col("l_tax")).cast(domain.RATE)
    )
    credits = t["lineitem"].select(F.col("l_orderkey").alias("orderkey"), net.alias("amount"))
    return ledger.ledger_breaks(debits, credits, "orderkey")


@query(
    "large_disbursements",
    """SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month
FROM orders WHERE o_totalprice > 50000""",
)
def large_disbursements(t: Tables) -> DataFrame:
    large = ledger.large_disbursements(t["orders"], "o_orderdate", "o_totalprice")
    return large.select("o_orderkey", "o_custkey", "o_totalprice", "month")


@query(
    "large_disbursements_month",
    """SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month
FROM orders WHERE o_totalprice > 50000 AND o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'""",
)
def large_disbursements_month(t: Tables) -> DataFrame:
    """One month's orders over 50,000."""
    large = ledger.large_disbursements(t["orders"], "o_orderdate", "o_totalprice", as_of="1996-03-15")
    return large.select("o_orderkey", "o_custkey", "o_totalprice", "month")


@query(
    "zscore_outliers",
    """WITH m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS deviation FROM events GROUP BY 1)
SELECT event_id, event_type, value, round((value - mean) / deviation, 4) AS z_score
FROM events JOIN m USING (event_type) WHERE deviation > 0 AND abs((value - mean) / deviation) > 3""",
)
def zscore_outliers(t: Tables) -> DataFrame:
    rows = t["events"].select("event_id", "event_type", "value")
    return ledger.zscore_outliers(rows, "event_type", "value")


@query(
    "value_histogram",
    """SELECT bucket, count(*) AS n_rows, CASE WHEN bucket >= 1 THEN round(0 + (bucket - 1) * CAST(20 AS DOUBLE), 6) END AS bucket_low
FROM (SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 400 THEN 21 ELSE floor(20 * value / 400) + 1 END AS BIGINT) AS bucket
      FROM events WHERE value IS NOT NULL) GROUP BY bucket""",
)
def value_histogram(t: Tables) -> DataFrame:
    return ledger.value_histogram(t["events"], "value", 0, 400, 20)


@query(
    "fuzzy_pairs",
    """WITH n AS (SELECT p_name AS name, count(*) AS n_rows FROM part WHERE length(p_name) >= 1 GROUP BY 1)
SELECT a.name AS name_a, b.name AS name_b, a.n_rows AS rows_a, b.n_rows AS rows_b,
       round(jaro_winkler_similarity(a.name, b.name), 6) AS score
FROM n a JOIN n b ON a.name < b.name
WHERE jaro_winkler_similarity(a.name, b.name) >= 0.85""",
)
def fuzzy_pairs(t: Tables) -> DataFrame:
    return fuzzy.fuzzy_pairs(t["part"], "p_name", min_score=0.85)


_ACTIONS = ", ".join(f"'{a}'" for a in domain.SENSITIVE)


@query(
    "unauthorised_actions",
    with_views(
        domain.TRAIL,
        domain.ALLOWED,
        select=f"""SELECT actor, event_id, ts, action, origin FROM trail
WHERE action IN ({_ACTIONS}) AND actor NOT IN (SELECT actor FROM allowed)""",
    ),
)
def unauthorised_actions(t: Tables) -> DataFrame:
    return audit.unauthorised_actions(domain.trail(t), domain.SENSITIVE, domain.allowed(t))


@query(
    "off_hours_activity",
    with_views(
        domain.TRAIL,
        select="""SELECT actor, count(*) AS n_actions, count(*) FILTER (WHERE hour(ts) < 6 OR hour(ts) >= 20) AS n_off_hours,
       count(*) FILTER (WHERE hour(ts) < 6 OR hour(ts) >= 20) / CAST(count(*) AS DOUBLE) AS off_hours_ratio
FROM trail GROUP BY actor HAVING count(*) FILTER (WHERE hour(ts) < 6 OR hour(ts) >= 20) > 0""",
    ),
)
def off_hours_activity(t: Tables) -> DataFrame:
    return audit.off_hours_activity(domain.trail(t))


@query(
    "origin_rollup",
    with_views(
        domain.TRAIL,
        select="SELECT origin, count(*) AS n_actions, count(DISTINCT actor) AS n_actors FROM trail GROUP BY origin",
    ),
)
def origin_rollup(t: Tables) -> DataFrame:
    return audit.origin_rollup(domain.trail(t))


@query(
    "compliance_ratio",
    """SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS "group", count(*) AS n_rows,
       count(*) FILTER (WHERE starts_with(url, 'https://')) AS n_compliant,
       count(*) FILTER (WHERE starts_with(url, 'https://')) / CAST(count(*) AS DOUBLE) AS ratio
FROM pages GROUP BY 1""",
)
def compliance_ratio(t: Tables) -> DataFrame:
    """Share of each host's pages fetched over TLS."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return audit.compliance_ratio(t["pages"], host, F.col("url").startswith("https://"))


@query(
    "risk_levels",
    with_views(
        domain.TRAIL,
        domain.ALLOWED,
        f"""seen AS (
  SELECT actor, count(*) AS n_actions, count(*) FILTER (WHERE action IN ({_ACTIONS})) AS n_sensitive,
         count(*) FILTER (WHERE hour(ts) < 6 OR hour(ts) >= 20) AS n_off_hours, count(DISTINCT origin) AS n_origins
  FROM trail GROUP BY actor),
rated AS (
  SELECT s.*, CASE WHEN a.actor IS NULL THEN n_sensitive ELSE 0 END AS n_unauthorised
  FROM seen s LEFT JOIN allowed a ON s.actor = a.actor),
scored AS (
  SELECT *, CAST(60 AS DOUBLE) * n_unauthorised / n_actions + CAST(30 AS DOUBLE) * n_off_hours / n_actions
            + CAST(0.1 AS DOUBLE) * n_origins AS raw FROM rated)""",
        select="""SELECT actor, n_actions, n_unauthorised, n_off_hours, n_origins, raw AS score,
       CASE WHEN raw >= 35 THEN 'HIGH' WHEN raw >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM scored""",
    ),
)
def risk_levels(t: Tables) -> DataFrame:
    return audit.risk_levels(domain.trail(t), domain.SENSITIVE, domain.allowed(t))


@query(
    "telemetry_corr",
    """SELECT event_type AS sensor, count(*) AS n_rows, min(value) AS x_min, max(value) AS x_max,
       min(k) AS y_min, max(k) AS y_max, round(corr(value, k), 4) AS correlation
FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1""",
)
def telemetry_corr(t: Tables) -> DataFrame:
    readings = t["events"].select(
        "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    return audit.telemetry_corr(readings, "event_type", "value", "k")


_SHARES = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(
    "amount_quantiles",
    "\nUNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS share, round(quantile_cont(o_totalprice, {s}), 4) AS amount FROM orders" for s in _SHARES),
)
def amount_quantiles(t: Tables) -> DataFrame:
    """Exact quantiles of all order totals."""
    found = quantiles.percentiles(t["orders"], "o_totalprice", _SHARES)
    rows = [(share, float(amount)) for share, amount in zip(_SHARES, found, strict=True)]
    return t.spark.createDataFrame(rows, "share double, amount double").select("share", F.round("amount", 4).alias("amount"))
