"""Log, metric, correlation and table operators bound to the driver's tables.

``events`` stands in for logs and metrics: level by event type (``error`` = ERROR), component or
source = user, service = user number modulo 3, metric = event type, measure = value. ``orders``,
``customer`` and ``nation`` stand in for the sales tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.functions.time import HOUR, MINUTE, from_micros, micros
from scorewright.operators import correlate, logs, metrics, quality
from scorewright.plans import sql
from scorewright.plans.registry import Tables, query
from scorewright.scale import scratch_path
from scorewright.sources import files
from scorewright.streaming import alerts as streaming

# Configured limits: service, measure, key, limit. Several keys a service, several limits a measure.
LIMITS = [
    (0, "error", "pool_size", 40.0), (0, "error", "pool_size_max", 120.0), (0, "purchase", "timeout_ms", 60.0),
    (0, "view", "workers", 50.0), (1, "error", "pool_size", 30.0), (1, "click", "queue_length", 25.0),
    (1, "click", "queue_length_max", 90.0), (1, "signup", "workers", 45.0), (2, "error", "timeout_ms", 55.0),
    (2, "error", "pool_size", 20.0),
]
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
ALERT_SHARE, ALERT_EVENTS = 0.6, 3


def _level() -> Column:
    return (
        F.when(F.col("event_type") == "error", F.lit("ERROR"))
        .when(F.col("event_type") == "purchase", F.lit("WARN"))
        .otherwise(F.lit("INFO"))
    )


def _log_lines(t: Tables) -> DataFrame:
    """Events as log lines: clicks without a time, signups as continuation lines."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    message = F.concat("event_type", F.lit(" k="), F.get_json_object("props", "$.k"))
    message = F.when(F.col("event_type") == "signup", F.concat(F.lit("  at "), message)).otherwise(message)
    component = F.concat(F.lit("[user-"), F.col("user_id").cast("string"), F.lit("] "))
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("no time "), message)).otherwise(
        F.concat(stamp, F.lit(" "), _level(), F.lit("  "), component, message)
    )
    return t.events.select("event_id", line.alias("value"))


@query(
    "log_parse",
    """
    SELECT event_id, event_type <> 'click' AS parsed,
      CASE WHEN event_type <> 'click' THEN date_trunc('second', ts) END AS ts,
      CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level,
      CASE WHEN event_type <> 'click' THEN 'user-' || user_id END AS component,
      CASE WHEN event_type = 'signup' THEN 'at ' WHEN event_type <> 'click' THEN '' END || event_type || ' k=' || (props->>'$.k') AS message,
      CASE WHEN event_type <> 'click' THEN event_type = 'signup' END AS is_continuation
    FROM events
    """,
)
def log_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines built from events and parsed back; lines without a time are kept as unparsed."""
    return logs.parse_lines(_log_lines(Tables(spark, folder))).drop("value")


def _levelled(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "purchase", F.lit("WARNING")).otherwise(_level())
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value", level.alias("level"),
        F.concat("event_type", F.lit(" k="), F.get_json_object("props", "$.k")).alias("message"),
        F.lit(False).alias("is_continuation"),
    )


_SQL_ERRORS = """
(SELECT user_id, ts, event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","message":"error k=' || (props->>'$.k') || '"}' AS object
 FROM events WHERE event_type = 'error')
"""


@query(
    "errors_json",
    f"""
    SELECT user_id, part, count(*) AS n_errors, '[' || string_agg(object, ',' ORDER BY ts, event_id) || ']' AS errors
    FROM {sql.packed(_SQL_ERRORS, 'user_id', 'ts, event_id', "(object || ',')", 500)} GROUP BY ALL
    """,
)
def errors_json(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of each user as JSON arrays in time order, here of up to 500 bytes."""
    return logs.errors_as_json(_levelled(Tables(spark, folder)), "user_id", ["ts", "event_id"], max_bytes=500)


@query(
    "level_rollup",
    """
    SELECT user_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level,
      count(*) AS n_events FROM events GROUP BY ALL
    """,
)
def level_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Events per user and level."""
    return logs.level_counts(_levelled(Tables(spark, folder)), "user_id")


@query(
    "top_events",
    """
    WITH shaped AS (
      SELECT user_id, event_id, ts, event_type, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level,
        CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS sev,
        count(*) OVER (PARTITION BY user_id, event_type) AS frequency FROM events)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sev DESC, frequency DESC, ts, event_id) AS rank,
      event_id, level, frequency
    FROM shaped QUALIFY rank <= 5
    """,
)
def top_events(spark: SparkSession, folder: str) -> DataFrame:
    """The five most important events of each user."""
    top = logs.top_events(_levelled(Tables(spark, folder)), "user_id", ["ts", "event_id"], k=5)
    return top.select("user_id", "rank", "event_id", "level", "frequency")


@query(
    "evidence_lookback",
    """
    WITH anchors AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error')
    SELECT a.user_id, a.ts AS anchor_ts, count(e.event_id) AS n_events,
      count(*) FILTER (e.event_type = 'click') AS n_click, count(*) FILTER (e.event_type = 'error') AS n_error,
      count(*) FILTER (e.event_type = 'purchase') AS n_purchase, count(*) FILTER (e.event_type = 'signup') AS n_signup,
      count(*) FILTER (e.event_type = 'view') AS n_view, min(e.ts) AS first_ts, max(e.ts) AS last_ts
    FROM anchors a LEFT JOIN events e ON e.user_id = a.user_id AND e.ts < a.ts AND e.ts >= a.ts - INTERVAL 6 HOUR
    GROUP BY a.user_id, a.ts
    """,
)
def evidence_lookback(spark: SparkSession, folder: str) -> DataFrame:
    """What a user's log holds in the six hours before each error."""
    events = Tables(spark, folder).events.select("user_id", "event_type", micros(F.col("ts")).alias("at"))
    found = logs.evidence_before(
        events, "user_id", "at", "event_type", EVENT_TYPES, F.col("event_type") == "error", lookback=6 * HOUR
    )
    times = {"anchor_ts": "anchor_at", "first_ts": "first_at", "last_ts": "last_at"}
    return found.withColumns({new: from_micros(F.col(old)) for new, old in times.items()}).drop(*times.values())


@query(
    "evidence_list",
    """
    WITH listed AS (
      SELECT *, list({'at': ts, 'id': event_id, 'type': event_type}) OVER (
        PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before FROM events),
    recent AS (
      SELECT user_id, ts, event_id, coalesce(list_filter(before, lambda e: e.at >= ts - INTERVAL 6 HOUR), []) AS found FROM listed WHERE event_type = 'error')
    SELECT user_id, ts AS anchor_ts, event_id, CAST(len(found) AS INTEGER) AS n_listed,
      coalesce(array_to_string(list_transform(found, lambda e: e.id || ' ' || e.type), ', '), '') AS evidence
    FROM recent
    """,
)
def evidence_list(spark: SparkSession, folder: str) -> DataFrame:
    """The last five events of a user before each error, of the six hours before it."""
    events = _timed(Tables(spark, folder))
    found = logs.evidence_list(
        events, "user_id", "at", "event_id", ["event_type"], F.col("event_type") == "error", n=5, lookback=6 * HOUR
    )
    named = F.transform("evidence", lambda e: F.concat(e["event_id"].cast("string"), F.lit(" "), e["event_type"]))
    return found.select(
        "user_id", from_micros(F.col("at")).alias("anchor_ts"), "event_id", "n_listed", F.array_join(named, ", ").alias("evidence")
    )


@query(
    "metric_outliers",
    """
    WITH med AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1),
    dev AS (SELECT e.*, m, abs(value - m) AS d FROM events e JOIN med USING (event_type)),
    mad AS (SELECT event_type, median(d) AS mad FROM dev GROUP BY 1)
    SELECT event_id, event_type AS metric, value, round(m, 4) AS median, round(0.6745 * d / mad, 6) AS z
    FROM dev JOIN mad USING (event_type) WHERE mad > 0 AND 0.6745 * d / mad > 3.5
    """,
)
def metric_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Values far from the median of their event type."""
    samples = Tables(spark, folder).events.select("event_id", F.col("event_type").alias("metric"), "value")
    flagged = metrics.outliers(samples, "metric", "value", spread=["event_id"])
    return flagged.select(
        "event_id", "metric", "value", F.round("median", 4).alias("median"), F.round("z", 6).alias("z")
    )


def _orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").alias("created_at"),
    )


def _customers(t: Tables) -> DataFrame:
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("country"))


@query(
    "revenue_by_country",
    """
    SELECT n_name AS country, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name
    """,
)
def revenue_by_country(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per country in 1997, highest first."""
    t = Tables(spark, folder)
    totals = quality.totals_by_country(_orders(t), _customers(t), start="1997-01-01", end="1998-01-01")
    return totals.withColumn("total", F.col("total").cast("double"))


def _orders_from_csv(t: Tables) -> DataFrame:
    """Orders after a round trip through CSV; urgent ones lose their customer, and every seventh amount is no number."""
    path = scratch_path(t.orders.sparkSession, "orders-csv")
    lost = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey"))
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    t.orders.select(
        "o_orderkey", lost.alias("customer_id"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("12,x")).otherwise(amount).alias("amount")
    ).write.csv(path, header=True)
    return files.read_csv(
        t.orders.sparkSession, path, "o_orderkey BIGINT, customer_id BIGINT, amount DECIMAL(18,2)"
    )


def _sales_from_csv(t: Tables) -> tuple[DataFrame, DataFrame]:
    stages = quality.sales_stages(_customers(t), rejected=F.col(files.CORRUPT).isNotNull())
    return quality.run_stages(_orders_from_csv(t), stages)


@query(
    "sales_by_country",
    """
    SELECT n_name AS country, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n_orders
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 7 <> 0 GROUP BY n_name
    """,
)
def sales_by_country(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read from CSV, cleaned, enriched with the country, summed, in measured stages."""
    published, _ = _sales_from_csv(Tables(spark, folder))
    return published.withColumn("amount", F.col("amount").cast("double"))


@query(
    "sales_stage_counts",
    """
    WITH read AS (
      SELECT o_orderkey % 7 = 0 AS bad, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS k,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS a FROM orders),
    kept AS (SELECT * FROM read WHERE k IS NOT NULL AND NOT bad),
    named AS (SELECT n_name AS country, a FROM kept LEFT JOIN customer ON k = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
    report AS (SELECT country, sum(a) AS a FROM named GROUP BY country)
    SELECT 'extract' AS stage, 0::BIGINT AS ord, 'OK' AS status, count(*) AS rows_out, count(*) - count(k) AS null_rows,
      count(*) FILTER (bad) AS rejected_rows, NULL::BIGINT AS groups_out, CAST(sum(a) AS DOUBLE) AS amount_out FROM read
    UNION ALL SELECT 'clean', 1, 'OK', count(*), 0, NULL, NULL, CAST(sum(a) AS DOUBLE) FROM kept
    UNION ALL SELECT 'enrich', 2, 'OK', count(*), count(*) - count(country), NULL, count(DISTINCT country), CAST(sum(a) AS DOUBLE) FROM named
    UNION ALL SELECT s, o, 'OK', count(*), count(*) - count(country), NULL, count(country), CAST(sum(a) AS DOUBLE)
      FROM report, (VALUES ('aggregate', 3), ('publish', 4)) v(s, o) GROUP BY s, o
    """,
)
def sales_stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What each stage of that job counted while it wrote, unreadable lines included."""
    _, report = _sales_from_csv(Tables(spark, folder))
    return report.withColumn("amount_out", F.col("amount_out").cast("double")).drop("error")


_SQL_ALL_IN_ONE = "SELECT 'all countries' AS country, sum(a) AS a FROM bad HAVING count(*) > 0"


def _sql_stages(bad_country: str, bad_report: str) -> str:
    """Stages of a good run and of one with another country or another grouping."""
    amount = "CAST(sum(a) AS DOUBLE)"
    return f"""
orders_in AS (SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders),
kept AS (SELECT k, a FROM orders_in WHERE k IS NOT NULL),
good AS (SELECT n_name AS country, a FROM kept LEFT JOIN customer ON k = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
bad AS (SELECT {bad_country} AS country, a FROM good),
good_report AS (SELECT country, sum(a) AS a FROM good GROUP BY country),
bad_report AS ({bad_report}),
sizes(ord, prior_groups) AS (
  SELECT 2, (SELECT count(DISTINCT country) FROM good) UNION ALL SELECT o, (SELECT count(country) FROM good_report) FROM (VALUES (3), (4)) v(o)),
counted AS (
  SELECT 'extract' AS stage, 0 AS ord, count(*) AS rows_out, count(*) - count(k) AS null_rows, NULL AS groups_out, {amount} AS amount_out FROM orders_in
  UNION ALL SELECT 'clean', 1, count(*), 0, NULL, {amount} FROM kept
  UNION ALL SELECT 'enrich', 2, count(*), count(*) - count(country), count(DISTINCT country), {amount} FROM bad
  UNION ALL SELECT s, o, count(*), count(*) - count(country), count(country), {amount} FROM bad_report, (VALUES ('aggregate', 3), ('publish', 4)) v(s, o) GROUP BY ALL),
stages AS (SELECT * FROM counted LEFT JOIN sizes USING (ord)),
judged AS (
  SELECT *, lag(rows_out) OVER (ORDER BY ord) AS rows_in, round(null_rows / rows_out, 4) AS null_share,
    coalesce(null_rows / rows_out > 0.5, FALSE) OR coalesce(groups_out < prior_groups * 0.5, FALSE) AS failed FROM stages)
SELECT stage, CAST(ord AS BIGINT) AS ord, 'OK' AS status, rows_in, CAST(rows_out AS BIGINT) AS rows_out, CAST(null_rows AS BIGINT) AS null_rows,
  groups_out, amount_out, prior_groups, null_share, CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END AS verdict,
  failed AND NOT coalesce(bool_or(failed) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS is_fault
FROM judged
"""


def _gated(spark: SparkSession, folder: str, **faults) -> DataFrame:
    """A faulty run of the sales job against a good one of the same orders, which are read once for both."""
    t = Tables(spark, folder)
    orders = t.orders.select(
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("customer_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )
    customers = _customers(t)
    stages, faulty = quality.sales_stages(customers), quality.sales_stages(customers, **faults)
    cleaned, begun = quality.run_stages(orders, stages[:2])
    good = quality.run_stages(cleaned, stages[2:], first=2)[1]
    bad = quality.run_stages(cleaned, faulty[2:], first=2)[1]
    judged = quality.gate(begun.unionAll(bad), begun.unionAll(good), max_null_share=0.5)
    return judged.withColumn("amount_out", F.col("amount_out").cast("double")).drop("prior_amount", "rejected_rows", "error")


@query(
    "stage_quality_gate",
    f"WITH {_sql_stages('CAST(NULL AS VARCHAR)', 'SELECT country, sum(a) AS a FROM bad GROUP BY country')}",
)
def stage_quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The sales job with a broken customer key against a good run; the fault is ``enrich``."""
    shifted = _customers(Tables(spark, folder)).withColumn("customer_id", -F.col("customer_id") - 1)
    return _gated(spark, folder, enrich=lambda cleaned: quality.customer_countries(cleaned, shifted))


@query("stage_fault_in_aggregate", f"WITH {_sql_stages('country', _SQL_ALL_IN_ONE)}")
def stage_fault_in_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Every country summed under one name, without any NULL and with the right total; the fault is ``aggregate``."""
    one = F.lit("all countries")
    return _gated(spark, folder, aggregate=lambda enriched: quality.country_report(enriched.withColumn("country", one)))


@query(
    "cascade_coverage",
    """
    WITH e AS (SELECT user_id % 3 AS service, ts, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY ALL)
    SELECT a.service, a.ts AS origin_ts, a.n_errors, count(DISTINCT b.service) AS n_downstream
    FROM e a LEFT JOIN e b ON b.service <> a.service AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE
    GROUP BY ALL
    """,
)
def cascade_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Number of other services that fail within 30 minutes after each error."""
    covered = correlate.downstream_coverage(_service_errors(Tables(spark, folder)), "service", "at", within=30 * MINUTE)
    return covered.withColumn("origin_ts", from_micros(F.col("origin_at"))).drop("origin_at")


def _service_errors(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == "error").select(
        (F.col("user_id") % 3).alias("service"), micros(F.col("ts")).alias("at")
    )


@query(
    "cascade_chain",
    """
    WITH e AS (SELECT user_id % 3 AS service, ts FROM events WHERE event_type = 'error'),
    cover AS (
      SELECT a.service, a.ts, count(DISTINCT b.service) AS n FROM e a
      LEFT JOIN e b ON b.service <> a.service AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE GROUP BY ALL),
    root AS (SELECT * FROM cover ORDER BY n DESC, ts, service LIMIT 1),
    chain AS (
      SELECT r.service, r.ts AS first_error_ts, (SELECT count(*) FROM e WHERE e.service = r.service AND e.ts = r.ts) AS n_errors FROM root r
      UNION ALL
      SELECT e.service, min(e.ts), count(*) FROM e, root r
      WHERE e.service <> r.service AND e.ts > r.ts AND e.ts <= r.ts + INTERVAL 30 MINUTE GROUP BY e.service)
    SELECT *, row_number() OVER (ORDER BY first_error_ts, service) - 1 AS step FROM chain
    """,
)
def cascade_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The likely root error and the services that fail after it, in order."""
    errors = _service_errors(Tables(spark, folder))
    covered = correlate.downstream_coverage(errors, "service", "at", within=30 * MINUTE)
    chain = correlate.cascade_chain(errors, covered, "service", "at", within=30 * MINUTE)
    return chain.withColumn("first_error_ts", from_micros(F.col("first_error_at"))).drop("first_error_at")


def _timed(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type", "value", "user_id", micros(F.col("ts")).alias("at"))


def _tumbling_alerts(t: Tables) -> DataFrame:
    windows = metrics.error_windows(_timed(t), "at", F.col("event_type") == "error", width=5 * MINUTE)
    return metrics.alerts(windows, share=ALERT_SHARE, min_events=ALERT_EVENTS)


def _stamped(windows: DataFrame, *names: str) -> DataFrame:
    return windows.withColumns({name: from_micros(F.col(name)) for name in names})


_SQL_TUMBLING = """
tumbling AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors
  FROM events GROUP BY 1),
alerts AS (
  SELECT *, round(n_errors / n_events, 4) AS error_share FROM tumbling WHERE n_events >= 3 AND n_errors / n_events >= 0.6)
"""


@query("error_rate_tumbling", f"WITH {_SQL_TUMBLING} SELECT * FROM alerts")
def error_rate_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Five-minute windows with a high share of errors."""
    return _stamped(_tumbling_alerts(Tables(spark, folder)), "window_start")


@query(
    "error_rate_sliding",
    """
    WITH sliding AS (
      SELECT time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE AS window_start, count(*) AS n_events,
        count(*) FILTER (event_type = 'error') AS n_errors
      FROM events, range(5) r(i) GROUP BY 1)
    SELECT *, round(n_errors / n_events, 4) AS error_share FROM sliding WHERE n_events >= 3 AND n_errors / n_events >= 0.6
    """,
)
def error_rate_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """The same for windows that start every minute."""
    windows = metrics.error_windows(
        _timed(Tables(spark, folder)), "at", F.col("event_type") == "error", width=5 * MINUTE, slide=MINUTE
    )
    return _stamped(metrics.alerts(windows, share=ALERT_SHARE, min_events=ALERT_EVENTS), "window_start")


@query(
    "alert_runs",
    f"""
    WITH {_SQL_TUMBLING},
    flagged AS (SELECT *, CASE WHEN window_start - lag(window_start) OVER (ORDER BY window_start) = INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS s FROM alerts),
    numbered AS (SELECT *, sum(s) OVER (ORDER BY window_start) AS run FROM flagged)
    SELECT min(window_start) AS first_detected, max(window_start) AS last_window, count(*) AS n_windows, max(error_share) AS peak_share
    FROM numbered GROUP BY run
    """,
)
def alert_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive alert windows as one run with the time of first detection."""
    runs = metrics.alert_runs(_tumbling_alerts(Tables(spark, folder)), step=5 * MINUTE)
    return _stamped(runs, "first_detected", "last_window")


@query(
    "config_breach",
    f"""
    WITH w AS (
      SELECT user_id % 3 AS service, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad
      FROM events GROUP BY ALL),
    alerts AS (SELECT service, window_start, round(bad / n, 4) AS error_share FROM w WHERE n >= 2 AND bad / n >= 0.5),
    limits(service, measure, config_key, config_limit) AS (VALUES {", ".join(f"({s}, '{m}', '{k}', {v}::DOUBLE)" for s, m, k, v in LIMITS)}),
    found AS (
      SELECT a.window_start, a.service, l.measure, config_key, config_limit, error_share, count(*) AS n_breaches,
        max(value) AS max_value, min(ts) AS first_breach
      FROM alerts a JOIN events e ON time_bucket(INTERVAL 15 MINUTE, e.ts) = a.window_start AND e.user_id % 3 = a.service
      JOIN limits l ON l.service = a.service AND l.measure = e.event_type AND value >= config_limit GROUP BY ALL)
    SELECT *, row_number() OVER (
      PARTITION BY window_start, service ORDER BY max_value / config_limit DESC, n_breaches DESC, config_key, config_limit, measure) = 1 AS contributed_most
    FROM found
    """,
)
def config_breach(spark: SparkSession, folder: str) -> DataFrame:
    """Configured limits that a service reached inside its own alert windows, and which key contributed most."""
    events = _timed(Tables(spark, folder)).withColumn("service", F.col("user_id") % 3)
    windows = metrics.error_windows(events, "at", F.col("event_type") == "error", width=15 * MINUTE, by=["service"])
    alerted = metrics.alerts(windows, share=0.5, min_events=2)
    limits = spark.createDataFrame(LIMITS, "service BIGINT, measure STRING, config_key STRING, config_limit DOUBLE")
    found = metrics.limit_breaches(
        events.withColumnRenamed("event_type", "measure"), alerted, limits, "at", "value", width=15 * MINUTE, spread=["event_id"]
    )
    return _stamped(found, "window_start", "first_breach")


def _signed(t: Tables) -> tuple[DataFrame, DataFrame, Column]:
    """Reports: errors. Logs: everything else. Alike when value (to the unit) and props agree.

    Both are spelled in letters, since a signature masks digits; the event number is masked.
    """
    events = t.events.select("event_id", "event_type", "value", "props")
    is_error = F.col("event_type") == "error"
    tail = F.concat(
        F.lit("unit "), F.translate(F.floor("value").cast("string"), "0123456789", "abcdefghij"),
        F.lit(" of "), F.translate("props", "0123456789", "abcdefghij"), F.lit(" at 0x"), F.hex("event_id"),
    )
    return events.where(is_error), events.where(~is_error), T.signature(tail)


_SQL_SIGNED = """
signed AS (SELECT event_id, event_type, floor(value) AS unit, props FROM events),
known AS (SELECT DISTINCT unit, props FROM signed WHERE event_type <> 'error')
"""


@query(
    "signature_match",
    f"WITH {_SQL_SIGNED} SELECT event_id FROM signed s WHERE event_type = 'error'"
    " AND EXISTS (SELECT 1 FROM known k WHERE k.unit = s.unit AND k.props = s.props)",
)
def signature_match(spark: SparkSession, folder: str) -> DataFrame:
    """Errors whose signature also occurs outside errors."""
    reports, rest, signature = _signed(Tables(spark, folder))
    return logs.match_signatures(reports, rest, signature, signature, spread=["event_id"]).select("event_id")


@query(
    "signature_unmatched",
    f"WITH {_SQL_SIGNED} SELECT event_id FROM signed s WHERE event_type = 'error'"
    " AND NOT EXISTS (SELECT 1 FROM known k WHERE k.unit = s.unit AND k.props = s.props)",
)
def signature_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Errors whose signature occurs nowhere else."""
    reports, rest, signature = _signed(Tables(spark, folder))
    return logs.match_signatures(reports, rest, signature, signature, spread=["event_id"], matched=False).select("event_id")


@query(
    "failure_breakdown",
    """
    WITH e AS (SELECT hour(ts) AS hour, user_id AS worker, event_type = 'error' AS f FROM events)
    SELECT CAST(hour AS INTEGER) AS hour, worker, CAST(grouping(hour) * 2 + grouping(worker) AS BIGINT) AS grouping_level,
      count(*) AS n_events, count(*) FILTER (f) AS n_failed, round(count(*) FILTER (f) / count(*), 4) AS failed_share,
      round((count(*) FILTER (f) / count(*)) / (SELECT count(*) FILTER (f) / count(*) FROM e), 4) AS lift
    FROM e GROUP BY GROUPING SETS ((hour, worker), (hour), ())
    """,
)
def failure_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Error share by hour and worker, by hour, and overall."""
    events = Tables(spark, folder).events.select(
        F.hour("ts").alias("hour"), F.col("user_id").alias("worker"), "event_type"
    )
    return logs.failure_breakdown(events, F.col("event_type") == "error", ("hour", "worker"))


@query(
    "latency_stats",
    """
    WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, count(*) AS n_gaps, round(CAST(sum(gap) AS DOUBLE) / count(*) / 1000000, 2) AS mean_s,
      round(quantile_cont(gap, 0.5) / 1000000, 2) AS median_s, round(quantile_cont(gap, 0.95) / 1000000, 2) AS p95_s
    FROM g WHERE gap IS NOT NULL GROUP BY user_id
    """,
)
def latency_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Time between the events of each user."""
    gap_rows = metrics.gaps(_timed(Tables(spark, folder)), "user_id", "at", ["event_id"])
    return metrics.latency_stats(gap_rows, "user_id")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return streaming.read_event_stream(spark, folder, schema, glob="events.parquet")


@query("stream_error_rate", f"WITH {_SQL_TUMBLING} SELECT * FROM alerts")
def stream_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The tumbling alerts from a stream, complete output: equal to the batch ones."""
    windows = streaming.windowed_errors(
        _event_stream(spark, folder), F.col("event_type") == "error", width="5 minutes", delay="10 minutes"
    )
    stream = streaming.alerting(windows, share=ALERT_SHARE, min_events=ALERT_EVENTS).drop("window")
    found = streaming.run_to_end(stream, "alerts", mode="complete")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_error_rate_append",
    f"""
    WITH {_SQL_TUMBLING}
    SELECT * FROM alerts WHERE window_start + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)
    """,
)
def stream_error_rate_append(spark: SparkSession, folder: str) -> DataFrame:
    """Append output: windows the watermark has passed, each written once."""
    windows = streaming.windowed_errors(
        _event_stream(spark, folder), F.col("event_type") == "error", width="5 minutes", delay="10 minutes"
    )
    stream = streaming.alerting(windows, share=ALERT_SHARE, min_events=ALERT_EVENTS).drop("window")
    found = streaming.run_to_end(stream, "alerts-append", mode="append")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_SQL_KEYED_RUNS = """
sliding AS (
  SELECT user_id % 3 AS service, time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS window_start, count(*) AS n_events,
    count(*) FILTER (event_type = 'error') AS n_errors
  FROM events, range(3) r(i) GROUP BY ALL),
alerts AS (
  SELECT *, round(n_errors / n_events, 4) AS error_share FROM sliding WHERE n_events >= 2 AND n_errors / n_events >= 0.5),
flagged AS (
  SELECT *, CASE WHEN window_start - lag(window_start) OVER (PARTITION BY service ORDER BY window_start) = INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS s
  FROM alerts),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY service ORDER BY window_start) AS run FROM flagged),
runs AS (
  SELECT service, min(window_start) AS first_detected, max(window_start) AS last_window, count(*) AS n_windows, max(error_share) AS peak_share
  FROM numbered GROUP BY service, run)
"""


@query("service_alert_runs", f"WITH {_SQL_KEYED_RUNS} SELECT * FROM runs")
def service_alert_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Alert runs of each service, over windows of fifteen minutes every five."""
    events = _timed(Tables(spark, folder)).withColumn("service", F.col("user_id") % 3)
    windows = metrics.error_windows(
        events, "at", F.col("event_type") == "error", width=15 * MINUTE, slide=5 * MINUTE, by=["service"]
    )
    alerted = metrics.alerts(windows, share=0.5, min_events=2)
    return _stamped(metrics.alert_runs(alerted, step=5 * MINUTE, by=["service"]), "first_detected", "last_window")


@query(
    "stream_alert_runs",
    f"""
    WITH {_SQL_KEYED_RUNS}
    SELECT * FROM runs
    WHERE last_window + INTERVAL 15 MINUTE - INTERVAL 1 MICROSECOND + INTERVAL 450 SECOND
      <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 20 MINUTE FROM events)
    """,
)
def stream_alert_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The same runs from a stream, windows and sessions chained: all that the watermark has passed."""
    events = _event_stream(spark, folder).withColumn("service", F.col("user_id") % 3)
    windows = streaming.windowed_errors(
        events, F.col("event_type") == "error", width="15 minutes", slide="5 minutes", delay="20 minutes", by=["service"]
    )
    runs = streaming.alert_runs(streaming.alerting(windows, share=0.5, min_events=2), step_seconds=300, by=["service"])
    found = streaming.run_to_end(runs, "alert-runs", mode="append")
    return found.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("first_detected", "last_window")})
