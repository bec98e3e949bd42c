"""Logs, metrics, correlation and the stage gate on small written fixtures and against brute force."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scorewright import scale
from scorewright.functions.time import MINUTE
from scorewright.operators import correlate, logs, metrics, quality

FLAT = """\
2024-11-20 21:15:00 ERROR  Seat map for hall 3 did not load
2024-11-20 21:15:02 INFO  Box office opened
no date on this one
2024-11-20 21:16:40 ERROR  Seat map for hall 4 did not load
2024-11-20 21:16:41 ERROR  Stack trace: seats.py:31 -> halls.py:8
2024-11-20 21:18:00 WARNING  Popcorn sensor reads 12 grams
2024-11-20 21:19:30 INFO  Hall 2 lights dimmed
2024-11-20 21:22:10 ERROR  Ticket printer out of paper
2024-02-31 21:30:00 INFO  a day that is not
2024-11-20 21:40:00 INFO  Box office closed
"""

COMPONENTS = """\
2024-11-21 08:00:00 ERROR [lift] Door sensor blind
2024-11-21 08:00:00 ERROR [lift]   at Door.look(Door.java:52)
2024-11-21 08:02:11 FATAL [crane] Cable slack
2024-11-21 08:03:00 INFO  [crane] Operator called
2024-11-21 08:04:45 WARN  [lift] Running on the spare motor
"""


def parsed(spark, text):
    lines = spark.createDataFrame([(line,) for line in text.splitlines()], "value STRING")
    return logs.parse_lines(lines)


def test_flat_log(spark):
    got = parsed(spark, FLAT)
    assert got.where("parsed").count() == 8
    bad = got.where("NOT parsed")
    assert bad.count() == 2 and bad.where("level IS NULL AND message IS NULL AND ts IS NULL").count() == 2
    assert got.where("level = 'WARNING'").count() == 1
    assert got.where("component IS NOT NULL").count() == 0
    first = got.first()
    assert first["ts"] == datetime(2024, 11, 20, 21, 15) and first["message"] == "Seat map for hall 3 did not load"


def test_errors_fold_continuations(spark):
    events = parsed(spark, FLAT).where("parsed").withColumns({"source": F.lit("cinema"), "n": F.monotonically_increasing_id()})
    row = logs.errors_as_json(events, "source", ["ts", "n"]).first()
    items = json.loads(row["errors"])
    assert row["n_errors"] == 3 and row["part"] == 0
    assert [i["timestamp"][-8:] for i in items] == ["21:15:00", "21:16:40", "21:22:10"]
    assert items[1]["message"] == "Seat map for hall 4 did not load"
    parts = logs.errors_as_json(events, "source", ["ts", "n"], max_bytes=190).orderBy("part").collect()
    assert [i for p in parts for i in json.loads(p["errors"])] == items


def test_component_log(spark):
    got = parsed(spark, COMPONENTS)
    assert got.where("component = 'lift' AND level = 'WARNING'").count() == 1
    assert got.where("is_continuation").count() == 1
    assert got.where("level = 'FATAL'").first()["component"] == "crane"


def test_top_events(spark):
    events = parsed(spark, FLAT).where("parsed").withColumns({"source": F.lit("m"), "n": F.monotonically_increasing_id()})
    top = logs.top_events(events, "source", ["ts", "n"], k=3).orderBy("rank").collect()
    assert [r["message"] for r in top][:2] == [
        "Seat map for hall 3 did not load", "Seat map for hall 4 did not load"
    ]
    assert [r["frequency"] for r in top] == [2, 2, 1]


@pytest.fixture
def many_slices(spark):
    """Keep Spark from merging few rows into one partition, so that slices carry over."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def chatter():
    """Events of five components, one of which has most; some at the same time."""
    chance = random.Random(3)
    rows = []
    for i in range(600):
        comp = "hot" if chance.random() < 0.6 else f"c{chance.randrange(4)}"
        rows.append((i, comp, chance.randrange(3_000), chance.choice(["INFO", "WARNING", "ERROR"])))
    return rows


def test_evidence_against_brute_force(spark, chatter, many_slices):
    events = spark.createDataFrame(chatter, "id BIGINT, comp STRING, at BIGINT, level STRING")
    got = logs.evidence_before(
        events, "comp", "at", "level", ["INFO", "WARNING", "ERROR"], F.col("level") == "ERROR", lookback=100
    )
    found = {(r["comp"], r["anchor_at"]): r for r in got.collect()}
    anchors = {(c, at) for _, c, at, level in chatter if level == "ERROR"}
    assert set(found) == anchors
    for comp, at in anchors:
        seen = [(t, level) for _, c, t, level in chatter if c == comp and at - 100 <= t < at]
        row = found[comp, at]
        assert row["n_events"] == len(seen)
        assert row["n_WARNING"] == sum(level == "WARNING" for _, level in seen)
        assert (row["first_at"], row["last_at"]) == ((min(seen)[0], max(seen)[0]) if seen else (None, None))


@pytest.mark.parametrize("n", [1, 4, 50])
def test_evidence_list_against_brute_force(spark, chatter, many_slices, n):
    events = spark.createDataFrame(chatter, "id BIGINT, comp STRING, at BIGINT, level STRING")
    got = logs.evidence_list(events, "comp", "at", "id", ["level"], F.col("level") == "ERROR", n=n, lookback=100)
    found = {r["id"]: ([(e["at"], e["id"], e["level"]) for e in r["evidence"]], r["n_listed"], r["comp"], r["at"]) for r in got.collect()}
    assert set(found) == {i for i, _, _, level in chatter if level == "ERROR"}
    for i, comp, at, level in chatter:
        if level == "ERROR":
            before = sorted((t, j, kind) for j, c, t, kind in chatter if c == comp and (t, j) < (at, i))[-n:]
            near = [event for event in before if event[0] >= at - 100]
            assert found[i] == (near, len(near), comp, at)


@pytest.mark.parametrize("within", [5, 60, 5_000])
def test_coverage_against_brute_force(spark, chatter, within, many_slices):
    errors = spark.createDataFrame([(c, at) for _, c, at, level in chatter if level == "ERROR"], "s STRING, at BIGINT")
    got = correlate.downstream_coverage(errors, "s", "at", within=within)
    found = {(r["s"], r["origin_at"]): r["n_downstream"] for r in got.collect()}
    points = {(c, at) for _, c, at, level in chatter if level == "ERROR"}
    want = {(c, t): len({d for d, u in points if d != c and t < u <= t + within}) for c, t in points}
    assert found == want


def test_chain_orders_services(spark):
    rows = [("db", 0), ("orders", 10), ("orders", 12), ("gateway", 20), ("db", 500), ("gateway", 501)]
    errors = spark.createDataFrame(rows, "s STRING, at BIGINT")
    covered = correlate.downstream_coverage(errors, "s", "at", within=60)
    chain = correlate.cascade_chain(errors, covered, "s", "at", within=60).orderBy("step").collect()
    assert [(r["s"], r["first_error_at"], r["n_errors"]) for r in chain] == [("db", 0, 1), ("orders", 10, 2), ("gateway", 20, 1)]


def test_outliers_per_metric(spark):
    chance = random.Random(11)
    planted = {(0, "salt"): 400, (17, "salt"): -300, (17, "wind"): 999}
    rows = [
        (buoy, *[planted.get((buoy, name), 100 + chance.randrange(-6, 7)) for name in ("salt", "wind")]) for buoy in range(40)
    ]
    wide = spark.createDataFrame(rows, "buoy INT, salt INT, wind INT")
    flagged = metrics.outliers(metrics.long_form(wide, ["buoy"], ["salt", "wind"]), "metric", "value", spread=["buoy"])
    assert {(r["buoy"], r["metric"]) for r in flagged.collect()} == set(planted)
    flat = spark.createDataFrame([("a", 5.0, i) for i in range(9)] + [("a", 900.0, 9)], "metric STRING, value DOUBLE, id INT")
    assert metrics.outliers(flat, "metric", "value", spread=["id"]).count() == 0


def test_windows_alerts_and_runs(spark):
    rows = [(i * MINUTE, i < 12) for i in range(20)] + [(30 * MINUTE + i, True) for i in range(3)]
    events = spark.createDataFrame(rows, "at BIGINT, failed BOOLEAN")
    windows = metrics.error_windows(events, "at", F.col("failed"))
    alerted = metrics.alerts(windows, share=0.6, min_events=3)
    assert sorted(r["window_start"] // MINUTE for r in alerted.collect()) == [0, 5, 30]
    runs = metrics.alert_runs(alerted, step=5 * MINUTE).orderBy("first_detected").collect()
    assert [(r["first_detected"] // MINUTE, r["n_windows"]) for r in runs] == [(0, 2), (30, 1)]
    sliding = metrics.error_windows(events, "at", F.col("failed"), slide=MINUTE)
    want = {}
    for at, failed in rows:
        for start in range(at // MINUTE - 4, at // MINUTE + 1):
            n, bad = want.get(start, (0, 0))
            want[start] = (n + 1, bad + failed)
    assert {r["window_start"] // MINUTE: (r["n_events"], r["n_errors"]) for r in sliding.collect()} == want
    with pytest.raises(ValueError):
        metrics.error_windows(events, "at", F.col("failed"), width=5, slide=2)


@pytest.mark.parametrize("broadcast", [True, False])
def test_limits_against_brute_force(spark, monkeypatch, broadcast):
    """Many limits a measure, one of them twice under two keys, a hot service, values that are none."""
    if not broadcast:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    chance = random.Random(23)
    limits = [(s, m, f"{m}-{k}", float(chance.randrange(100))) for s in ("api", "db", "idle") for m in ("pool", "wait") for k in range(6)]
    limits += [("api", "pool", "pool-alias", limits[0][3]), ("api", "pool", "pool-none", None), ("db", "wait", "zero", 0.0), limits[0]]
    rows = [
        (i, chance.choice(["api"] * 6 + ["db", "cron", None]), chance.choice(["pool", "wait", "other"]), chance.randrange(4 * 15) * MINUTE,
         chance.choice([None, float("nan"), *[chance.random() * 110 for _ in range(9)]]))
        for i in range(3000)
    ]
    alerted = [(0, "api", 0.7), (15 * MINUTE, "db", 0.9), (30 * MINUTE, "api", 0.8), (30 * MINUTE, "cron", 1.0), (90 * MINUTE, "api", 1.0)]
    got = metrics.limit_breaches(
        spark.createDataFrame(rows, "id INT, service STRING, measure STRING, at BIGINT, v DOUBLE"),
        spark.createDataFrame(alerted, "window_start BIGINT, service STRING, error_share DOUBLE"),
        spark.createDataFrame(limits, "service STRING, measure STRING, config_key STRING, config_limit DOUBLE"),
        "at", "v", width=15 * MINUTE, spread=["id"],
    ).collect()
    want = {}
    for start, service, share in alerted:
        for s, m, key, limit in set(limits):
            held = [(v, at) for _, es, em, at, v in rows if es == s == service and em == m and at // (15 * MINUTE) * 15 * MINUTE == start
                    and v is not None and v == v and limit is not None and v >= limit]
            if held:
                want[start, s, m, key, limit] = (share, len(held), max(held)[0], min(at for _, at in held))
    fields = ("window_start", "service", "measure", "config_key", "config_limit")
    assert {tuple(r[f] for f in fields): (r["error_share"], r["n_breaches"], r["max_value"], r["first_breach"]) for r in got} == want
    assert len(got) == len(want)
    most = {}
    for (start, s, m, key, limit), (_, n, top, _) in want.items():
        rank = (-(top / limit) if limit else float("inf"), -n, key, limit, m)
        most[start, s] = min(most.get((start, s), (rank,)), (rank,))
    assert {(r["window_start"], r["service"]): r["config_key"] for r in got if r["contributed_most"]} == {k: v[0][2] for k, v in most.items()}


def test_signatures(spark):
    reports = spark.createDataFrame([(1, "timeout after 30s at 0xAF12"), (2, "disk full")], "id INT, m STRING")
    lines = spark.createDataFrame([("timeout after 5s at 0x1",), ("timeout after 7s at 0x2",), ("ok",), (None,)], "m STRING")
    from scorewright.functions.text import signature

    def ids(matched):
        found = logs.match_signatures(
            reports, lines, signature(F.col("m")), signature(F.col("m")), spread=["id"], matched=matched
        )
        return [r["id"] for r in found.collect()]

    assert ids(True) == [1] and ids(False) == [2]


def test_breakdown(spark):
    rows = [(1, "w1", True), (1, "w1", True), (1, "w2", False), (2, "w1", False)]
    events = spark.createDataFrame(rows, "hour INT, worker STRING, failed BOOLEAN")
    got = {(r["hour"], r["worker"], r["grouping_level"]): (r["n_failed"], r["lift"]) for r in
           logs.failure_breakdown(events, F.col("failed"), ("hour", "worker")).collect()}
    assert got[1, "w1", 0] == (2, 2.0) and got[1, None, 1] == (2, 1.3333) and got[None, None, 3] == (2, 1.0)
    assert len(got) == 6


def sales(spark):
    rows = [(i % 14, 10, None) for i in range(140)] + [(None, 10, None)] * 5
    orders = spark.createDataFrame(rows, "customer_id INT, amount INT, x STRING")
    customers = spark.createDataFrame([(i, f"country {i}") for i in range(14)], "customer_id INT, country STRING")
    return orders, customers


def test_gate_names_the_silent_stage(spark):
    orders, customers = sales(spark)
    broken = customers.withColumn("customer_id", F.col("customer_id") + 1000)
    result, good = quality.run_stages(orders, quality.sales_stages(customers))
    assert result.count() == 14 and {r["amount"] for r in result.collect()} == {100}
    _, bad = quality.run_stages(orders, quality.sales_stages(customers, enrich=lambda o: quality.customer_countries(o, broken)))
    verdicts = {r["stage"]: r for r in quality.gate(bad, good).collect()}
    assert [s for s, r in verdicts.items() if r["is_fault"]] == ["enrich"]
    assert verdicts["enrich"]["status"] == "OK" and verdicts["enrich"]["null_share"] == 1.0
    assert verdicts["extract"]["rows_out"] == 145 and verdicts["clean"]["rows_out"] == 140 and verdicts["clean"]["rows_in"] == 145
    assert verdicts["extract"]["verdict"] == "PASS" and verdicts["publish"]["verdict"] == "FAIL"
    assert all(r["verdict"] == "PASS" for r in quality.gate(good, good).collect())


@pytest.mark.parametrize("fault", ["one group", "half the money", "error"])
def test_gate_names_aggregate(spark, fault):
    orders, customers = sales(spark)

    def aggregate(enriched):
        if fault == "error":
            return quality.country_report(enriched.withColumn("amount", F.raise_error(F.lit("disk full")).cast("int")))
        if fault == "one group":
            return quality.country_report(enriched.withColumn("country", F.lit("all")))
        return quality.country_report(enriched.withColumn("amount", F.col("amount") / 2))

    _, good = quality.run_stages(orders, quality.sales_stages(customers))
    _, bad = quality.run_stages(orders, quality.sales_stages(customers, aggregate=aggregate))
    verdicts = {r["stage"]: r for r in quality.gate(bad, good, min_amount_share=0.9).collect()}
    assert [s for s, r in verdicts.items() if r["is_fault"]] == ["aggregate"]
    assert verdicts["enrich"]["groups_out"] == 14 and verdicts["enrich"]["amount_out"] == 1400
    assert verdicts["publish"]["verdict"] == "FAIL"
    if fault == "error":
        assert "disk full" in verdicts["aggregate"]["error"] and verdicts["publish"]["status"] == "NOT RUN"


def test_stages_count_what_they_write(spark):
    """A stage is counted as written: combined rows by weight, rejected ones, none at all; the source is read once."""
    reads = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    source = spark.range(100).mapInPandas(touch, "id BIGINT")
    stages = [
        quality.Stage("read", lambda rows: rows.withColumn("key", F.when(F.col("id") % 10 > 0, F.col("id") % 3)), "key",
                      groups="key", rejected=F.col("id") > 95),
        quality.Stage("sum", lambda rows: rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", weight="n", amount="n"),
        quality.Stage("none", lambda rows: rows.where("n > 1000"), "key", groups="key", amount="n"),
    ]
    last, report = quality.run_stages(source, stages, first=3)
    assert last.count() == 0 and reads.value == 100
    rows = [tuple(r)[:8] for r in report.orderBy("ord").collect()]
    assert rows[0] == ("read", 3, "OK", 100, 10, 4, 3, None)
    assert rows[1] == ("sum", 4, "OK", 100, 10, None, None, 100)
    assert rows[2] == ("none", 5, "OK", 0, 0, None, 0, None)


def test_totals_use_a_half_open_year(spark):
    days = [datetime(2024, 12, 31, 23, 59), datetime(2025, 1, 1), datetime(2025, 12, 31, 23, 59), datetime(2026, 1, 1)]
    orders = spark.createDataFrame([(1, 10 ** i, day) for i, day in enumerate(days)], "customer_id INT, amount INT, created_at TIMESTAMP_NTZ")
    customers = spark.createDataFrame([(1, "Chile")], "customer_id INT, country STRING")
    row = quality.totals_by_country(orders, customers, start="2025-01-01", end="2026-01-01").first()
    assert (row["country"], row["total"]) == ("Chile", 110)


def test_gaps_and_latency(spark):
    rows = [(1, 1, 0), (2, 1, 2_000_000), (3, 1, 6_000_000), (4, 2, 5), (5, 1, 6_000_000)]
    events = spark.createDataFrame(rows, "id INT, k INT, at BIGINT")
    gap_rows = metrics.gaps(events, "k", "at", ["id"])
    assert sorted(r["gap"] for r in gap_rows.collect() if r["gap"] is not None) == [0, 2_000_000, 4_000_000]
    row = metrics.latency_stats(gap_rows, "k").first()
    assert (row["k"], row["n_gaps"], row["mean_s"], row["median_s"]) == (1, 3, 2.0, 2.0)


def test_stream_equals_batch(spark, tmp_path):
    from scorewright.streaming import alerts as streaming

    base = datetime(2025, 5, 1)
    first = [(base + timedelta(minutes=m), m % 2 == 0) for m in range(60)]
    late = [(base + timedelta(minutes=2), True)] * 50
    folder = str(tmp_path / "events")
    schema = "ts TIMESTAMP_NTZ, failed BOOLEAN"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)

    def run(mode):
        stream = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
        windows = streaming.windowed_errors(stream, F.col("failed"), width="5 minutes", delay="10 minutes").drop("window")
        return {r["window_start"].replace(tzinfo=None): (r["n_events"], r["n_errors"]) for r in
                streaming.run_to_end(windows, f"w-{mode}", mode=mode).collect()}

    batch = spark.read.schema(schema).parquet(folder).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    counted = metrics.error_windows(batch, "at", F.col("failed"))
    want = {base + timedelta(microseconds=r["window_start"] - int((base - datetime(1970, 1, 1)).total_seconds() * 1e6)):
            (r["n_events"], r["n_errors"]) for r in counted.collect()}
    assert run("complete") == want
    closed = run("append")
    assert closed.items() <= want.items() and len(closed) < len(want)


def test_stream_drops_rows_behind_the_watermark(spark, tmp_path):
    from scorewright.streaming import alerts as streaming

    base = datetime(2025, 5, 1)
    folder, schema = str(tmp_path / "events"), "ts TIMESTAMP_NTZ, failed BOOLEAN"
    batches = [
        [(base + timedelta(minutes=m), False) for m in range(60)],
        [(base + timedelta(minutes=61), True)],
        [(base + timedelta(minutes=2), True), (base + timedelta(minutes=52), True)],
        [(base + timedelta(minutes=3), True), (base + timedelta(minutes=120), True)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    stream = reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    windows = streaming.windowed_errors(stream, F.col("failed"), width="5 minutes", delay="10 minutes").drop("window")
    got = {r["window_start"]: (r["n_events"], r["n_errors"]) for r in streaming.run_to_end(windows, "late", mode="append").collect()}
    assert got[base] == (5, 0)
    assert got[base + timedelta(minutes=50)] == (6, 1)
    assert base + timedelta(minutes=120) not in got


def test_stream_runs_by_service_equal_batch(spark, tmp_path):
    """Files in time order with rows that come late, some too late: runs below the watermark are those of the rows taken in."""
    from scorewright.streaming import alerts as streaming

    chance, base = random.Random(31), datetime(2025, 5, 1)
    folder, schema = str(tmp_path / "events"), "ts TIMESTAMP_NTZ, service STRING, failed BOOLEAN"
    taken, newest = [], None
    for part in range(6):
        rows = []
        for _ in range(400):
            service = chance.choice(["api", "api", "db", None])
            minute = part * 60 + chance.randrange(60) - (chance.randrange(0, 14) if part else 0)
            calm = (minute // 20 + (service == "api")) % 3
            rows.append((base + timedelta(minutes=minute, seconds=chance.randrange(60)), service, chance.random() < (0.9, 0.2, 0.5)[calm]))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        taken += rows
        newest = max(at for at, _, _ in taken)
        if part == 3:  # an hour behind the watermark
            late = [(base + timedelta(minutes=100), "api", True)] * 500
            spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    stream = reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    windows = streaming.windowed_errors(stream, F.col("failed"), width="10 minutes", slide="5 minutes", delay="15 minutes", by=["service"])
    runs = streaming.alert_runs(streaming.alerting(windows, share=0.6, min_events=3), step_seconds=300, by=["service"])
    got = {(r["service"], r["first_detected"]): (r["last_window"], r["n_windows"], r["peak_share"]) for r in
           streaming.run_to_end(runs, "keyed", mode="append").collect()}

    batch = spark.createDataFrame(taken, schema).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    counted = metrics.error_windows(batch, "at", F.col("failed"), width=10 * MINUTE, slide=5 * MINUTE, by=["service"])
    whole = metrics.alert_runs(metrics.alerts(counted, share=0.6, min_events=3), step=5 * MINUTE, by=["service"])

    def stamp(at):
        return datetime(1970, 1, 1) + timedelta(microseconds=at)

    want = {(r["service"], stamp(r["first_detected"])): (stamp(r["last_window"]), r["n_windows"], r["peak_share"]) for r in whole.collect()}
    closed = {k: v for k, v in want.items() if v[0] + timedelta(minutes=10, seconds=450) <= newest - timedelta(minutes=15)}
    assert got == closed and 3 < len(closed) < len(want)
    assert max(n for _, n, _ in closed.values()) > 2 and {service for service, _ in closed} == {"api", "db", None}


def test_complete_output_without_input(spark, tmp_path):
    from scorewright.streaming import alerts as streaming

    schema = "ts TIMESTAMP_NTZ, failed BOOLEAN"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    windows = streaming.windowed_errors(stream, F.col("failed"), width="5 minutes", delay="1 minute").drop("window")
    assert streaming.run_to_end(windows, "none", mode="complete").count() == 0
