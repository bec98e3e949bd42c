"""Edge rows of scoring, escalation and cost."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scorewright.functions import numbers as N
from scorewright.functions import text as T
from scorewright.operators import accounting, cascade, inference, report, routing, scoring
from scorewright.sources.tasks import mark_skipped


def judged(spark, rows):
    df = spark.createDataFrame(rows, "task_id STRING, output STRING, criteria STRING, raw DOUBLE")
    gated = scoring.judge_gate(df, output=F.col("output"), criteria=F.col("criteria"), raw_score=F.col("raw"))
    return {r["task_id"]: r for r in gated.collect()}


def test_judge_gate_edges(spark):
    got = judged(
        spark,
        [
            ("just under", "an answer", "c", 0.4996),
            ("on it", "an answer", "c", 0.5),
            ("no criteria", "an answer", None, 0.9),
            ("blank", "  \n\t", "c", 0.9),
            ("null output", None, "c", None),
            ("unjudged", "an answer", "c", None),
        ],
    )
    assert (got["just under"]["score"], got["just under"]["passed"]) == (0.5, False)
    assert (got["on it"]["score"], got["on it"]["passed"]) == (0.5, True)
    assert got["no criteria"]["score"] is None and got["no criteria"]["passed"] is None
    assert (got["blank"]["score"], got["blank"]["passed"]) == (0.0, False)
    assert got["null output"]["score"] == 0.0
    assert got["unjudged"]["score"] is None


def test_escalation_edges(spark):
    rows = [
        ("just under", 0.5, False, False),
        ("on it", 0.5, True, False),
        ("below", 0.499, False, True),
        ("unscored failed", None, False, True),
        ("unscored passed", None, True, False),
        ("skipped", None, None, False),
    ]
    df = spark.createDataFrame(rows, "name STRING, score DOUBLE, success BOOLEAN, want BOOLEAN")
    weak = cascade.needs_escalation(F.col("score"), F.col("success"))
    for row in df.withColumn("got", weak).collect():
        assert row["got"] == row["want"], row["name"]
    off = cascade.needs_escalation(F.col("score"), F.col("success"), enabled=False)
    assert df.where(off).count() == 0
    exempt = cascade.needs_escalation(F.col("score"), F.col("success"), exempt=F.col("name") == "below")
    assert [r["name"] for r in df.where(exempt).collect()] == ["unscored failed"]


def test_heuristic_lengths(spark):
    df = spark.createDataFrame(
        [(n, "x" * n + " \n", None) for n in (19, 20, 30, 31)]
        + [(100, "nothing of note in this answer", ["Cache"]), (101, "The CACHE was not reachable", ["Cache"])]
        + [(102, None, None)],
        "n INT, output STRING, kws ARRAY<STRING>",
    )
    got = {r["n"]: (r["passed"], r["score_method"]) for r in scoring.heuristic_score(df, "output", F.col("kws")).collect()}
    assert got == {
        19: (False, scoring.TOO_SHORT),
        20: (False, scoring.NON_EMPTY),
        30: (False, scoring.NON_EMPTY),
        31: (True, scoring.NON_EMPTY),
        100: (False, scoring.KEYWORD_MATCH),
        101: (True, scoring.KEYWORD_MATCH),
        102: (False, scoring.TOO_SHORT),
    }


def test_dispatch_falls_back_and_clears_score(spark):
    df = spark.createDataFrame(
        [("code", "execution", True, 0.1), ("judged", "expected", None, 0.7), ("bare", "criteria_only", None, None)],
        "id STRING, mode STRING, runs BOOLEAN, raw DOUBLE",
    ).withColumn("output", F.lit("an answer that is long enough to pass"))
    got = scoring.dispatch(
        df, mode=F.col("mode"), output=F.col("output"), keywords=F.lit(None).cast("array<string>"),
        executes=F.col("runs"), judged=F.col("raw"),
    )
    found = {r["id"]: (r["success"], r["score"]) for r in got.collect()}
    assert found == {"code": (True, None), "judged": (True, 0.7), "bare": (True, None)}


def test_token_f1(spark):
    rows = [
        (1, "The cat, the CAT sat", "the cat sat"),
        (2, "same words here", "same words here"),
        (3, "", "something"),
        (4, None, "something"),
        (5, "...", "!!!"),
        (6, "no overlap", "at all"),
        (7, "answer", None),
    ]
    df = spark.createDataFrame(rows, "id INT, answer STRING, ref STRING")
    got = {r["id"]: r for r in scoring.token_f1(df, ["id"], {"f1": "answer"}, "ref").collect()}
    assert got[1]["f1"] == 0.75 and got[1]["f1_overlap"] == 3 and got[1]["f1_size"] == 8
    assert got[2]["f1"] == 1.0
    assert got[3]["f1"] == 0.0 and got[5]["f1"] == 0.0 and got[6]["f1"] == 0.0 and got[7]["f1"] == 0.0
    assert got[4]["f1"] is None and got[4]["f1_raw"] is None
    assert len(got) == 7


def test_coverage(spark):
    df = spark.createDataFrame([(1, "Alpha and beta"), (2, None)], "id INT, output STRING")
    terms = F.array(F.lit("alpha"), F.lit("Beta"), F.lit("gamma"))
    got = {r["id"]: (r["n_terms"], r["n_present"], r["coverage"]) for r in scoring.coverage(df, "output", terms).collect()}
    assert got == {1: (3, 2, 0.667), 2: (3, 0, 0.0)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("no fence here", "no fence here"),
        ("Look:\n```python\nx = 1\n```\nDone", "x = 1"),
        ("```\nfirst\n```\nand\n```\nsecond\n```", "first"),
        ("```SQL\nselect 1", "select 1"),
        ("```rust\nfn main\n```", "rust\nfn main"),
        ("```json```", ""),
        ("```js \n let a\n```", "let a"),
        ("  spaced, no fence ", "  spaced, no fence "),
    ],
)
def test_first_code_block(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw STRING")
    assert df.select(T.first_code_block(F.col("raw"))).first()[0] == want


def test_code_blocks_round_trip(spark):
    bodies = ["a = 1", "def f():\n    return '''x'''", "select *\n\nfrom t", "é = “quoted”"]
    df = spark.createDataFrame([(b,) for b in bodies], "body STRING")
    raw = F.concat(F.lit("Sure!\n```py\n"), "body", F.lit("\n```\nbye"))
    assert df.where(T.first_code_block(raw) != F.col("body")).count() == 0


def test_quotes(spark):
    got = spark.range(1).select(T.plain_quotes(F.lit("“it’s” ‘so’"))).first()[0]
    assert got == "\"it's\" 'so'"


def test_code_gate_parses_and_never_runs(spark, tmp_path):
    target = tmp_path / "ran"
    codes = {
        "function": "def f(x):\n    return x",
        "class": "class A: pass",
        "lambda": "f = lambda x: x",
        "import": "from math import sqrt",
        "value": "x = 1",
        "broken": "def f(:",
        "side effect": f"open({str(target)!r}, 'w')\ndef f(): pass",
        "null": None,
        "smart": "print(‘x’)",
    }
    df = spark.createDataFrame(list(codes.items()), "id STRING, code STRING")
    got = {r["id"]: r["passed"] for r in inference.code_gate(df, "id", "code").collect()}
    passing = {"function", "class", "lambda", "import", "side effect"}
    assert {name for name, passed in got.items() if passed} == passing
    assert not target.exists()


def test_parse_items(spark):
    rows = [
        ("plain", '[{"task_id": "A1", "agent": "file_agent"}, {"task_id": "B1", "agent": "code_agent"}]'),
        ("fenced", '```json\n[{"task_id": "A1", "agent": "file_agent"}]\n```'),
        ("prose", "I would start with A1"),
        ("cut", '[{"task_id": "A1", "ag'),
        ("empty", "[]"),
        ("more", '[{"task_id": "A1"}] and more'),
        ("object", '{"task_id": "A1"}'),
        ("two", "[], []"),
        ("field", '[], "x": 1'),
        ("closed", "[]] x"),
        ("null", "null"),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "name STRING, raw STRING")
    numbers = spark.createDataFrame([('[{"k": "x"}]',), ('[{"k": 1}]',)], "raw STRING")
    kinds = inference.parse_items(numbers, "raw", "ARRAY<STRUCT<k: BIGINT>>").orderBy("raw")
    assert [r["valid"] for r in kinds.collect()] == [False, True]
    got = {r["name"]: (r["valid"], len(r["items"])) for r in inference.parse_items(df, "raw").collect()}
    assert got["plain"] == (True, 2) and got["fenced"] == (True, 1) and got["empty"] == (True, 0)
    assert all(got[name] == (False, 0) for name in ("more", "object", "two", "field", "closed", "null", None))
    assert got["prose"] == (False, 0) and got["cut"][0] is False


def test_cost_and_size(spark):
    rows = [(1000, "gpt-4o-mini"), (1000, "gpt-4o"), (1000, "local"), (1018, "gpt-4o-mini"), (0, "gpt-4o"), (50, "gpt-4o-mini")]
    calls = spark.createDataFrame(rows, "tokens BIGINT, model STRING")
    got = [r["cost_usd"] for r in accounting.price_calls(calls).collect()]
    assert got == [Decimal(v) for v in ("0.000330", "0.005500", "0.000000", "0.000336", "0.000000", "0.000017")]
    for n_bytes, kb in ((1241, "1.212"), (201, "0.196"), (1110, "1.084"), (75, "0.073"), (0, "0.000")):
        text = F.repeat(F.lit("a"), F.lit(n_bytes))
        assert spark.range(1).select(N.payload_kb(text)).first()[0] == Decimal(kb)
    assert spark.range(1).select(N.payload_kb(F.lit("é"))).first()[0] == Decimal("0.002")


def test_ratio_is_exact(spark):
    for a, b, places in ((1, 16, 3), (2, 3, 2), (1, 8, 2), (10**12, 3, 3), (0, 5, 3), (5, 1000, 2)):
        got = spark.range(1).select(N.ratio(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), places)).first()[0]
        scale = 10**places
        assert got == ((2 * a * scale + b) // (2 * b)) / scale
    assert spark.range(1).select(N.ratio(F.lit(1), F.lit(0), 3)).first()[0] is None


def test_routing(spark):
    bank = spark.createDataFrame([("file_agent",), ("multimodal_agent",), ("nobody",)], "agent STRING")
    hybrid = {r["agent"]: (r["tier"], r["model"]) for r in routing.route(bank).collect()}
    assert hybrid["file_agent"][0] == "local" and hybrid["multimodal_agent"] == ("cloud", "gpt-4o")
    assert hybrid["nobody"] == (routing.QUARANTINE, None)
    cloud = {r["agent"]: (r["tier"], r["model"]) for r in routing.route(bank, mode="cloud_only").collect()}
    assert cloud["file_agent"] == ("cloud", "gpt-4o-mini") and cloud["multimodal_agent"] == ("cloud", "gpt-4o")
    assert cloud["nobody"] == (routing.QUARANTINE, None)
    with pytest.raises(Exception, match="unknown agent: nobody"):
        routing.route(bank, strict=True).collect()
    with pytest.raises(ValueError):
        routing.route(bank, mode="elsewhere")


def test_templates_choose_columns(spark):
    bank = spark.createDataFrame([("code_agent", "sort it", "data"), ("x", None, "data")], "agent STRING, d STRING, i STRING")
    got = routing.render_prompts(bank, {"code_agent": ["Write: ", F.col("d")]}, default=[F.col("d"), "|", F.col("i")])
    assert [r["prompt"] for r in got.collect()] == ["Write: sort it", "|data"]


def results(spark, rows):
    return spark.createDataFrame(
        rows, "task_id STRING, success BOOLEAN, latency_s DOUBLE, cloud_calls INT, cost_usd DECIMAL(18,6)"
    )


def test_summary_skips(spark):
    rows = [("a", True, 2.0, 1, Decimal("0.1")), ("b", False, 1.0, 0, Decimal("0")), ("c", None, 0.0, 0, Decimal("0")),
            ("d", True, 3.0, 1, Decimal("0.2"))]
    row = report.run_summary(results(spark, rows)).first()
    assert (row["n_tasks"], row["n_scored"], row["n_passed"], row["pass_rate_pct"]) == (4, 3, 2, 67.0)
    assert row["mean_latency_s"] == 1.5 and row["cloud_calls"] == 2 and row["cost_usd"] == pytest.approx(0.3)
    none = report.run_summary(results(spark, [])).first()
    assert none["n_tasks"] == 0 and none["pass_rate_pct"] is None


def test_skip_keeps_the_row(spark):
    df = spark.createDataFrame([(1, True, "x"), (2, False, None), (3, None, "y")], "id INT, found BOOLEAN, output STRING")
    got = {r["id"]: (r["skipped"], r["output"]) for r in mark_skipped(df, "found", "output").collect()}
    assert got[1] == (False, "x") and got[2] == got[3] and got[2][0] and got[2][1].startswith("[SKIPPED]")
    scored = mark_skipped(df.withColumn("success", F.lit(False)), "found", "output").collect()
    assert {r["id"]: r["success"] for r in scored} == {1: False, 2: None, 3: None}


def test_many_keyword_keys(spark):
    words = {f"k{i}": [f"w{i}", "other"] for i in range(1_500)}
    rows = spark.range(1_502).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k")).unionAll(
        spark.sql("SELECT CAST(NULL AS STRING)")
    )
    listed = [(k, w[:1]) for k, w in words.items()] + [(k, w[1:]) for k, w in words.items()] + [(None, ["x"]), ("k1", None)]
    table = spark.createDataFrame(listed, "key STRING, terms ARRAY<STRING>")
    few = dict(list(words.items())[:600])
    for given, known in ((words, words), (table, words), (few, few), ({}, {})):
        got = scoring.with_terms(rows, "k", given, "terms", spread=["k"]).collect()
        assert len(got) == 1_503
        assert all((sorted(r["terms"]) if r["terms"] else None) == (sorted(known[r["k"]]) if r["k"] in known else None) for r in got)


def test_merge_keeps_every_row_and_the_first_answer(spark):
    first = spark.createDataFrame(
        [(1, "weak", 0.2, 0.2, False), (2, "good", 0.9, 0.9, True), (3, "weak, alone", 0.1, 0.1, False),
         (4, None, None, None, None), (5, "just", 0.4996, 0.5, False), (6, "unscored", None, None, False)],
        "id INT, output STRING, raw_score DOUBLE, score DOUBLE, success BOOLEAN",
    )
    second = spark.createDataFrame(
        [(1, "better", 0.8, 1000, "gpt-4o-mini"), (2, "unused", 1.0, 1000, "gpt-4o-mini"),
         (5, "unused", 1.0, 10, "gpt-4o-mini"), (6, "scored", 0.6, 10, "gpt-4o")],
        "id INT, output STRING, raw_score DOUBLE, tokens BIGINT, model STRING",
    )
    got = {r["id"]: r for r in cascade.merge_tiers(first, second, ["id"]).collect()}
    assert len(got) == 6
    assert (got[1]["output"], got[1]["local_output"], got[1]["local_score"], got[1]["success"]) == ("better", "weak", 0.2, True)
    assert got[1]["cost_usd"] == Decimal("0.000330") and got[1]["cloud_calls"] == 1
    assert (got[2]["output"], got[2]["escalated"], got[2]["cost_usd"]) == ("good", False, Decimal("0"))
    assert got[3]["output"] == "weak, alone" and got[3]["error"] == "no second-tier answer" and not got[3]["escalated"]
    assert got[4]["success"] is None and not got[4]["escalated"]
    assert not got[5]["escalated"]
    assert got[6]["escalated"] and got[6]["local_score"] is None and got[6]["score"] == 0.6


def test_feed_and_report(spark):
    df = spark.createDataFrame(
        [("r", 1, "b", "second"), ("r", 0, "a", "first"), ("r", 2, "c", ""), ("r", 3, "d", "[SKIPPED] missing"), ("r", 4, "e", "last")],
        "run STRING, pos BIGINT, agent STRING, output STRING",
    )
    row = report.synthesis_feed(df, "run", "pos", "agent", "output").first()
    assert row["feed"] == "Task 0 (a):\nfirst\n\nTask 1 (b):\nsecond\n\nTask 4 (e):\nlast"
    parts = report.synthesis_feed(df, "run", "pos", "agent", "output", max_bytes=45).orderBy("part").collect()
    assert "\n\n".join(p["feed"] for p in parts) == row["feed"] and [p["n_outputs"] for p in parts] == [2, 1]


def test_runs_in_the_order_of_time(spark):
    """Run names that sort the other way, two models, a category that a run lacks, runs that begin at once."""
    rows = []
    for run, model, begin, passes in [
        ("z-first", "m", 100, {"a": (1, 4), "b": (1, 2)}), ("k-second", "m", 200, {"a": (3, 4)}), ("a-third", "m", 300, {"a": (2, 4), "b": (2, 2)}),
        ("b-third", "m", 300, {"b": (0, 2)}), ("z-first", "n", 250, {"a": (4, 4)}),
    ]:
        for category, (good, of) in passes.items():
            rows += [(run, model, category, begin + 10 * i + (category == "b"), i < good, 1.0 if i < good else 0.0) for i in range(of)]
    df = spark.createDataFrame(rows, "run STRING, model STRING, category STRING, at BIGINT, success BOOLEAN, score DOUBLE")
    full = df.withColumns({"escalated": F.lit(False), "local_score": F.lit(None).cast("double"), "cost_usd": F.lit(0.5)})
    got = {(r["run"], r["model"], r["category"]): r for r in report.compare_runs(full, "run", "model", "category", "at").collect()}
    assert len(got) == 7 + 5 and sum(r["is_total"] for r in got.values()) == 5
    assert got["z-first", "m", "a"]["previous_run"] is None and got["z-first", "n", "a"]["pass_rate_change"] is None
    assert (got["k-second", "m", "a"]["previous_run"], got["k-second", "m", "a"]["pass_rate_change"]) == ("z-first", 50.0)
    assert (got["a-third", "m", "a"]["previous_run"], got["a-third", "m", "a"]["pass_rate_change"]) == ("k-second", -25.0)
    assert (got["a-third", "m", "b"]["previous_run"], got["a-third", "m", "b"]["pass_rate_change"]) == ("z-first", 50.0)
    assert (got["b-third", "m", "b"]["previous_run"], got["b-third", "m", None]["previous_run"]) == ("a-third", "a-third")
    assert got["a-third", "m", None]["n_tasks"] == 6 and got["a-third", "m", None]["pass_rate_change"] == -8.333
    assert got["z-first", "n", "a"]["rank_in_category"] == 1 and got["k-second", "m", "a"]["rank_in_category"] == 2
    assert got["z-first", "m", "b"]["run_began"] == 100 and got["z-first", "m", None]["cost_per_pass"] == 1.5


def test_report_rows(spark):
    df = spark.createDataFrame(
        [(1, True, 0.5, True, 1.25, Decimal("0.000330"), Decimal("1.212"), "x" * 301), (2, None, None, False, None, Decimal("0"), Decimal("0"), "short"),
         (3, False, 0.1, None, 0.0, Decimal("1.5"), Decimal("0.025"), "")],
        "id INT, success BOOLEAN, score DOUBLE, escalated BOOLEAN, latency_s DOUBLE, cost_usd DECIMAL(18,6), data_kb DECIMAL(18,3), output STRING",
    )
    got = {r["id"]: r for r in report.report_rows(df, ["id"]).collect()}
    assert (got[1]["result"], got[1]["score"], got[1]["escalated"], got[1]["latency"]) == ("PASS", "0.500", "YES", "1.25s")
    assert (got[1]["cost"], got[1]["data"]) == ("$0.000330", "1.21 KB")
    assert got[1]["preview"] == "x" * 300 + "..." and got[2]["preview"] == "short"
    assert got[1]["output"] == "x" * 301
    assert (got[2]["result"], got[2]["score"], got[2]["escalated"]) == ("SKIP", "-", "no") and got[3]["result"] == "FAIL"


def test_templates_of_a_table(spark):
    """Values that look like places, NULL values, a template of the tier before one of the agent."""
    bank = spark.createDataFrame(
        [(1, "a", "local", "sum {input_text}", "1 2"), (2, "a", "cloud", "x", None), (3, "b", "local", "y", "z"), (4, "c", "second", "w", "{description}")],
        "id INT, agent STRING, tier STRING, description STRING, input_text STRING",
    )
    table = spark.createDataFrame(
        [("a", "local", "{description}|{input_text}|{unknown}"), ("a", None, "any {description}{input_text}."), ("b", "cloud", "no"), ("c", None, "{input_text}")],
        "agent STRING, tier STRING, template STRING",
    )
    got = routing.render_prompts(bank, table, default={"local": ["mine: ", F.col("description")]}, spread=["id"])
    assert {r["id"]: r["prompt"] for r in got.collect()} == {1: "sum {input_text}|1 2|{unknown}", 2: "any x.", 3: "mine: y", 4: "{description}"}
    assert "_exact" not in got.columns and got.where(F.col("prompt_sha") != F.sha2("prompt", 256)).count() == 0


def test_routes_and_prices_as_tables(spark):
    bank = spark.createDataFrame([(1, "a"), (2, "b"), (3, "nobody"), (4, None)], "id INT, agent STRING")
    routes = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("agent"), F.lit("local").alias("tier"), F.lit("m").alias("model"))
    routes = routes.unionAll(spark.createDataFrame([("a", "local", "m1"), ("b", "cloud", "m2"), ("b", "local", "m3")], routes.schema))
    got = {r["id"]: (r["tier"], r["model"]) for r in routing.route(bank, routes=routes, spread=["id"]).collect()}
    assert got == {1: ("local", "m1"), 2: ("cloud", "m2"), 3: (routing.QUARANTINE, None), 4: (routing.QUARANTINE, None)}
    calls = spark.createDataFrame([(1, "gpt-4o-mini", 1000), (2, "gpt-4o", 333), (3, "free", 9), (4, None, 9), (5, "gpt-4o", None)], "id INT, model STRING, tokens BIGINT")
    prices = spark.createDataFrame([(m, *pair) for m, pair in N.PRICES.items()], "model STRING, price_in DECIMAL(12,6), price_out DECIMAL(12,6)")
    listed = {r["id"]: r["cost_usd"] for r in accounting.price_calls(calls).collect()}
    assert {r["id"]: r["cost_usd"] for r in accounting.price_calls(calls, prices=prices, spread=["id"]).collect()} == listed


def test_judge_sees_what_the_mode_allows(spark):
    rows = [
        ("e", "m", "expected", "c", "task", "out", "ref"), ("o", "m", "criteria_only", "c", "task", "out", "ref"),
        ("x", "m", "execution", "c", "task", "out", "ref"), ("b", "m", "expected", "c", "task", " \t", "ref"),
        ("n", "m", "expected", "", "task", "out", "ref"), ("u", "m", None, "c", "task", "out", None),
    ]
    answers = spark.createDataFrame(rows, "task_id STRING, model STRING, scoring_mode STRING, criteria STRING, description STRING, output STRING, expected_output STRING")
    got = {r["task_id"]: r for r in scoring.judge_inputs(answers).collect()}
    assert set(got) == {"e", "o", "u"}
    assert got["e"]["expected_output"] == "ref" and got["o"]["expected_output"] is None and got["e"]["input"] == "task"
    gated = scoring.judge_gate(answers, output=F.col("output"), criteria=F.col("criteria"), raw_score=F.lit(0.7), mode=F.col("scoring_mode"))
    scores = {r["task_id"]: (r["score"], r["judge_reason"]) for r in gated.collect()}
    assert scores["x"] == (None, None) and scores["b"] == (0.0, "no output") and scores["n"] == (None, "no criteria") and scores["o"] == (0.7, None)


def test_code_gate_takes_bounded_batches_and_keeps_ids(spark):
    """Ids beyond 2**53 beside a missing one come back as they are; long texts reach Python a few at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 * 1024 * 1024))
    try:
        long = "def f():\n    return '" + "x" * 3_000_000 + "'"
        rows = [(None, "f = lambda: 1"), (2**53 + 1, "x = 1"), (2**53 + 3, "x = ("), (4, long), (5, long), (6, None)]
        got = inference.code_gate(spark.createDataFrame(rows, "id BIGINT, code STRING").coalesce(1), "id", "code")
        assert got.schema.simpleString() == "struct<id:bigint,passed:boolean,method:string>"
        found = {r["id"]: (r["passed"], r["method"].split(":")[0]) for r in got.collect()}
        assert int(spark.conf.get(name)) <= inference.CODE_BYTES
    finally:
        spark.conf.set(name, before)
    good, none = (True, "parsed, defines a callable"), (False, "parsed, no callable")
    assert found == {None: good, 2**53 + 1: none, 2**53 + 3: (False, "parse failed"), 4: good, 5: good, 6: none}
