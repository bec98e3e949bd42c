"""Inputs, files, history and the whole run."""

from __future__ import annotations

import base64
import random
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scorewright import scale, schemas
from scorewright.operators import inference, packing, report
from scorewright.plans.run import evaluate
from scorewright.sources import files, history, tasks

BANK = [
    ("T1", "A - File/Log Analysis", "file_agent", "List the errors", "log", ["logs/a.log"], None, "expected", "names errors", "relay refused twice"),
    ("T2", "G - Complex Multi-Step", "file_agent", "Compare the logs", "multi", ["logs/a.log", "logs/b.log"], None, "expected", "compares", "both fail"),
    ("T3", "G - Complex Multi-Step", "file_agent", "Compare three", "multi", ["logs/a.log", "logs/none.log", "logs/b.log"], None, "expected", "compares", "x"),
    ("T4", "B - Code Generation", "code_agent", "Write a sorter", "none", None, "", "execution", None, None),
    ("T5", "B - Code Generation", "code_agent", "Write a parser", "none", None, "", "execution", None, None),
    ("T6", "C - Planning", "planning_agent", "Plan a move", "text", None, "two floors", "criteria_only", None, None),
    ("T7", "E - Multimodal", "multimodal_agent", "Describe", "image", ["img/x.png"], None, "expected", "describes", "a red box"),
    ("T8", "C - Planning", "ghost_agent", "Plan", "text", None, "x", "criteria_only", None, None),
]
ANSWERS = {
    "List the errors": "the relay refused twice", "Compare the logs": "no idea", "Write a sorter": "def f(:",
    "Write a parser": "```python\ndef p(s):\n    return ‘s’ and 1\n```", "Plan a move": "First pack, then carry, then rest.",
    "Describe": "a red box",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in {"logs/a.log": "relay refused\nrelay refused\n", "logs/b.log": "ok\n", "img/x.png": "png"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def found_files(spark, folder):
    return files.read_inputs(spark, folder)


def test_whole_texts(spark, folder):
    got = {r["ref"]: (r["text"], r["n_bytes"]) for r in found_files(spark, folder).collect()}
    assert got == {
        "logs/a.log": ("relay refused\nrelay refused\n", 28), "logs/b.log": ("ok\n", 3),
        "img/x.png": ("data:image/png;base64,cG5n", 3),
    }


def test_manifest(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(b"\x00\x01")
    (tmp_path / "b.png").write_bytes(b"123456")
    got = {r["mime"]: r["base64"] for r in files.binary_manifest(spark, str(tmp_path)).collect()}
    assert got == {"image/jpeg": base64.b64encode(b"\x00\x01").decode(), "image/png": base64.b64encode(b"123456").decode()}


def test_csv_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount\n1,2.50\nx,y\n3,\n")
    rows = files.read_csv(spark, str(tmp_path), "id INT, amount DECIMAL(9,2)").cache().collect()
    assert [r["id"] for r in rows] == [1, None, 3] and rows[1]["_corrupt"] == "x,y" and rows[2]["amount"] is None


def bank(spark):
    return spark.createDataFrame(BANK, schemas.TASK)


def test_inputs(spark, folder):
    got = {r["task_id"]: r for r in tasks.resolve_inputs(bank(spark), found_files(spark, folder)).collect()}
    assert len(got) == len(BANK)
    assert got["T1"]["input_text"].startswith("relay refused")
    assert got["T2"]["input_text"] == "=== FILE: logs/a.log ===\nrelay refused\nrelay refused\n\n\n=== FILE: logs/b.log ===\nok\n"
    assert not got["T3"]["input_found"] and got["T3"]["missing_ref"] == "logs/none.log" and got["T3"]["input_text"] is None
    assert got["T4"]["input_found"] and got["T4"]["input_text"] == "" and got["T6"]["input_text"] == "two floors"
    assert got["T7"]["input_text"].startswith("data:image/png") and got["T7"]["input_bytes"] == 3


def test_concat_in_parts(spark):
    pieces = spark.createDataFrame([("g", i, f"n{i}", f"t{i}") for i in (2, 0, 1)], "g STRING, pos BIGINT, name STRING, text STRING")
    whole = tasks.concat_labelled(pieces, "g", "pos", "name", "text").first()["text"]
    assert whole == "\n\n".join(f"=== FILE: n{i} ===\nt{i}" for i in range(3))
    parts = tasks.concat_labelled(pieces, "g", "pos", "name", "text", max_bytes=2 * len("=== FILE: n0 ===\nt0\n\n")).orderBy("part").collect()
    assert len(parts) == 2 and "\n\n".join(p["text"] for p in parts) == whole


def test_packing_bounds_every_part(spark):
    """Sizes that fit exactly, are longer than a part, zero or unknown; a group that holds most pieces."""
    chance = random.Random(8)
    rows = [(g, i, chance.choice([0, 1, 3, 10, 25, 40, 41, 100, None])) for g, n in (("hot", 900), ("b", 40), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g STRING, at INT, size INT")
    packed = packing.pack(df, ["g"], ["at"], "size", max_bytes=40).collect()
    assert sorted((str(r["g"]), r["at"], str(r["size"])) for r in packed) == sorted((str(g), at, str(size)) for g, at, size in rows)
    for group in ("hot", "b", None):
        own = sorted((r["at"], r["part"], r["size"] or 0) for r in packed if r["g"] == group)
        assert [part for _, part, _ in own] == sorted(part for _, part, _ in own)
        for part in {part for _, part, _ in own}:
            sizes = [size for _, p, size in own if p == part]
            assert sum(sizes) <= 40 or len([s for s in sizes if s]) == 1
    with pytest.raises(ValueError):
        packing.pack(df, ["g"], ["at"], "size", max_bytes=0)


def test_killed_run_repeats_one_bucket(spark, tmp_path):
    store, calls = str(tmp_path / "r"), tmp_path / "calls"
    prompts = spark.createDataFrame([(f"s{i}", "m", f"p{i}") for i in range(60)], "prompt_sha STRING, model STRING, prompt STRING")
    bucket = {r["prompt"]: r["b"] for r in prompts.select("prompt", F.pmod(F.xxhash64("prompt_sha", "model"), F.lit(6)).alias("b")).collect()}
    doomed = max(p for p, b in bucket.items() if b == 3)

    class Killed(BaseException):
        pass

    def model(die):
        def call(prompt, name):
            if die and prompt == doomed:
                raise Killed("machine lost")
            with open(calls, "a") as out:
                out.write(prompt + "\n")
            return prompt.upper(), 1

        return call

    with pytest.raises(Exception, match="machine lost"):
        inference.call_model(prompts, model(True), store, parallel_calls=2, rounds=6)
    done = {r["prompt_sha"].replace("s", "p") for r in spark.read.parquet(store).collect()}
    assert done == {p for p, b in bucket.items() if b < 3}
    got = inference.call_model(prompts, model(False), store, parallel_calls=2, rounds=6)
    assert {r["output"] for r in got.collect()} == {f"P{i}" for i in range(60)}
    made = Counter(calls.read_text().split())
    assert {p for p, n in made.items() if n > 1} <= {p for p, b in bucket.items() if b == 3} and max(made.values()) <= 2
    before = calls.read_text()
    assert inference.call_model(prompts, model(False), store, parallel_calls=2, rounds=6).count() == 60 and calls.read_text() == before


def test_run_end_to_end(spark, folder, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store"))

    def local_model(prompt, model):
        for description, output in ANSWERS.items():
            if description in prompt:
                return output, 0
        raise RuntimeError("model is down")

    def cloud_model(prompt, model):
        if "Write a sorter" in prompt:
            raise RuntimeError("quota")
        return "both logs fail", 1000

    results = evaluate(
        bank(spark),
        found_files(spark, folder),
        answer=lambda p: inference.call_model(p, local_model, f"{store}/responses", parallel_calls=2),
        escalate=lambda p: inference.call_model(p, cloud_model, f"{store}/responses", parallel_calls=2),
        keywords={"T6": ["carry"]},
    ).cache()
    got = {r["task_id"]: r for r in results.collect()}
    assert len(got) == len(BANK)
    assert got["T1"]["success"] and not got["T1"]["escalated"] and got["T1"]["score"] == 0.857
    assert got["T2"]["escalated"] and got["T2"]["local_output"] == "no idea" and got["T2"]["local_score"] == 0.0
    assert got["T2"]["output"] == "both logs fail" and got["T2"]["score"] == 0.8 and got["T2"]["cost_usd"] == Decimal("0.000330")
    assert got["T2"]["cloud_calls"] == 1 and got["T2"]["data_kb"] > 0
    assert got["T3"]["success"] is None and got["T3"]["output"].startswith("[SKIPPED]")
    assert got["T4"]["success"] is False and not got["T4"]["escalated"] and got["T4"]["error"] == "no second-tier answer"
    assert got["T5"]["success"] and got["T5"]["score"] is None and got["T5"]["output"].startswith("def p")
    assert got["T6"]["success"] and got["T6"]["score_method"] == "heuristic (keyword match)"
    assert got["T7"]["success"] and got["T7"]["cloud_calls"] == 1 and not got["T7"]["escalated"]
    assert got["T8"]["success"] is None and "unknown agent" in got["T8"]["output"]

    summary = report.run_summary(results).first()
    assert (summary["n_tasks"], summary["n_scored"], summary["n_passed"]) == (8, 6, 5)

    path = f"{store}/history"
    for system in ("hybrid", "again"):
        history.append_results(history.tag_run(results, system, "qwen2.5:3b"), path)
    kept = history.read_results(spark, path)
    assert kept.count() == 16 and kept.groupBy("system").agg(F.countDistinct("run_time").alias("n")).where("n <> 1").count() == 0


def test_calls_are_not_repeated(spark, tmp_path):
    store, marks = str(tmp_path / "r"), tmp_path / "calls"
    prompts = spark.createDataFrame([("a", "m", "x"), ("a", "m", "x"), ("b", "m", "y")], "prompt_sha STRING, model STRING, prompt STRING")

    def model(prompt, name):
        with open(marks, "a") as out:
            out.write(prompt)
        if prompt == "y" and len(marks.read_text()) < 3:
            raise ValueError("no y")
        return prompt * 2, 7

    first = {r["prompt_sha"]: r for r in inference.call_model(prompts, model, store, parallel_calls=2).collect()}
    again = {r["prompt_sha"]: r for r in inference.call_model(prompts, model, store, parallel_calls=2).collect()}
    third = inference.call_model(prompts, model, store, parallel_calls=2)
    assert third.count() == 2 and sorted(marks.read_text()) == ["x", "y", "y"]
    assert again["b"]["output"] == "yy" and again["b"]["error"] is None
    assert first["a"]["output"] == "xx" and first["b"]["output"] == "" and first["b"]["error"] == "no y"


def test_modes(spark, folder):
    def replies(p):
        return p.select("prompt_sha", "model", F.lit("a red box").alias("output"), F.lit(100).cast("bigint").alias("tokens"),
                        F.lit(0.5).alias("latency_s"), F.lit(None).cast("string").alias("error"))

    cloud = evaluate(bank(spark), found_files(spark, folder), answer=replies, mode="cloud_only").collect()
    costs = {r["task_id"]: r["cost_usd"] for r in cloud}
    assert costs["T1"] == Decimal("0.000033") and costs["T7"] == Decimal("0.000550") and costs["T3"] == 0
    local = evaluate(bank(spark), found_files(spark, folder), answer=replies, mode="local_only").collect()
    assert {r["task_id"] for r in local if r["cloud_calls"]} == {"T7"} and not any(r["escalated"] for r in local)


def test_recorded_judgements(spark, folder):
    def replies(p):
        return p.select("prompt_sha", "model", F.lit("some longer answer text").alias("output"), F.lit(0).cast("bigint").alias("tokens"),
                        F.lit(0.5).alias("latency_s"), F.lit(None).cast("string").alias("error"))

    judged = spark.createDataFrame(
        [("T1", "qwen2.5:3b", 0.4996, "close"), ("T2", "qwen2.5:3b", 0.2, "poor"), ("T2", "gpt-4o-mini", 0.9, "good"),
         ("T2", "gpt-4o-mini", 0.7, "fair")], schemas.JUDGEMENT
    )
    got = {r["task_id"]: r for r in evaluate(bank(spark), found_files(spark, folder), answer=replies, escalate=replies, judgements=judged).collect()}
    assert (got["T1"]["score"], got["T1"]["success"], got["T1"]["escalated"], got["T1"]["judge_reason"]) == (0.5, False, False, "close")
    assert (got["T2"]["score"], got["T2"]["escalated"], got["T2"]["local_score"], got["T2"]["judge_reason"]) == (0.9, True, 0.2, "good")
    assert (got["T2"]["latency_s"], got["T2"]["total_latency_s"]) == (0.5, 1.0)
    assert got["T1"]["total_latency_s"] == 0.5 and got["T3"]["total_latency_s"] == 0.0


def test_failed_second_call_takes_time(spark, folder):
    def replies(failed):
        return lambda p: p.select(
            "prompt_sha", "model", F.lit("a short but plain answer").alias("output"), F.lit(0).cast("bigint").alias("tokens"),
            F.lit(0.5).alias("latency_s"), F.lit("quota" if failed else None).cast("string").alias("error"))

    judged = spark.createDataFrame([("T2", "qwen2.5:3b", 0.2, "poor")], schemas.JUDGEMENT)
    keywords = spark.createDataFrame([("T6", ["plain"])], "key STRING, terms ARRAY<STRING>")
    run = evaluate(bank(spark), found_files(spark, folder), answer=replies(False), escalate=replies(True), judgements=judged, keywords=keywords)
    got = {r["task_id"]: r for r in run.collect()}
    assert not got["T2"]["escalated"] and got["T2"]["score"] == 0.2 and got["T2"]["error"] == "no second-tier answer"
    assert (got["T2"]["latency_s"], got["T2"]["total_latency_s"]) == (0.5, 1.0)
    assert got["T6"]["score_method"] == "heuristic (keyword match)"


def test_second_model_has_its_own_prompt(spark, folder):
    """Prompts by tier, a judge that is shown what the mode allows, criteria scored by their terms."""
    seen = []

    def replies(prompts):
        seen.extend((r["model"], r["prompt"]) for r in prompts.collect())
        return prompts.select(
            "prompt_sha", "model", F.lit("pack first, then carry the boxes out").alias("output"), F.lit(10).cast("bigint").alias("tokens"),
            F.lit(0.5).alias("latency_s"), F.lit(None).cast("string").alias("error"))

    shown = []

    def judge(cases):
        shown.extend(cases.collect())
        return cases.select("task_id", "model", F.lit(0.3).alias("raw_score"), F.lit("thin").alias("reason"))

    with_criteria = bank(spark).withColumn("criteria", F.coalesce("criteria", F.when(F.col("task_id") == "T6", F.lit("has steps"))))
    got = {r["task_id"]: r for r in evaluate(with_criteria, found_files(spark, folder), answer=replies, escalate=replies, judge=judge).collect()}
    first = {p for m, p in seen if m == "qwen2.5:3b"}
    second = {p for m, p in seen if m == "gpt-4o-mini"}
    assert first and second and not first & second
    assert any("smaller model" in p and "List the errors" in p and "relay refused" in p for p in second)
    assert any("without explanation" in p and "Write a sorter" in p for p in second) and not any("smaller model" in p for p in first)
    assert got["T1"]["score"] == 0.3 and got["T1"]["judge_reason"] == "thin" and got["T1"]["escalated"]
    modes = {(r["task_id"], r["expected_output"]) for r in shown}
    assert ("T1", "relay refused twice") in modes and ("T6", None) in modes and not any(i in ("T4", "T5") for i, _ in modes)
    terms = spark.createDataFrame([("T6", ["pack", "carry", "sweep", "boxes"])], "key STRING, terms ARRAY<STRING>")
    scored = evaluate(with_criteria, found_files(spark, folder), answer=replies, mode="local_only", criteria_terms=terms).collect()
    plan = {r["task_id"]: r for r in scored}["T6"]
    assert (plan["score"], plan["success"], plan["score_method"]) == (0.75, True, "judge (criteria_only)")


def test_history_keeps_both_latencies(spark, tmp_path):
    row = spark.createDataFrame([("t", 0.5, 2.25)], "task_id STRING, latency_s DOUBLE, total_latency_s DOUBLE")
    full = row.withColumns({c: F.lit(None) for c in history.COLUMNS if c not in ("task_id", "latency_s", "run_time", "system", "model")})
    tagged = history.tag_run(full, "s", "m")
    history.append_results(tagged, str(tmp_path / "table"))
    assert history.read_results(spark, str(tmp_path / "table")).first()["total_latency_s"] == 2.25
    history.export_csv(tagged, str(tmp_path / "csv"))
    assert history.read_history(spark, [str(tmp_path / "csv")]).first()["latency_s"] == 0.5
    assert history.tag_run(full.drop("total_latency_s"), "s", "m").first()["total_latency_s"] == 0.5


def test_inputs_are_listed_by_name(spark, folder):
    (Path(folder) / "img" / "Y.JPeG").write_bytes(b"12")
    (Path(folder) / "img" / "png").write_text("no extension")
    got = {r["ref"]: r["text"] for r in files.read_inputs(spark, folder).collect()}
    assert got["img/Y.JPeG"] == "data:image/jpeg;base64,MTI=" and got["img/png"] == "no extension" and len(got) == 5


def test_history_layouts(spark, tmp_path):
    (tmp_path / "early").mkdir()
    (tmp_path / "now").mkdir()
    (tmp_path / "early" / "r.csv").write_text(
        ",".join(history.EARLY_COLUMNS) + "\n"
        "2025-01-02 03:04:05,trial,small,A1,A-File/Log,file_agent [LOCAL],True,0.9,True,0.2,0.5,1,0.000336,1.212,judge (0.9)\n"
        "2025-01-02 03:04:05,trial,small,G1,G - Complex Multi-Step,file_agent,,,False,,0.0,0,0.0,0.0,\n"
    )
    (tmp_path / "now" / "r.csv").write_text(
        ",".join(history.COLUMNS) + "\n"
        '2025-02-02 03:04:05,hybrid,large,A1,A - File/Log Analysis,file_agent,False,0.1,False,,0.5,0,0.0,0.0,judge (0.1),"weak, ""vague"""\n'
    )
    got = history.read_history(spark, [str(tmp_path / "now"), str(tmp_path / "early")]).orderBy("run_time", "task_id").collect()
    assert [r["category"] for r in got] == ["A - File/Log Analysis", "G - Complex Multi-Step", "A - File/Log Analysis"]
    assert {r["agent"] for r in got} == {"file_agent"}
    assert got[0]["cost_usd"] == Decimal("0.000336") and got[0]["local_score"] == 0.2 and got[0]["judge_reason"] is None
    assert got[1]["success"] is None and got[1]["score"] is None
    assert got[2]["judge_reason"] == 'weak, "vague"' and got[2]["run_time"] == datetime(2025, 2, 2, 3, 4, 5)
    assert history.read_history(spark, []).count() == 0
    assert history.read_history(spark, [str(tmp_path / "early")]).where("judge_reason IS NULL").count() == 2


def test_mixed_history_file(spark, tmp_path):
    """One file: early header, early and current records, a later header, and lines that are no record."""
    start = "2025-03-01 10:00:00,swarm,tiny,"
    (tmp_path / "r.csv").write_text(
        ",".join(history.EARLY_COLUMNS) + "\n"
        + start + "A1,A-File/Log,file_agent [LOCAL],True,0.9,False,,0.5,0,0.0,0.0,keyword\n"
        + start + 'A2,B-Code,code_agent,False,0.1,True,0.05,1.5,1,0.25,2.5,"judge, strict","says ""no"", twice"\r\n'
        + "\n" + ",".join(history.COLUMNS) + "\n"
        + start + "A3,C,planner,True,high,False,,0.5,0,0.0,0.0,keyword,kept nowhere\n"
        + start + "A4,C,planner,True,0.5,False,,0.5,0,0.0,0.0,keyword,fine,one too many\n"
        + "garbage\n"
        + "yesterday,swarm,tiny,A5,C,planner,True,0.5,False,,0.5,0,0.0,0.0,keyword,bad time\n"
        + start + "A6,C,planner,,,False,,0.5,0,0.0,0.0,,\n"
        + start + 'A7,C,planner,True,0.5,False,,0.5,0,0.0,0.0,"key ""word""","' + 'a long, ""quoted"" reason, ' * 20_000 + '"\n'
    )
    lines = history.read_history_lines(spark, [str(tmp_path / "r.csv")])
    got = {r["task_id"]: r for r in history.history_records(lines).collect()}
    assert set(got) == {"A1", "A2", "A6", "A7"}
    assert got["A7"]["judge_reason"] == 'a long, "quoted" reason, ' * 20_000 and got["A7"]["score_method"] == 'key "word"'
    assert got["A1"]["judge_reason"] is None and got["A1"]["agent"] == "file_agent"
    assert got["A2"]["judge_reason"] == 'says "no", twice' and got["A2"]["score_method"] == "judge, strict"
    assert got["A2"]["cost_usd"] == Decimal("0.25") and got["A6"]["success"] is None
    bad = {r["line"].split(",")[3] if "," in r["line"] else r["line"]: r for r in files.quarantine(lines).collect()}
    assert {k: r["reason"] for k, r in bad.items()} == {
        "A3": "unreadable value", "A4": "17 fields", "garbage": "1 fields", "A5": "unreadable value"
    }
    assert all(r["path"].endswith("/r.csv") for r in bad.values()) and bad["A4"]["line"].endswith("one too many")


def test_tag_keeps_whole_reasons_on_one_line(spark):
    row = spark.createDataFrame([("t", "line\n" * 200)], "task_id STRING, judge_reason STRING")
    full = row.withColumns({c: F.lit(None) for c in history.COLUMNS if c not in ("task_id", "judge_reason", "run_time", "system", "model")})
    got = history.tag_run(full, "s", "m").first()
    assert len(got["judge_reason"]) == 1000 and "\n" not in got["judge_reason"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_files_no_task_names_do_not_move(spark, monkeypatch, broadcast):
    """The texts of files without a task are left out before the shuffle; with too many names nothing changes but that."""
    if not broadcast:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    bank = spark.createDataFrame(
        [("a", "document", ["f1"], None), ("b", "multi", ["f2", "f1"], None), ("c", "multi", ["f1", "gone"], None), ("d", "text", None, "inline")],
        "task_id STRING, input_type STRING, input_refs ARRAY<STRING>, inline_input STRING",
    )
    files = spark.createDataFrame([(f"f{i}", f"text {i}", 6) for i in range(500)], "ref STRING, text STRING, n_bytes BIGINT")
    got = tasks.resolve_inputs(bank, files)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftSemi" in plan) == broadcast
    found = {r["task_id"]: (r["input_text"], r["input_found"], r["missing_ref"]) for r in got.collect()}
    assert found == {
        "a": ("text 1", True, None), "c": (None, False, "gone"), "d": ("inline", True, None),
        "b": ("=== FILE: f2 ===\ntext 2\n\n=== FILE: f1 ===\ntext 1", True, None),
    }
