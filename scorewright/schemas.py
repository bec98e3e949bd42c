"""Schemas of the tables an evaluation works on, and the default thresholds."""

from __future__ import annotations

# Default thresholds.
PASS_THRESHOLD = 0.5
ESCALATION_THRESHOLD = 0.5
MIN_ANSWER_CHARS = 20
MIN_PLAIN_ANSWER_CHARS = 30
REASON_CHARS = 500
PREVIEW_CHARS = 300

TASK = (
    "task_id STRING, category STRING, agent STRING, description STRING, input_type STRING, "
    "input_refs ARRAY<STRING>, inline_input STRING, scoring_mode STRING, criteria STRING, "
    "expected_output STRING"
)
RESPONSE = (
    "prompt_sha STRING, model STRING, output STRING, tokens BIGINT, latency_s DOUBLE, error STRING"
)
JUDGEMENT = "task_id STRING, model STRING, raw_score DOUBLE, reason STRING"
RESULT = (
    "run_time TIMESTAMP, system STRING, model STRING, task_id STRING, category STRING, agent STRING, "
    "success BOOLEAN, score DOUBLE, escalated BOOLEAN, local_score DOUBLE, latency_s DOUBLE, "
    "cloud_calls INT, cost_usd DECIMAL(18,6), data_kb DECIMAL(18,3), score_method STRING, "
    "judge_reason STRING, total_latency_s DOUBLE"
)
LOG_EVENT = (
    "ts TIMESTAMP_NTZ, level STRING, component STRING, message STRING, is_continuation BOOLEAN"
)
PLAN_ITEM = "ARRAY<STRUCT<task_id: STRING, agent: STRING>>"
