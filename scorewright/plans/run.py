"""A whole evaluation run: inputs, routing, answers, scores, cascade, cost, results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright import schemas
from scorewright.functions import numbers as N
from scorewright.functions import text as T
from scorewright.operators import cascade, inference, routing, scoring
from scorewright.scale import materialize
from scorewright.sources import tasks as task_source

Answerer = Callable[[DataFrame], DataFrame]
SECOND = "second"


#: Added to the prompt of a task whose answer is checked as code.
CODE_ONLY = "\n\nAnswer with code that runs as it is, without explanation, fences or typographic quotes."


def default_templates() -> dict[str, list[str | Column]]:
    """Description and input under plain headings, for the first model, the cloud, and the second model after a weak answer."""
    code = F.when(F.col("scoring_mode") == "execution", F.lit(CODE_ONLY))
    task = ["Task: ", F.col("description"), code, "\n\nInput:\n", F.col("input_text")]
    return {
        "local": ["Task: ", F.col("description"), "\n\nInput:\n", F.col("input_text")],
        "cloud": [*task, "\n\nUse nothing but this input."],
        SECOND: ["A smaller model answered this task poorly. Answer it fully and with care.\n\n", *task],
    }


@dataclass(frozen=True)
class Scoring:
    """Where scores come from."""

    judgements: DataFrame | None
    judge: Answerer | None
    keywords: Mapping[str, Sequence[str]] | DataFrame
    criteria_terms: Mapping[str, Sequence[str]] | DataFrame
    pass_threshold: float


def evaluate(
    bank: DataFrame,
    files: DataFrame,
    *,
    answer: Answerer,
    escalate: Answerer | None = None,
    judgements: DataFrame | None = None,
    keywords: Mapping[str, Sequence[str]] | DataFrame | None = None,
    judge: Answerer | None = None,
    criteria_terms: Mapping[str, Sequence[str]] | DataFrame | None = None,
    templates: Mapping[str, Sequence[str | Column]] | DataFrame | None = None,
    default: Sequence[str | Column] | Mapping[str, Sequence[str | Column]] | None = None,
    routes: Sequence[tuple[str, str, str]] | DataFrame = routing.ROUTES,
    mode: str = "hybrid",
    second_model: str = "gpt-4o-mini",
    pass_threshold: float = schemas.PASS_THRESHOLD,
    escalation_threshold: float = schemas.ESCALATION_THRESHOLD,
) -> DataFrame:
    """Run a task bank and return one result per task, ready for :func:`history.tag_run`.

    ``answer`` and ``escalate`` take prompts (``prompt_sha, model, prompt``) and return responses
    keyed by prompt and model: recorded ones, or those of :func:`inference.call_model`. ``judgements``
    holds recorded scores per (task_id, model); ``judge`` makes them instead, from the cases of
    :func:`scoring.judge_inputs`. Without either, tasks with a reference answer are scored by word F1, tasks
    scored by criteria alone by the share of their ``criteria_terms`` in the answer, and the others by the
    keyword rule. ``keywords`` and ``criteria_terms`` map task ids to terms, as a mapping or a table (see
    :func:`scoring.with_terms`).

    ``templates`` and ``default`` are those of :func:`routing.render_prompts`. The second model gets a prompt of
    its own, from the tier ``second``: the first model's would not tell it what is wanted of it.

    ``latency_s`` is that of the first answer, ``total_latency_s`` adds the call to the second model,
    whether it gave an answer or failed.

    Tasks whose input is missing keep their row with success NULL. In hybrid mode local answers
    below the threshold go to ``second_model``; only their prompts reach ``escalate``. First-tier
    results are stored before that, so no call is repeated by a later step.
    """
    resolved = task_source.resolve_inputs(bank, files)
    routed = routing.route(resolved, mode=mode, routes=routes, spread=["task_id"])

    def rendered(rows: DataFrame) -> DataFrame:
        given = {} if templates is None else templates
        return routing.render_prompts(rows, given, default=default or default_templates(), spread=["task_id"])

    prompted = materialize(rendered(routed), "prompts")
    scored_by = Scoring(judgements, judge, {} if keywords is None else keywords, {} if criteria_terms is None else criteria_terms, pass_threshold)
    runnable = F.col("input_found") & (F.col("tier") != routing.QUARANTINE)

    first = materialize(
        _answered(prompted.where(runnable), answer, scored_by), "first-tier"
    )
    in_cloud = F.col("tier") == "cloud"
    first = first.withColumns(
        {
            "first_calls": in_cloud.cast("int"),
            "first_cost": F.when(in_cloud, N.call_cost(F.col("tokens"), F.col("model"))).otherwise(F.lit(0)).cast("decimal(18,6)"),
            "first_kb": F.when(in_cloud, N.size_kb(F.coalesce("input_bytes", F.lit(0)))).otherwise(F.lit(0)).cast("decimal(18,3)"),
        }
    )
    if mode == "hybrid" and escalate is not None:
        results = _cascaded(first, escalate, rendered, scored_by, second_model, escalation_threshold)
    else:
        none = F.lit(None)
        results = first.withColumns(
            {
                "escalated": F.lit(False), "local_score": none.cast("double"), "local_output": none.cast("string"),
                "second_calls": F.lit(0), "second_cost": F.lit(0).cast("decimal(18,6)"),
                "second_kb": F.lit(0).cast("decimal(18,3)"), "total_latency_s": F.col("latency_s"),
            }
        )
    done = results.select(
        "task_id", "category", "agent", "success", "score", "escalated", "local_score", "latency_s",
        (F.col("first_calls") + F.col("second_calls")).alias("cloud_calls"),
        (F.col("first_cost") + F.col("second_cost")).cast("decimal(18,6)").alias("cost_usd"),
        (F.col("first_kb") + F.col("second_kb")).cast("decimal(18,3)").alias("data_kb"),
        "score_method", "judge_reason", "output", "local_output", "error", "total_latency_s",
    )
    return done.unionByName(_not_run(prompted.where(~runnable), done))


def _not_run(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Tasks without input or route, as results without success."""
    why = F.when(~F.col("input_found"), F.concat(F.lit("missing input file: "), F.coalesce("missing_ref", F.lit("?")))).otherwise(
        F.concat(F.lit("unknown agent: "), F.col("agent"))
    )
    known = {
        "task_id": F.col("task_id"), "category": F.col("category"), "agent": F.col("agent"),
        "escalated": F.lit(False), "latency_s": F.lit(0.0), "total_latency_s": F.lit(0.0), "cloud_calls": F.lit(0), "cost_usd": F.lit(0),
        "data_kb": F.lit(0), "score_method": F.lit(""), "output": F.concat(F.lit(task_source.SKIP_MARK + " "), why), "error": why,
    }
    return rows.select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    )


def _answered(prompted: DataFrame, answer: Answerer, scored_by: Scoring) -> DataFrame:
    """Attach answers and score them."""
    responses = answer(prompted.select("prompt_sha", "model", "prompt"))
    replied = inference.replay(prompted, responses, spread=["task_id"], keys=("prompt_sha", "model"))
    is_code = F.col("scoring_mode") == "execution"
    replied = replied.withColumn(
        "output", F.when(is_code, T.plain_quotes(T.first_code_block(F.col("output")))).otherwise(F.col("output"))
    )
    return _scored(replied, scored_by)


def _judged(stored: DataFrame, scored_by: Scoring) -> DataFrame:
    """(task_id, _judged, _reason): recorded or made judgements, else what stands in for them."""
    judgements = scored_by.judgements
    if judgements is None and scored_by.judge is not None:
        judgements = scored_by.judge(scoring.judge_inputs(stored))
    if judgements is not None:
        # Of several judgements of one answer the highest counts, then the last reason in order.
        wanted = judgements.join(stored.select("task_id", "model"), ["task_id", "model"], "left_semi")
        best = wanted.groupBy("task_id", "model").agg(F.max(F.struct("raw_score", "reason")).alias("_best"))
        return best.select("task_id", F.col("_best.raw_score").alias("_judged"), F.col("_best.reason").alias("_reason"))
    no_reason = F.lit(None).cast("string").alias("_reason")
    compared = stored.where((F.col("scoring_mode") == "expected") & F.col("expected_output").isNotNull())
    judged = scoring.token_f1(compared, ["task_id"], {"f1": "output"}, "expected_output").select(
        "task_id", F.col("f1_raw").alias("_judged"), no_reason
    )
    open_ended = stored.where(F.col("scoring_mode") == "criteria_only").select("task_id", "output")
    worded = scoring.with_terms(open_ended, "task_id", scored_by.criteria_terms, "_terms", spread=["task_id"])
    covered = scoring.coverage(worded.where(F.size("_terms") > 0), "output", F.col("_terms"))
    return judged.unionAll(covered.select("task_id", F.try_divide("n_present", "n_terms").alias("_judged"), no_reason))


def _scored(replied: DataFrame, scored_by: Scoring) -> DataFrame:
    """Add ``raw_score, score, success, score_method, judge_reason`` by the task's scoring mode."""
    stored = materialize(replied, "answers")
    code = inference.code_gate(stored.where(F.col("scoring_mode") == "execution"), "task_id", "output").select(
        "task_id", F.col("passed").alias("_executes"), F.col("method").alias("_code_method")
    )
    joined = stored.join(code, "task_id", "left").join(_judged(stored, scored_by), "task_id", "left")
    gated = scoring.judge_gate(
        joined, output=F.col("output"), criteria=F.col("criteria"), raw_score=F.col("_judged"),
        reason=F.col("_reason"), mode=F.col("scoring_mode"), threshold=scored_by.pass_threshold,
    )
    worded = scoring.with_terms(gated, "task_id", scored_by.keywords, "_keywords", spread=["task_id"])
    scored = scoring.dispatch(
        worded, mode=F.col("scoring_mode"), output=F.col("output"),
        keywords=F.col("_keywords"), executes=F.col("_executes"),
        judged=F.col("raw_score"), threshold=scored_by.pass_threshold,
    )
    method = F.when(F.col("scoring_mode") == "execution", F.col("_code_method")).otherwise(F.col("score_method"))
    reason = F.when(F.col("score").isNotNull(), F.col("judge_reason"))
    return scored.withColumns({"score_method": method, "judge_reason": reason}).drop(
        "_executes", "_code_method", "_judged", "_reason", "_keywords", "passed"
    )


def _cascaded(
    first: DataFrame,
    escalate: Answerer,
    rendered: Callable[[DataFrame], DataFrame],
    scored_by: Scoring,
    second_model: str,
    escalation_threshold: float,
) -> DataFrame:
    """Send weak local answers to the second model and take its answer and score instead."""
    weak = cascade.needs_escalation(
        F.col("score"), F.col("success"), threshold=escalation_threshold, exempt=F.col("tier") == "cloud"
    )
    scored_columns = ["output", "tokens", "latency_s", "error", "raw_score", "score", "success", "score_method", "judge_reason"]
    to_second = first.where(weak).drop(*scored_columns, "first_calls", "first_cost", "first_kb", "prompt", "prompt_sha")
    to_second = to_second.withColumns({"model": F.lit(second_model), "tier": F.lit(SECOND)})
    second = _answered(rendered(to_second), escalate, scored_by)
    got = F.col("_output2").isNotNull()
    answered = F.col("error").isNull()
    taken = second.select(
        "task_id",
        F.col("latency_s").alias("_latency_s2"),
        *[F.when(answered, F.col(c)).alias(f"_{c}2") for c in ("output", "tokens", "raw_score", "score", "success", "score_method", "judge_reason")],
    )
    joined = first.join(taken, "task_id", "left")
    replaced = {
        c: F.when(got, F.col(f"_{c}2")).otherwise(F.col(c))
        for c in ("output", "raw_score", "score", "success", "score_method", "judge_reason")
    }
    kept = joined.withColumns(
        {
            "escalated": got,
            "total_latency_s": F.coalesce("latency_s", F.lit(0.0)) + F.coalesce("_latency_s2", F.lit(0.0)),
            "local_score": F.when(got, F.col("score")),
            "local_output": F.when(got, F.col("output")),
            "second_calls": got.cast("int"),
            "second_cost": F.when(got, N.call_cost(F.col("_tokens2"), F.lit(second_model))).otherwise(F.lit(0)).cast("decimal(18,6)"),
            "second_kb": F.when(got, N.size_kb(F.coalesce("input_bytes", F.lit(0)))).otherwise(F.lit(0)).cast("decimal(18,3)"),
            "error": F.when(weak & ~got, F.coalesce("error", F.lit("no second-tier answer"))).otherwise(F.col("error")),
        }
    )
    return kept.withColumns(replaced)
