"""Two-tier cascade: keep good first answers, replace weak ones by a second model's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright import schemas
from scorewright.functions import numbers as N
from scorewright.scale import lookup_join


def needs_escalation(
    score: Column,
    success: Column,
    *,
    threshold: float = schemas.ESCALATION_THRESHOLD,
    enabled: bool = True,
    exempt: Column | None = None,
) -> Column:
    """Is this answer to be replaced?

    A scored answer is, when its rounded score is below the threshold; an unscored one when it
    failed. Skipped answers (success NULL) and exempt ones stay.
    """
    if not enabled:
        return F.lit(False)
    weak = F.when(score.isNull(), F.coalesce(~success, F.lit(False))).otherwise(score < F.lit(threshold))
    return weak & ~exempt if exempt is not None else weak


def merge_tiers(
    first: DataFrame,
    second: DataFrame,
    ids: Sequence[str],
    *,
    threshold: float = schemas.ESCALATION_THRESHOLD,
    pass_threshold: float = schemas.PASS_THRESHOLD,
) -> DataFrame:
    """Replace weak first-tier answers by second-tier ones, keeping the first as a record.

    ``first`` has ``output, raw_score, score, success``; ``second`` has ``output, raw_score,
    tokens, model`` for the rows it could answer. Where it has none, the first answer stays and
    ``error`` says so. Every row of ``first`` comes out once.
    """
    second = second.select(
        *ids,
        F.col("output").alias("_output2"),
        F.col("raw_score").alias("_raw2"),
        F.col("tokens").alias("_tokens2"),
        F.col("model").alias("_model2"),
    )
    weak = needs_escalation(F.col("score"), F.col("success"), threshold=threshold)
    joined = first.withColumn("_weak", weak).join(second, list(ids), "left")
    taken = F.col("_weak") & F.col("_output2").isNotNull()
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *[c for c in first.columns if c not in ("output", "raw_score", "score", "success")],
        F.when(taken, F.col("_output2")).otherwise(F.col("output")).alias("output"),
        F.when(taken, F.col("_raw2")).otherwise(F.col("raw_score")).alias("raw_score"),
        F.when(taken, N.half_up(F.col("_raw2"), 3)).otherwise(F.col("score")).alias("score"),
        F.when(taken, F.col("_raw2") >= F.lit(pass_threshold)).otherwise(F.col("success")).alias("success"),
        taken.alias("escalated"),
        F.when(taken, F.col("output")).alias("local_output"),
        F.when(taken, F.col("score")).alias("local_score"),
        F.when(taken, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("cloud_calls"),
        F.when(taken, F.coalesce("_tokens2", zero)).otherwise(zero).alias("tokens"),
        F.when(taken, N.call_cost(F.coalesce("_tokens2", zero), F.col("_model2")))
        .otherwise(F.lit(0))
        .cast("decimal(18,6)")
        .alias("cost_usd"),
        F.when(F.col("_weak") & ~taken, F.lit("no second-tier answer")).alias("error"),
    )


def last_reply(asked: DataFrame, conversations: DataFrame) -> DataFrame:
    """Add ``fallback``: the last assistant turn of the conversation, if it comes after the user's.

    The last turn's number is found first, and its text joined by (conversation, turn) only then, so no text
    is aggregated. Both joins spread conversations that hold a large share of the turns.
    """
    replies = conversations.where(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("_last_turn"), F.col("text").alias("fallback"))
    last = replies.groupBy("conv_id").agg(F.max("_last_turn").alias("_last_turn"))
    numbered = lookup_join(asked, last, ["conv_id"], spread=["turn"])
    later = F.when(F.col("_last_turn") > F.col("turn"), F.col("_last_turn"))
    ended = replies.join(last, ["conv_id", "_last_turn"], "left_semi")
    joined = lookup_join(
        numbered.withColumn("_last_turn", later), ended, ["conv_id", "_last_turn"], spread=["turn"], may_broadcast=False
    )
    return joined.drop("_last_turn")


def compare_modes(
    scored: DataFrame,
    *,
    first_score: str,
    second_score: str,
    second_cost: str,
    threshold: float = schemas.ESCALATION_THRESHOLD,
    pass_threshold: float = schemas.PASS_THRESHOLD,
) -> DataFrame:
    """Local-only, hybrid and cloud-only outcomes of the same tasks, one row per mode.

    All three modes are folded into one aggregate over one pass and unpivoted from its single row,
    so the tasks are not tripled.
    """
    first, second = F.col(first_score), F.col(second_score)
    weak = first.isNotNull() & (N.half_up(first, 3) < F.lit(threshold)) & second.isNotNull()
    outcome = {
        "local_only": (first, F.lit(False)),
        "hybrid": (F.when(weak, second).otherwise(first), weak),
        "cloud_only": (second, second.isNotNull()),
    }
    measures = []
    for mode, (score, in_cloud) in outcome.items():
        cost = F.when(in_cloud, F.col(second_cost)).otherwise(F.lit(0)).cast("decimal(18,6)")
        score_units = F.round(score * 1000).cast("bigint")
        measures += [
            F.count(score).alias(f"{mode}_scored"),
            F.count_if(score >= F.lit(pass_threshold)).alias(f"{mode}_passed"),
            F.sum(score_units).alias(f"{mode}_units"),
            F.count_if(in_cloud).alias(f"{mode}_calls"),
            F.sum(cost).alias(f"{mode}_cost"),
        ]
    row = scored.agg(F.count(F.lit(1)).alias("n_tasks"), *measures)
    per_mode = F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"),
                F.col("n_tasks"),
                F.col(f"{mode}_scored").alias("n_scored"),
                F.col(f"{mode}_passed").alias("n_passed"),
                N.ratio(F.col(f"{mode}_units"), F.col(f"{mode}_scored") * 1000, 3).alias("mean_score"),
                F.col(f"{mode}_calls").alias("cloud_calls"),
                F.coalesce(F.col(f"{mode}_cost"), F.lit(0)).cast("double").alias("cost_usd"),
            )
            for mode in outcome
        ]
    )
    return row.select(F.inline(per_mode))
