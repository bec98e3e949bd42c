"""Run reports as DataFrames: rows, summary, synthesis feed, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright import schemas
from scorewright.functions import numbers as N
from scorewright.operators.packing import PART_BYTES, pack
from scorewright.sources.tasks import BLOCK_GAP, SKIP_MARK

# What stands before, between and after the number and the agent above each output.
FEED_LINE = ("Task ", " (", "):\n")


def report_rows(results: DataFrame, ids: list[str]) -> DataFrame:
    """Display form of each result: PASS/FAIL/SKIP, ``-`` for no score, units, output and its preview."""
    label = (
        F.when(F.col("success").isNull(), F.lit("SKIP")).when(F.col("success"), F.lit("PASS")).otherwise(F.lit("FAIL"))
    )
    cut = F.length("output") > schemas.PREVIEW_CHARS
    return results.select(
        *ids,
        label.alias("result"),
        F.when(F.col("score").isNotNull(), F.format_string("%.3f", "score")).otherwise(F.lit("-")).alias("score"),
        F.when(F.col("escalated"), F.lit("YES")).otherwise(F.lit("no")).alias("escalated"),
        F.format_string("%.2fs", F.coalesce("latency_s", F.lit(0.0))).alias("latency"),
        F.concat(F.lit("$"), F.col("cost_usd").cast("decimal(18,6)").cast("string")).alias("cost"),
        F.concat(F.round("data_kb", 2).cast("decimal(18,2)").cast("string"), F.lit(" KB")).alias("data"),
        F.concat(
            F.left("output", F.lit(schemas.PREVIEW_CHARS)), F.when(cut, F.lit("...")).otherwise(F.lit(""))
        ).alias("preview"),
        "output",
    )


def run_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a run: rates over scored rows, mean latency over all rows, skipped ones included.

    Latency is summed in hundredths of a second, so the mean does not depend on row order.
    """
    hundredths = F.round(F.coalesce("latency_s", F.lit(0.0)) * 100).cast("bigint")
    totals = results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count("success").alias("n_scored"),
        F.count_if("success").alias("n_passed"),
        F.sum(hundredths).alias("_latency"),
        F.coalesce(F.sum("cloud_calls"), F.lit(0)).cast("bigint").alias("cloud_calls"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("cost_usd"),
    )
    return totals.select(
        *(by or []),
        "n_tasks",
        "n_scored",
        "n_passed",
        N.ratio(F.col("n_passed") * 100, F.col("n_scored"), 0).alias("pass_rate_pct"),
        N.ratio(F.col("_latency"), F.col("n_tasks") * 100, 2).alias("mean_latency_s"),
        "cloud_calls",
        "cost_usd",
    )


def judge_reasons(results: DataFrame, ids: list[str]) -> DataFrame:
    """Results that carry a judge's reason."""
    return results.where(F.coalesce("judge_reason", F.lit("")) != "").select(*ids, "score", "judge_reason")


def synthesis_feed(
    results: DataFrame, group: str, position: str, agent: str, output: str, *, max_bytes: int = PART_BYTES
) -> DataFrame:
    """Outputs of a run as text for a summary, in task order, without empty and skipped ones.

    A run of more than ``max_bytes`` comes out as several rows, to be read by rising ``part`` (see
    :func:`packing.pack`), so no row has to hold a run without bound; nothing is left out.
    """
    kept = results.where((F.col(output) != "") & ~F.contains(F.col(output), F.lit(SKIP_MARK)))
    number = F.col(position).cast("string")
    block = F.concat(F.lit(FEED_LINE[0]), number, F.lit(FEED_LINE[1]), F.col(agent), F.lit(FEED_LINE[2]), F.col(output))
    blocks = kept.select(group, position, block.alias("_block")).withColumn(
        "_bytes", F.octet_length("_block") + F.lit(len(BLOCK_GAP.encode()))
    )
    parts = pack(blocks, [group], [position], "_bytes", max_bytes=max_bytes)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col("_block").alias("block"))))
    return parts.groupBy(group, "part").agg(
        F.count(F.lit(1)).alias("n_outputs"),
        F.array_join(F.transform(ordered, lambda piece: piece["block"]), BLOCK_GAP).alias("feed"),
    )


def compare_runs(results: DataFrame, run: str, model: str, category: str, at: str) -> DataFrame:
    """Per run, model and category, and per run and model over all categories: rates, and the change in time.

    Pass rate, mean score, cost per pass and escalation lift; ``previous_run`` is the run of the same model
    that began last before this one (``at`` is the time of a result, a run begins with its first), and
    ``pass_rate_change`` the difference to it in the same category. Runs are put in the order of time, not
    of their names; names only part runs that begin at once. ``is_total`` marks rows over all categories.

    Results are combined per run, model and category first; ordering works on those few rows.
    """
    lifted = F.col("escalated") & F.col("score").isNotNull() & F.col("local_score").isNotNull()
    milli = F.round(F.col("score") * 1000).cast("bigint")
    lift = F.when(lifted, F.round((F.col("score") - F.col("local_score")) * 1000).cast("bigint"))
    cost_units = (F.col("cost_usd").cast("decimal(18,6)") * 1_000_000).cast("bigint")
    cells = results.groupBy(run, model, category).agg(
        F.min(at).alias("_begin"),
        F.count(F.lit(1)).alias("n_tasks"),
        F.count("success").alias("n_scored"),
        F.count_if("success").alias("n_passed"),
        F.sum(milli).alias("_score"),
        F.count("score").alias("_n_score"),
        F.sum(lift).alias("_lift"),
        F.count(lift).alias("n_lifted"),
        F.sum(cost_units).alias("_cost"),
    )
    counted = [name for name in cells.columns if name not in (run, model, category, "_begin")]
    each = [F.col(run), F.col(model), F.col(category)]
    totals = cells.groupingSets([each, each[:2]], *each).agg(
        (F.grouping(category) == 1).alias("is_total"),
        F.min("_begin").alias("_begin"),
        *[F.sum(name).alias(name) for name in counted],
    )
    rated = totals.select(
        run,
        model,
        category,
        "is_total",
        F.min("_begin").over(Window.partitionBy(run, model)).alias("run_began"),
        "n_tasks",
        "n_scored",
        "n_passed",
        N.ratio(F.col("n_passed") * 100, F.col("n_scored"), 3).alias("pass_rate_pct"),
        N.ratio(F.col("_score"), F.col("_n_score") * 1000, 3).alias("mean_score"),
        N.ratio(F.col("_cost"), F.col("n_passed") * 1_000_000, 6).alias("cost_per_pass"),
        F.when(F.col("n_lifted") > 0, F.col("_lift").cast("double") / (F.col("n_lifted") * 1000)).alias("_raw_lift"),
        "n_lifted",
    )
    in_time = Window.partitionBy(model, category, "is_total").orderBy("run_began", run)
    by_category = Window.partitionBy(category, "is_total")
    return rated.withColumns(
        {
            "mean_lift": N.half_up(F.col("_raw_lift"), 3),
            "previous_run": F.lag(run).over(in_time),
            "pass_rate_change": N.half_up(F.col("pass_rate_pct") - F.lag("pass_rate_pct").over(in_time), 3),
            "rank_in_category": F.dense_rank().over(by_category.orderBy(F.desc_nulls_last("pass_rate_pct"))).cast("bigint"),
        }
    ).drop("_raw_lift")
