"""Metric series: outliers, error-rate alerts, configured limits, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.time import MINUTE, SECOND, floor_to
from scorewright.operators.ordered import exact_quantiles, running_totals, with_previous
from scorewright.scale import lookup_join, materialize

# Scale of the modified z-score and its usual limit.
Z_SCALE = 0.6745
Z_LIMIT = 3.5


def long_form(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per sample and metric from a table with one column per metric."""
    doubles = wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(list(ids), list(metrics), "metric", "value")


def outliers(samples: DataFrame, metric: str, value: str, *, spread: Sequence[str], limit: float = Z_LIMIT) -> DataFrame:
    """Samples far from the median of their metric, by the modified z-score.

    z = 0.6745 * abs(value - median) / MAD. A metric whose MAD is 0 flags nothing.
    """
    # Both statistics come from counts per distinct value; the samples are read twice in all, once
    # to count them and once to flag them.
    counts = materialize(samples.groupBy(metric, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    medians = materialize(
        exact_quantiles(counts, [metric], value, {"median": 0.5}, weight="_n").drop("n_values"), "medians"
    )
    deviation = F.abs(F.col(value) - F.col("median"))
    deviations = lookup_join(counts, medians, [metric], spread=[value], how="inner", stored=True)
    mads = exact_quantiles(
        deviations.select(metric, deviation.alias("_deviation"), "_n"), [metric], "_deviation", {"mad": 0.5}, weight="_n"
    ).drop("n_values")
    scored = lookup_join(samples, medians.join(mads, metric), [metric], spread=spread, how="inner")
    z = F.when(F.col("mad") > 0, F.lit(Z_SCALE) * deviation / F.col("mad"))
    return scored.withColumn("z", z).where(F.col("z") > F.lit(limit))


def error_windows(
    events: DataFrame, at: str, failed: Column, *, width: int = 5 * MINUTE, slide: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Events and errors per window of ``width`` microseconds, tumbling or every ``slide``.

    Sliding windows are put together from counts per slide: events are counted before a row is
    repeated for the windows it lies in. ``width`` must be a multiple of ``slide``.
    """
    step = slide or width
    if width % step:
        raise ValueError("width must be a multiple of slide")
    cells = events.groupBy(*by, floor_to(F.col(at), step).alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(failed).alias("n_errors")
    )
    if step == width:
        return cells
    offsets = F.explode(F.array(*[F.lit(i * step).cast("bigint") for i in range(width // step)])).alias("_offset")
    spread_out = cells.select(*by, "window_start", "n_events", "n_errors", offsets)
    return spread_out.groupBy(*by, (F.col("window_start") - F.col("_offset")).alias("window_start")).agg(
        F.sum("n_events").alias("n_events"), F.sum("n_errors").alias("n_errors")
    )


def alerts(windows: DataFrame, *, share: float, min_events: int) -> DataFrame:
    """Windows with at least ``min_events`` events of which at least ``share`` are errors."""
    error_share = F.col("n_errors").cast("double") / F.col("n_events")
    return windows.where((F.col("n_events") >= min_events) & (error_share >= F.lit(share))).withColumn(
        "error_share", F.round(error_share, 4)
    )


def alert_runs(alerted: DataFrame, *, step: int, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive alert windows merged into one run, with the time it was first detected.

    Works on alert windows, of which a key has at most one per ``step``, in slices of time: a key
    with very many of them, or no key at all, does not end in one task.
    """
    before = with_previous(alerted, by, "window_start", "_before")
    starts = F.when(F.col("window_start") - F.col("_before") == step, F.lit(0)).otherwise(F.lit(1))
    numbered = running_totals(before.withColumn("_starts", starts), by, ["window_start"], {"_run": "_starts"})
    return numbered.groupBy(*by, "_run").agg(
        F.min("window_start").alias("first_detected"),
        F.max("window_start").alias("last_window"),
        F.count(F.lit(1)).alias("n_windows"),
        F.max("error_share").alias("peak_share"),
    ).drop("_run")


def limit_breaches(
    events: DataFrame,
    alerted: DataFrame,
    limits: DataFrame,
    at: str,
    value: str,
    *,
    width: int,
    spread: Sequence[str],
    service: str = "service",
    measure: str = "measure",
) -> DataFrame:
    """Which configured limits of a service its events reached inside its alert windows.

    ``events`` has ``service``, ``measure``, the time and the value measured; ``alerted`` the alert
    windows (``window_start``) per service; ``limits`` rows of ``service, measure, config_key,
    config_limit``, any number per service and measure. One row per alert window and limit reached:
    events at or above it, the highest, the first, and whether this key contributed most, which is the
    one exceeded by the largest factor, then by the most events, then by name.

    A join of events with all limits below their value would repeat an event once per limit. Here the
    limits of a measure are sorted, an event only gets the number of them it reached, and events are
    counted per such number before the limits are joined. Events outside alert windows go first.
    NULL and NaN values reach no limit, and a NULL limit is none.
    """
    known = limits.where(F.col("config_limit").isNotNull() & F.col("config_key").isNotNull())
    known = known.select(service, measure, F.col("config_limit").cast("double").alias("config_limit"), "config_key").distinct()
    per_measure = known.groupBy(service, measure).agg(
        F.array_sort(F.collect_list(F.struct("config_limit", "config_key"))).alias("_limits")
    )
    per_measure = materialize(per_measure, "limits")
    windows = alerted.select("window_start", service, "error_share")

    measured = events.select(
        service, measure, F.col(at).alias("_at"), F.col(value).cast("double").alias("_value"), *spread,
        floor_to(F.col(at), width).alias("window_start"),
    ).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    inside = lookup_join(measured, windows, ["window_start", service], spread=spread, how="inner")
    with_limits = lookup_join(inside, per_measure, [service, measure], spread=spread, how="inner", stored=True)
    reached = F.size(F.filter("_limits", lambda limit: limit["config_limit"] <= F.col("_value")))
    group = ["window_start", service, measure, "error_share"]
    levels = (
        with_limits.withColumn("_reached", reached)
        .where("_reached > 0")
        .groupBy(*group, "_reached")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_value").alias("_max"), F.min("_at").alias("_first"))
    )
    placed = per_measure.select(service, measure, F.posexplode("_limits").alias("_place", "_limit"))
    below = lookup_join(levels, placed, [service, measure], spread=["window_start"], how="inner").where("_place < _reached")
    found = below.groupBy(*group, F.col("_limit.config_key").alias("config_key"), F.col("_limit.config_limit").alias("config_limit")).agg(
        F.sum("_n").alias("n_breaches"), F.max("_max").alias("max_value"), F.min("_first").alias("first_breach")
    )
    factor = F.try_divide("max_value", F.abs("config_limit"))
    # One alert window of one service has as many rows as the service has limits.
    most = Window.partitionBy("window_start", service).orderBy(
        F.desc_nulls_last(factor), F.desc("n_breaches"), "config_key", "config_limit", measure
    )
    return found.withColumn("contributed_most", F.row_number().over(most) == 1)


def gaps(events: DataFrame, key: str, at: str, tiebreak: Sequence[str]) -> DataFrame:
    """Microseconds since the event before, per key; the first event of a key has none."""
    ordered = with_previous(events.select(key, at, *tiebreak), [key], at, "_previous", tiebreak=tiebreak)
    return ordered.withColumn("gap", F.col(at) - F.col("_previous")).drop("_previous")


def latency_stats(gap_rows: DataFrame, key: str) -> DataFrame:
    """Number, mean, median and 95th percentile of the gaps per key, in seconds."""
    known = gap_rows.where(F.col("gap").isNotNull())
    spread = exact_quantiles(known, [key], "gap", {"_median": 0.5, "_p95": 0.95}).drop("n_values")
    means = known.groupBy(key).agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("gap").alias("_sum"))
    return means.join(spread, key).select(
        key,
        "n_gaps",
        F.round(F.col("_sum") / F.col("n_gaps") / SECOND, 2).alias("mean_s"),
        F.round(F.col("_median") / SECOND, 2).alias("median_s"),
        F.round(F.col("_p95") / SECOND, 2).alias("p95_s"),
    )
