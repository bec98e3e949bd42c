"""Service logs: parse, roll up, find the important and the related events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.operators.ordered import SLICE, add_carry, running_totals, slice_by_range
from scorewright.operators.packing import PART_BYTES, pack
from scorewright.scale import lookup_join, materialize

# Log levels by severity, spellings that mean the same, levels that count as errors.
SEVERITY = {"FATAL": 5, "ERROR": 4, "WARNING": 3, "INFO": 2, "DEBUG": 1}
LEVEL_ALIASES = {"WARN": "WARNING"}
ERROR_LEVELS = ("ERROR", "FATAL")
LINE = r"(?s)\A(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?) ([A-Z]+)\s+(?:\[([^\]]+)\]\s)?(.*)\z"
CONTINUATION = r"^\s*(at |Stack trace:)"
SEPARATOR = "\x01"


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add ``ts, level, component, message, is_continuation, parsed``.

    A line of another shape keeps its row with ``parsed`` false and NULL fields.
    """
    # One pass of the pattern folds its groups into one string; unmatched lines stay as they are.
    folded = F.regexp_replace(F.col(line), LINE, f"$1{SEPARATOR}$2{SEPARATOR}$3{SEPARATOR}$4")
    split = lines.withColumn("_folded", folded).withColumn(
        "_parts", F.when(F.col("_folded") != F.col(line), F.split("_folded", SEPARATOR, 4))
    )
    level = F.get("_parts", 1)
    for alias, name in LEVEL_ALIASES.items():
        level = F.when(level == alias, F.lit(name)).otherwise(level)
    timed = split.withColumn("ts", F.get("_parts", 0).try_cast("timestamp_ntz"))
    parsed = F.col("ts").isNotNull()
    message = F.get("_parts", 3)
    return timed.withColumns(
        {
            "parsed": parsed,
            "level": F.when(parsed, level),
            "component": F.when(parsed, F.nullif(F.get("_parts", 2), F.lit(""))),
            "message": F.when(parsed, T.strip(message)),
            "is_continuation": F.when(parsed, F.rlike(message, F.lit(CONTINUATION))),
        }
    ).drop("_folded", "_parts")


def is_error(level: Column) -> Column:
    """Does the level count as an error?"""
    return level.isin(*ERROR_LEVELS)


def severity(level: Column) -> Column:
    """Severity of a level as a number, 0 when unknown."""
    rank = F.lit(0)
    for name, value in SEVERITY.items():
        rank = F.when(level == name, F.lit(value)).otherwise(rank)
    return rank


def errors_as_json(
    events: DataFrame, source: str, order: Sequence[str], *, max_bytes: int = PART_BYTES
) -> DataFrame:
    """Errors of each source as JSON arrays of ``{timestamp, message}`` in time order.

    Continuation lines are left out. Sources whose objects, with a comma each, take more than
    ``max_bytes`` give several arrays, to be read by rising ``part`` (see :func:`packing.pack`).
    """
    errors = events.where(is_error(F.col("level")) & ~F.coalesce("is_continuation", F.lit(False)))
    item = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("message").alias("message"))
    objects = errors.select(source, *order, F.to_json(item).alias("_object")).withColumn(
        "_bytes", F.octet_length("_object") + 1
    )
    parts = pack(objects, [source], order, "_bytes", max_bytes=max_bytes)
    ordered = F.array_sort(F.collect_list(F.struct(*order, "_object")))
    listed = F.array_join(F.transform(ordered, lambda i: i["_object"]), ",")
    return parts.groupBy(source, "part").agg(
        F.count(F.lit(1)).alias("n_errors"), F.concat(F.lit("["), listed, F.lit("]")).alias("errors")
    )


def level_counts(events: DataFrame, source: str) -> DataFrame:
    """Events per source and level."""
    return events.groupBy(source, "level").agg(F.count(F.lit(1)).alias("n_events"))


def top_events(events: DataFrame, source: str, order: Sequence[str], *, k: int = 5) -> DataFrame:
    """The ``k`` most important events per source: severity, then frequency of the message, then time.

    Frequency counts messages alike after digits are masked. Each (source, message form) is first
    cut to its ``k`` earliest events, which Spark does before the shuffle, and joined with the
    counts only then; a source with a large share of all events is never sorted as a whole.
    """
    form = F.coalesce(T.signature(F.col("message")), F.lit(""))
    shaped = events.withColumns({"_form": form, "_severity": severity(F.col("level"))})
    group = [source, "_severity", "_form"]
    counts = shaped.groupBy(*group).agg(F.count(F.lit(1)).alias("frequency"))
    earliest = (
        shaped.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        .where(F.col("_n") <= k)
        .drop("_n")
    )
    ranking = Window.partitionBy(source).orderBy(F.desc("_severity"), F.desc("frequency"), *order)
    return (
        earliest.join(counts, group)
        .withColumn("rank", F.row_number().over(ranking))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
        .drop("_form", "_severity")
    )


def evidence_before(
    events: DataFrame, group: str, at: str, level: str, levels: Sequence[str], anchors: Column, *, lookback: int
) -> DataFrame:
    """For each anchor event: earlier events of its group within ``lookback`` microseconds.

    Counts by level, first and last time. One row per (group, time) that holds an anchor.

    A sliding window would add up the whole lookback again for every anchor. Here events become
    running counts per group, and an anchor subtracts the count at the start of its lookback from
    the count just before it; first and last event are found by their running count. Events of one
    microsecond are combined first.
    """
    per_level = {name: f"n_{name}" for name in levels}
    points = events.groupBy(group, F.col(at).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col(level) == name, F.lit(1))).alias(f"_n_{name}") for name in levels],
        F.max(anchors.cast("int")).alias("_anchor"),
    )
    counted = ["_n", *[f"_n_{name}" for name in levels]]
    zero = F.lit(0).cast("bigint")
    starts = points.where("_anchor = 1").select(
        group,
        (F.col("_at") - lookback).alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(0).alias("_anchor"),
        *[zero.alias(name) for name in counted],
    )
    marks = points.withColumn("_kind", F.lit(1)).unionByName(starts)
    totals = materialize(
        running_totals(marks, [group], ["_at", "_kind"], {f"_upto{name}": name for name in counted}), "running"
    )
    before_start = totals.where("_kind = 0").select(
        group, (F.col("_at") + lookback).alias("_at"), *[F.col(f"_upto{name}").alias(f"_start{name}") for name in counted]
    )
    real = totals.where("_kind = 1")
    anchored = (
        real.where("_anchor = 1")
        .join(before_start, [group, "_at"])
        .select(
            group,
            "_at",
            F.col("_start_n"),
            (F.col("_upto_n") - F.col("_n")).alias("_end_n"),
            *[(F.col(f"_upto{n}") - F.col(n) - F.col(f"_start{n}")).alias(f"_found{n}") for n in counted],
        )
    )
    firsts = real.select(group, (F.col("_upto_n") - F.col("_n")).alias("_start_n"), F.col("_at").alias("_first"))
    lasts = real.select(group, F.col("_upto_n").alias("_end_n"), F.col("_at").alias("_last"))
    joined = anchored.join(firsts, [group, "_start_n"], "left").join(lasts, [group, "_end_n"], "left")
    any_found = F.col("_found_n") > 0
    return joined.select(
        group,
        F.col("_at").alias("anchor_at"),
        F.col("_found_n").alias("n_events"),
        *[F.col(f"_found_n_{name}").alias(column) for name, column in per_level.items()],
        F.when(any_found, F.col("_first")).alias("first_at"),
        F.when(any_found, F.col("_last")).alias("last_at"),
    )


def evidence_list(
    events: DataFrame,
    group: str,
    at: str,
    tiebreak: str,
    fields: Sequence[str],
    anchors: Column,
    *,
    n: int,
    lookback: int,
) -> DataFrame:
    """For each anchor event: the last ``n`` events of its group before it, within ``lookback`` microseconds.

    ``evidence`` lists them in time order with their time, ``tiebreak`` (which orders events of one time) and
    ``fields``; ``n_listed`` says how many there are.

    A group is worked on in slices of time. Within a slice a frame of ``n`` rows gives the list; the events
    missing at its beginning come from the slices before, of which each hands over its last ``n`` events and
    no more. Those of the last ``n`` slices that hold the group are enough, since each has one at least.
    """
    named = events.select(group, at, tiebreak, *fields, anchors.alias("_anchor"))
    sliced = slice_by_range(named, [group], [at, tiebreak])
    item = F.struct(at, tiebreak, *fields)
    within = Window.partitionBy(SLICE, group).orderBy(at, tiebreak)
    across = Window.partitionBy(group).orderBy(SLICE).rowsBetween(-n, -1)

    def newest(items: Column) -> Column:
        return F.slice(items, F.greatest(F.size(items) - (n - 1), F.lit(1)), F.lit(n))

    backwards = Window.partitionBy(SLICE, group).orderBy(F.desc(at), F.desc(tiebreak))
    ends = sliced.withColumn("_nth", F.row_number().over(backwards)).where(F.col("_nth") <= n)
    handed = ends.groupBy(SLICE, group).agg(F.array_sort(F.collect_list(item)).alias("_last"))
    carry = handed.select(SLICE, group, newest(F.flatten(F.collect_list("_last").over(across))).alias("_carry"))
    local = sliced.withColumn("_local", F.collect_list(item).over(within.rowsBetween(-n, -1))).where("_anchor")
    both = add_carry(local, carry, [group])
    listed = newest(F.concat(F.coalesce("_carry", F.array()), F.col("_local")))
    recent = F.filter(listed, lambda event: event[at] >= F.col(at) - F.lit(lookback))
    found = both.withColumn("evidence", recent)
    return found.select(group, at, tiebreak, F.size("evidence").alias("n_listed"), "evidence")


def match_signatures(
    reports: DataFrame, logs: DataFrame, report_signature: Column, log_signature: Column, *, spread: Sequence[str], matched: bool = True
) -> DataFrame:
    """Reports whose signature occurs in the logs, or those whose signature does not.

    The logs are reduced to their distinct signatures before the join.
    """
    known = logs.select(log_signature.alias("_signature")).where(F.col("_signature").isNotNull()).distinct()
    marked = reports.withColumn("_signature", report_signature)
    how = "left_semi" if matched else "left_anti"
    return lookup_join(marked, known, ["_signature"], spread=spread, how=how).drop("_signature")


def failure_breakdown(events: DataFrame, failed: Column, dims: tuple[str, str]) -> DataFrame:
    """Failure share by both dimensions, by the first, and overall, with lift over the overall share.

    Events are counted at the finest level before the grouping sets multiply the rows.
    """
    first, second = dims
    cells = events.groupBy(first, second).agg(F.count(F.lit(1)).alias("_n"), F.count_if(failed).alias("_f"))
    sets = cells.groupingSets([[F.col(first), F.col(second)], [F.col(first)], []], first, second).agg(
        F.grouping_id().cast("bigint").alias("grouping_level"),
        F.sum("_n").alias("n_events"),
        F.sum("_f").alias("n_failed"),
    )
    overall = cells.agg((F.sum("_f").cast("double") / F.sum("_n")).alias("share"))
    share = F.col("n_failed").cast("double") / F.col("n_events")
    return sets.select(
        first,
        second,
        "grouping_level",
        "n_events",
        "n_failed",
        F.round(share, 4).alias("failed_share"),
        F.round(share / overall.scalar(), 4).alias("lift"),
    )
