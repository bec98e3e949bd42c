"""Errors that spread from one service to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.ordered import running_totals, with_previous, with_rank
from scorewright.scale import materialize


def downstream_coverage(errors: DataFrame, service: str, at: str, *, within: int) -> DataFrame:
    """For each error time of a service: how many other services fail in the ``within`` after it.

    Pairs of errors are never formed. An error at u, whose service failed before at p, is the first
    one that service shows to every origin in [max(p, u - within), u). Each error thus adds one at
    the start of that span and takes it away at its end, and the running sum over time is the number
    of services seen. The origin's own next error is taken off again.
    """
    points = errors.groupBy(service, F.col(at).alias("_at")).agg(F.count(F.lit(1)).alias("n_errors"))
    spans = materialize(with_previous(points, [service], "_at", "_previous"), "spans")
    start = F.greatest(F.col("_at") - within, F.coalesce("_previous", F.col("_at") - within))
    opened = spans.select(start.alias("_at"), F.lit(1).cast("bigint").alias("_change"))
    closed = spans.select("_at", F.lit(-1).cast("bigint").alias("_change"))
    changes = opened.unionByName(closed).groupBy("_at").agg(F.sum("_change").alias("_change"))
    seen = running_totals(changes, [], ["_at"], {"_seen": "_change"}).select("_at", "_seen")
    own = spans.where(F.col("_at") - F.col("_previous") <= within).select(
        service, F.col("_previous").alias("_at"), F.lit(1).cast("bigint").alias("_own")
    )
    return (
        spans.select(service, "_at", "n_errors")
        .join(seen, "_at")
        .join(own, [service, "_at"], "left")
        .select(
            service,
            F.col("_at").alias("origin_at"),
            "n_errors",
            (F.col("_seen") - F.coalesce("_own", F.lit(0))).cast("bigint").alias("n_downstream"),
        )
    )


def root_candidate(coverage: DataFrame, service: str) -> DataFrame:
    """The origin that covers most services, the earliest of equals: one row."""
    return coverage.orderBy(F.desc("n_downstream"), "origin_at", service).limit(1)


def cascade_chain(errors: DataFrame, coverage: DataFrame, service: str, at: str, *, within: int) -> DataFrame:
    """Services that fail after the root candidate, ordered by their first error.

    ``step`` 0 is the root itself. The root is one row; its time bounds the scan of the errors.
    """
    root = materialize(root_candidate(coverage, service), "root")
    root_at = root.select("origin_at").scalar()
    root_service = root.select(service).scalar()
    after = errors.where(
        (F.col(at) > root_at) & (F.col(at) <= root_at + F.lit(within)) & (F.col(service) != root_service)
    )
    followers = after.groupBy(service).agg(F.min(at).alias("first_error_at"), F.count(F.lit(1)).alias("n_errors"))
    first = root.select(service, F.col("origin_at").alias("first_error_at"), "n_errors")
    chain = with_rank(first.unionByName(followers), [], ["first_error_at", service], "_position")
    return chain.withColumn("step", (F.col("_position") - 1).cast("bigint")).drop("_position")
