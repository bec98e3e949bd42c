"""Sales totals, a staged table job with its counts, and the gate that checks them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from scorewright.scale import materialize
from scorewright.sources.files import CORRUPT

# Stages of the sales job in order.
STAGES = ("extract", "clean", "enrich", "aggregate", "publish")


def totals_by_country(
    orders: DataFrame, customers: DataFrame, *, start: str, end: str
) -> DataFrame:
    """Total amount per country for orders in [start, end), highest first.

    ``orders(customer_id, amount, created_at)``, ``customers(customer_id, country)``. Orders are
    summed per customer before the join, so a customer with very many orders arrives as one row.
    """
    in_range = orders.where((F.col("created_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(end).cast("timestamp_ntz")))
    per_customer = in_range.groupBy("customer_id").agg(F.sum("amount").alias("amount"))
    return (
        per_customer.join(customers, "customer_id")
        .groupBy("country")
        .agg(F.sum("amount").alias("total"))
        .orderBy(F.desc("total"), "country")
    )


def clean_orders(orders: DataFrame) -> DataFrame:
    """Orders without a customer key, and lines that could not be read, are dropped."""
    readable = orders.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in orders.columns else orders
    return readable.dropna(subset=["customer_id"])


def customer_countries(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders combined per customer, with the customer's country or NULL."""
    per_customer = orders.groupBy("customer_id").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_orders")
    )
    return per_customer.join(customers, "customer_id", "left")


def country_report(enriched: DataFrame) -> DataFrame:
    """Amount and orders per country; orders without a country form one group of their own."""
    return enriched.groupBy("country").agg(
        F.sum("amount").alias("amount"), F.sum("n_orders").alias("n_orders")
    )


@dataclass(frozen=True)
class Stage:
    """A step of a table job and what is counted when its result is written.

    ``null_of`` names the column whose NULLs count, ``groups`` the one whose distinct values count,
    ``amount`` one that is summed, ``rejected`` a condition of rows set aside. A row stands for
    ``weight`` rows where rows were combined before.
    """

    name: str
    build: Callable[[DataFrame], DataFrame]
    null_of: str
    groups: str | None = None
    amount: str | None = None
    weight: str | None = None
    rejected: Column | None = None


REPORT = (
    "stage STRING, ord BIGINT, status STRING, rows_out BIGINT, null_rows BIGINT, rejected_rows BIGINT, "
    "groups_out BIGINT, amount_out DECIMAL(38,6), error STRING"
)


def _written(stage: Stage, built: DataFrame) -> tuple[DataFrame, dict]:
    """Write what a stage built and count it as it is written."""
    rows = F.lit(1).cast("bigint") if stage.weight is None else F.col(stage.weight).cast("bigint")
    zero = F.lit(0).cast("bigint")
    counts = {
        "rows_out": F.sum(rows),
        "null_rows": F.sum(F.when(F.col(stage.null_of).isNull(), rows).otherwise(zero)),
    }
    if stage.rejected is not None:
        counts["rejected_rows"] = F.sum(F.when(stage.rejected, rows).otherwise(zero))
    if stage.amount is not None:
        counts["amount_out"] = F.sum(F.col(stage.amount).cast("decimal(30,6)"))
    seen = Observation(f"stage {stage.name}")
    stored = materialize(built.observe(seen, *[value.alias(name) for name, value in counts.items()]), stage.name)
    found = {name: value for name, value in seen.get.items() if value is not None}
    found.setdefault("rows_out", 0)
    found.setdefault("null_rows", 0)
    if stage.groups is not None:
        # No distinct count can be observed; this reads back the one column that was written.
        found["groups_out"] = stored.where(F.col(stage.groups).isNotNull()).select(stage.groups).distinct().count()
    return stored, found


def run_stages(source: DataFrame, stages: Sequence[Stage], *, first: int = 0) -> tuple[DataFrame | None, DataFrame]:
    """Run a staged job and measure each stage as it is: (result of the last one, report).

    A stage reads what its predecessor wrote to the shared folder, so the source is read once, and its
    counts are observed in the job that writes its own result. The report has a row per stage. Status
    OK says only that the stage ran. A stage that raises is FAILED with its error, later ones are NOT
    RUN, and there is no result then. ``first`` is the number of the first stage in the report.
    """
    current: DataFrame | None = source
    report = []
    for number, stage in enumerate(stages, first):
        status, error, counted = "NOT RUN", None, {}
        if current is not None:
            try:
                current, counted = _written(stage, stage.build(current))
                status = "OK"
            except Exception as problem:  # reported, as any state of a stage
                current, status, error = None, "FAILED", str(problem)
        values = [counted.get(name) for name in ("rows_out", "null_rows", "rejected_rows", "groups_out", "amount_out")]
        report.append((stage.name, number, status, *values, error))
    return current, source.sparkSession.createDataFrame(report, REPORT)


def sales_stages(
    customers: DataFrame,
    *,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    aggregate: Callable[[DataFrame], DataFrame] = country_report,
    rejected: Column | None = None,
) -> list[Stage]:
    """The sales job: extract, clean, enrich, aggregate, publish. Two of its steps can be replaced.

    ``rejected`` says which rows of the source could not be read.
    """
    joined = enrich or partial(customer_countries, customers=customers)
    by_country = {"null_of": "country", "groups": "country", "amount": "amount"}
    extract, clean, add_country, sum_up, publish = STAGES
    return [
        Stage(extract, lambda orders: orders, "customer_id", amount="amount", rejected=rejected),
        Stage(clean, clean_orders, "customer_id", amount="amount"),
        Stage(add_country, joined, weight="n_orders", **by_country),
        Stage(sum_up, aggregate, **by_country),
        Stage(publish, lambda report: report.select("country", "amount", "n_orders"), **by_country),
    ]


def gate(
    current: DataFrame,
    prior: DataFrame,
    *,
    by: Sequence[str] = (),
    max_null_share: float = 0.05,
    min_group_share: float = 0.5,
    min_amount_share: float | None = None,
) -> DataFrame:
    """Verdict per stage against limits and the prior run, and the stage at fault.

    A stage fails when it did not run to its end, when the NULL share of its key is above the limit, or
    when its number of groups, or its amount where ``min_amount_share`` is given, fell below a share of
    the prior run's, whatever status it reported. The first failing stage by order is the fault.
    """
    keys = [*by, "stage"]
    before = prior.select(
        *keys, F.col("groups_out").alias("prior_groups"), F.col("amount_out").alias("prior_amount")
    )
    null_share = F.when(F.col("rows_out") > 0, F.col("null_rows").cast("double") / F.col("rows_out"))
    failed = (F.col("status") != "OK") | F.coalesce(null_share > F.lit(max_null_share), F.lit(False))
    failed = failed | F.coalesce(F.col("groups_out") < F.col("prior_groups") * F.lit(min_group_share), F.lit(False))
    if min_amount_share is not None:
        share = F.try_divide(F.col("amount_out").cast("double"), F.col("prior_amount").cast("double"))
        failed = failed | F.coalesce(share < F.lit(min_amount_share), F.lit(False))
    order = Window.partitionBy(*by).orderBy("ord")
    judged = current.join(before, keys, "left").withColumns(
        {"null_share": F.round(null_share, 4), "failed": failed, "rows_in": F.lag("rows_out").over(order)}
    )
    failed_before = F.coalesce(
        F.max(F.col("failed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return judged.withColumns(
        {
            "is_fault": F.col("failed") & (failed_before == 0),
            "verdict": F.when(F.col("failed"), F.lit("FAIL")).otherwise(F.lit("PASS")),
        }
    ).drop("failed")
