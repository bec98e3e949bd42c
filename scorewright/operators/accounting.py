"""Tokens, calls, bytes and cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions import numbers as N
from scorewright.scale import lookup_join


def price_calls(
    calls: DataFrame,
    *,
    tokens: str = "tokens",
    model: str = "model",
    prices: Mapping[str, tuple[Decimal, Decimal]] | DataFrame = N.PRICES,
    spread: Sequence[str] = (),
) -> DataFrame:
    """Add ``cost_usd`` to each call, by the model that really ran.

    ``prices`` maps models to dollars per 1,000 tokens of input and output, or is a table
    ``model, price_in, price_out`` of any size, looked up with a size check; ``spread`` then names columns
    that tell calls of one model apart. A model without a price costs nothing.
    """
    if not isinstance(prices, DataFrame):
        return calls.withColumn("cost_usd", N.call_cost(F.col(tokens), F.col(model), prices))
    share = F.lit(N.INPUT_SHARE).cast("decimal(2,1)")
    blended = share * F.col("price_in").cast("decimal(12,6)") + (1 - share) * F.col("price_out").cast("decimal(12,6)")
    per_token = (blended / 1000).cast("decimal(18,12)")
    table = prices.groupBy(F.col("model").alias(model)).agg(F.max(per_token).alias("_price"))
    priced = lookup_join(calls, table, [model], spread=spread or calls.columns[:1])
    amount = F.round(F.col(tokens).cast("decimal(18,0)") * F.col("_price"), 6)
    return priced.withColumn("cost_usd", F.coalesce(amount, F.lit(0)).cast("decimal(18,6)")).drop("_price")


def size_payloads(calls: DataFrame, text: str) -> DataFrame:
    """Add ``n_bytes`` and ``data_kb`` of what is sent."""
    return calls.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"),
            "data_kb": N.payload_kb(F.col(text)),
        }
    )


def accumulate_calls(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens, cost and size per group; cost and size are rounded per call, then summed."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cloud_calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("data_kb").alias("data_kb"),
    )


def overhead(calls: DataFrame, by: list[str], *, model: str) -> DataFrame:
    """Cost of planning and summarising a run, apart from its tasks: priced once on all its tokens."""
    totals = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("tokens"))
    return totals.withColumn("cost_usd", N.call_cost(F.coalesce("tokens", F.lit(0)), F.lit(model)))
