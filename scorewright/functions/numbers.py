"""Rounding, payload size and call cost, exact where money or thresholds depend on them."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars per 1,000 tokens, as (input, output).
PRICES = {
    "gpt-4o-mini": (Decimal("0.000150"), Decimal("0.000600")),
    "gpt-4o": (Decimal("0.002500"), Decimal("0.010000")),
}
# Fixed value: share of a call's tokens taken as input, the rest as output.
INPUT_SHARE = Decimal("0.6")


def ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """numerator / denominator of two non-negative integers, rounded half-up without float error."""
    scale = 10**places
    top = F.lit(2 * scale).cast("bigint") * numerator + denominator
    units = F.call_function("div", top, F.lit(2).cast("bigint") * denominator)
    return F.when(denominator != 0, units.cast("double") / F.lit(float(scale)))


def half_up(value: Column, places: int) -> Column:
    """Round a double half-up on its shortest decimal form."""
    return F.round(value, places)


def size_kb(n_bytes: Column) -> Column:
    """A number of bytes in units of 1,024 with three places, as DECIMAL."""
    return F.round(n_bytes.cast("decimal(18,0)") / F.lit(Decimal(1024)), 3).cast("decimal(18,3)")


def payload_kb(text: Column) -> Column:
    """UTF-8 size of a text in units of 1,024 bytes with three places; NULL counts as empty."""
    return size_kb(F.coalesce(F.octet_length(text), F.lit(0)))


def blended_price(prices: Mapping[str, tuple[Decimal, Decimal]], model: str) -> Decimal:
    """Dollars per token of a model under the fixed input/output split."""
    price_in, price_out = prices[model]
    return (INPUT_SHARE * price_in + (1 - INPUT_SHARE) * price_out) / 1000


def call_cost(
    tokens: Column, model: Column, prices: Mapping[str, tuple[Decimal, Decimal]] = PRICES
) -> Column:
    """Cost of one call in dollars with six places; a model without a price costs nothing."""
    per_token = F.lit(None).cast("decimal(18,12)")
    for name in prices:
        price = F.lit(str(blended_price(prices, name))).cast("decimal(18,12)")
        per_token = F.when(model == name, price).otherwise(per_token)
    amount = F.round(tokens.cast("decimal(18,0)") * per_token, 6)
    return F.coalesce(amount, F.lit(0)).cast("decimal(18,6)")
