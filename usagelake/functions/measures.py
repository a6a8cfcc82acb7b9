"""Arithmetic of changes, shares and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.exprs import js_round

# Fixed value: mean days per month used to prorate a monthly fee.
DAYS_PER_MONTH = 30.437


def change_pct(current: Column, previous: Column) -> Column:
    """Percent change to one decimal; from zero it is 0 or unknown."""
    grown = js_round((current - previous) / F.nullif(previous, F.lit(0)) * 1000.0) / 10.0
    return F.when(previous == 0, F.when(current == 0, F.lit(0.0))).otherwise(grown)


def cost_change_pct(current: Column, previous: Column) -> Column:
    """Unknown when either side is unknown: no price is not a price of zero."""
    return F.when(current.isNotNull() & previous.isNotNull(), change_pct(current, previous))


def share(count: Column, total: Column) -> Column:
    part = js_round(count / F.nullif(total, F.lit(0)) * 1000.0) / 10.0
    return F.when(total > 0, part).otherwise(F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    part = js_round(numerator / F.nullif(denominator, F.lit(0)) * 100.0) / 100.0
    return F.when(denominator > 0, part).otherwise(F.lit(0.0))


def cache_reuse(input_tokens: Column, cache_read: Column, cache_write: Column) -> Column:
    total = input_tokens + cache_read + cache_write
    return F.when(total > 0, cache_read / F.nullif(total, F.lit(0)))


def prorated_fee(monthly_usd: Column, days: Column) -> Column:
    return js_round(monthly_usd * F.greatest(days, F.lit(1)) / F.lit(DAYS_PER_MONTH) * 100.0) / 100.0
