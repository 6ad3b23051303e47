"""Decimal money arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_TOLERANCE = Decimal("1.0")
_NUDGE = Decimal("0.000000001")
#: Money of a line of any size; ten billion such lines still add up.
WIDE = "decimal(28,2)"


def round_money(col: Column) -> Column:
    """Two decimals after a nudge upwards, so ties go up on both sides of zero; null out of range."""
    return F.round(col + F.lit(_NUDGE), 2).try_cast("decimal(18,2)")


def percent_of(amount: Column, percent: Column) -> Column:
    return amount * percent * F.lit(Decimal("0.01"))


def wide_product(quantity: Column, unit_price: Column) -> Column:
    """quantity x price of any size, exact below a billion billions on both sides; null out of range."""
    exact = round_money(_narrow(quantity) * _narrow(unit_price))
    return F.coalesce(exact.cast(WIDE), F.round(F.try_multiply(quantity, unit_price), 2).try_cast(WIDE))


def wide_tax(subtotal: Column, percent: Column) -> Column:
    exact = round_money(percent_of(subtotal.try_cast("decimal(18,2)"), _narrow(percent)))
    wide = F.try_multiply(F.try_multiply(subtotal, percent), F.lit(Decimal("0.01")))
    return F.coalesce(exact.cast(WIDE), F.round(wide, 2).try_cast(WIDE))


def wide_rounded(col: Column) -> Column:
    return F.round(col + F.lit(_NUDGE).cast("decimal(18,9)"), 2).try_cast(WIDE)


def _narrow(col: Column) -> Column:
    return col.try_cast("decimal(18,6)")


def line_subtotal(quantity: Column, unit_price: Column) -> Column:
    return round_money(quantity * unit_price)


def line_tax(subtotal: Column, percent: Column) -> Column:
    return round_money(percent_of(subtotal, percent))


def expected_total(quantity: Column, unit_price: Column, percent: Column) -> Column:
    """quantity x price with tax on top; null when quantity or price is missing."""
    net = quantity * unit_price
    rate = F.coalesce(percent, F.lit(Decimal("0.00")))
    return F.round(net + percent_of(net, rate), 2)


def total_mismatches(
    quantity: Column,
    unit_price: Column,
    percent: Column,
    reported: Column,
    tolerance: Decimal = AMOUNT_TOLERANCE,
) -> Column:
    gap = F.abs(expected_total(quantity, unit_price, percent) - reported)
    return F.coalesce(gap > F.lit(tolerance), F.lit(False))


def display_amount(quantity: Column, unit_price: Column) -> Column:
    return quantity * unit_price


def cents(col: Column) -> Column:
    return F.round(col * F.lit(Decimal(100)), 0).cast("bigint")


def half_up_int(col: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(col + F.lit(Decimal("0.5"))).cast("bigint")


def half_up_quotient(part: Column, whole: Column) -> Column:
    """part / whole to the nearest integer, halves upwards, on integers alone.

    0 for an empty whole. Both sides are non-negative.
    """
    top = (part * 2 + whole).cast("decimal(38,0)")
    bottom = (whole * 2).cast("decimal(38,0)")
    quotient = ((top - top % bottom) / bottom).cast("bigint")
    return F.when(whole > 0, quotient).otherwise(F.lit(0)).cast("bigint")


def half_up_percent(part: Column, whole: Column) -> Column:
    return half_up_quotient(part * 100, whole)


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals of one money sum in another."""
    points = half_up_quotient(
        (part * 1000000).cast("decimal(38,0)"), (whole * 100).cast("decimal(38,0)")
    )
    return (points.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(10,2)")
