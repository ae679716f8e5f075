"""Money, quantities and ratios.

The rules exist because a plain cast or ``/`` does not mean the same thing everywhere:

* text is cast to a decimal first and only then multiplied, so cents are exact;
* a quantity such as ``2.600`` rounds to 3 when it becomes an integer (a bare cast would cut it to 2);
* ratios divide doubles and give NULL for a zero denominator (ANSI mode would raise).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
LEDGER = "decimal(14,2)"
RATE = "decimal(10,4)"
QUANTITY = "decimal(15,3)"
EXACT_SPEND = "decimal(28,10)"

FOREIGN_CURRENCY = "AUD"


def money(col: str | Column) -> Column:
    return _col(col).cast(MONEY)


def ledger_money(col: str | Column) -> Column:
    return _col(col).cast(LEDGER)


def to_nzd(amount: Column, currency: Column, aud_nzd_rate: Column) -> Column:
    """AUD amounts times the day's rate (NULL when that day has no rate); every other amount unchanged."""
    return F.when(currency == FOREIGN_CURRENCY, amount * aud_nzd_rate).otherwise(amount)


def quantity_to_int(col: str | Column) -> Column:
    return F.round(_col(col).cast(QUANTITY)).cast("int")


def unit_price_per(price: str | Column, price_unit: str | Column) -> Column:
    """Price of one unit when the price is quoted per ``price_unit`` units; the quotient is a double, in whole cents."""
    cents = money(price).cast("double") / _col(price_unit).cast("int").cast("double") * F.lit(100.0)
    return (F.round(cents).cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def micros_to_currency(col: str | Column) -> Column:
    return _col(col).cast("long").cast("double") / F.lit(1_000_000.0)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def exact_sum(col: Column) -> Column:
    """Sum of a double amount that does not depend on the order in which partitions are merged."""
    return F.sum(col.cast(EXACT_SPEND))


def rounded(col: Column, digits: int) -> Column:
    """An exact decimal rounded half up, as a double."""
    return F.round(col, digits).cast("double")


def round_double(col: Column, digits: int) -> Column:
    """Rounds a double by its binary value. ``F.round`` goes by the printed digits, so 0.285 (a little less) goes up."""
    factor = F.lit(10.0**digits)
    return F.round(col.cast("double") * factor) / factor


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
