"""Exact money arithmetic as Catalyst expressions.

The reference does its averages and shares in PostgreSQL NUMERIC: exact,
then ROUND half away from zero. Spark's decimal division rounds to a fixed
scale first, so ROUND(AVG(x), 2) could round twice. These helpers round an
exact integer ratio once, using only integral division, so they agree with
an exact engine on every tie. Everything stays a built-in expression (no
UDF), so it is code-generated and aggregates combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = "decimal(38,0)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cents(col: Column | str) -> Column:
    """Scale-2 decimal (or integer) money as an exact integer of cents."""
    return (_c(col) * 100).cast(_INT)


def round_ratio(num: Column, den: Column) -> Column:
    """round(num / den) to a long, half away from zero; exact.

    ``num`` and ``den`` are integral (long or decimal(38,0)), ``den`` > 0;
    NULL when either is NULL or ``den`` is 0. The quotient must fit a long.
    """
    n = num.cast(_INT)
    d = den.cast(_INT)
    q = F.call_function("div", (F.abs(n) * 2 + d).cast(_INT), (d * 2).cast(_INT))
    return F.when(d > 0, q * F.signum(n).cast("long"))


def cents_to_money(c: Column, dtype: str = "decimal(18,2)") -> Column:
    """Integer cents -> money decimal, exact."""
    return (c.cast(_INT) / F.lit(100)).cast(dtype)


def avg_money(col: Column | str, dtype: str = "decimal(18,2)") -> Column:
    """ROUND(AVG(col), 2) with exact half-away-from-zero rounding.

    Aggregate expression; NULL when the group has no non-NULL value.
    """
    c = _c(col)
    return cents_to_money(round_ratio(F.sum(cents(c)), F.count(c)), dtype)


def avg_money_from(sum_cents: Column, n: Column, dtype: str = "decimal(18,2)") -> Column:
    """Same rounding from pre-aggregated (sum of cents, count) columns."""
    return cents_to_money(round_ratio(sum_cents, n), dtype)


def share_pct(part_cents: Column, total_cents: Column) -> Column:
    """ROUND(part * 100.0 / total, 2), exact; decimal(18,2)."""
    return cents_to_money(round_ratio(part_cents.cast(_INT) * 10000, total_cents))


def ratio_2dp(num: Column, den: Column) -> Column:
    """ROUND(num::numeric / den, 2) for integral num and den > 0; decimal(18,2)."""
    return cents_to_money(round_ratio(num.cast(_INT) * 100, den))


def currency_text(col: Column | str, symbol: str = "$") -> Column:
    """Money as text: symbol, thousands separators, two decimals (sign first)."""
    c = _c(col)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit(symbol), F.format_number(F.abs(c), 2))
