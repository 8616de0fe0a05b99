"""Cleaning of raw text fields (ETL-1, ETL-2) as column expressions.

All are built-in expressions (try_cast / try_to_date / regexp), so they run
inside whole-stage codegen on any volume; nothing goes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.schemas import DATE_PATTERNS

# Currency marks removed before parsing money (fixed values).
CURRENCY_MARKS = "[$฿,]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _finite(d: Column) -> Column:
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def clean_money(col: Column | str, dtype: str = "decimal(10,2)") -> Column:
    """'$1,234.50' -> 1234.50; '฿99' -> 99; blank, NULL, junk, '(5.00)',
    'nan' and out-of-range values -> 0."""
    s = F.trim(F.regexp_replace(_c(col), CURRENCY_MARKS, ""))
    d = (s).try_cast("double")
    dec = (s).try_cast("decimal(20,4)")
    val = F.when(_finite(d) & dec.isNotNull(), (dec).try_cast(dtype))
    return F.coalesce(val, F.lit(0).cast(dtype))


def clean_int(col: Column | str) -> Column:
    """Text -> float -> truncated int: '5.0' -> 5, '5.9' -> 5, '-1.5' -> -1,
    '1e3' -> 1000; commas are not stripped ('1,000' -> 0); blank, junk,
    NaN and infinities -> 0."""
    d = (F.trim(_c(col))).try_cast("double")
    ok = _finite(d) & (F.abs(d) < 2147483648.0)
    return F.when(ok, d.cast("int")).otherwise(F.lit(0))


def clean_date(col: Column | str) -> Column:
    """First matching layout of DATE_PATTERNS wins (so 03/04/2026 is 4 March
    and 13/04/2026 is 13 April); blank, 'N/A' and unparsable -> NULL."""
    c = _c(col)
    parsed = [F.try_to_date(c, p) for p in DATE_PATTERNS]
    return F.when((c.isNull()) | (c == "") | (c == "N/A"), F.lit(None).cast("date")).otherwise(F.coalesce(*parsed))


def format_code(prefix: str, n: Column) -> Column:
    """prefix + number zero-padded to 3 digits, never truncated (ITM1000)."""
    return F.format_string(prefix + "%03d", n.cast("long"))


def code_number(code: Column, prefix: str) -> Column:
    """Numeric suffix of a code with the given prefix, NULL when the suffix
    is not a number (such codes are skipped, not fatal)."""
    return F.when(
        code.startswith(prefix), (F.substring(code, len(prefix) + 1, 1 << 20)).try_cast("long")
    )
