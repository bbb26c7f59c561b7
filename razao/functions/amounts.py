"""Money columns: Brazilian number text, credit/debit suffixes, ratios,
rounding and currency text.  Every function returns a ``Column`` built from
Spark SQL built-ins, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .text import strip_ws

# Exact money type of canonical tables.  Sums stay exact (no float order
# effects); results are cast to DOUBLE only at the output.
MONEY = DecimalType(18, 2)
# Parsed statement amounts keep up to ten decimals: the personal-account
# rule reads "1.23456" (no comma) as 1.23456, which MONEY would round.
AMOUNT = DecimalType(30, 10)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def br_amount(col: Column | str) -> Column:
    """Personal-account amount: only text with a comma is Brazilian.

    ``"5.000,00"`` -> 5000.00, ``"-403,00"`` -> -403.00 and ``"1.234"`` ->
    1.234 (dot kept as decimal point when there is no comma).  Text that is
    not a number gives NULL (``try_cast``) so the caller can quarantine it.
    """
    s = strip_ws(_c(col))
    normal = F.when(
        s.contains(","), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    ).otherwise(s)
    return normal.try_cast(AMOUNT)


def br_number(col: Column | str) -> Column:
    """Plain Brazilian number: drop every ``.``, then ``,`` -> ``.``."""
    s = strip_ws(_c(col))
    return F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(AMOUNT)


def cd_amount(col: Column | str) -> Column:
    """Company / savings amount with a ``C`` or ``D`` suffix.

    All ``C``/``D`` letters are removed, the rest is a plain Brazilian number
    taken as absolute value; the result is negative only when the trimmed text
    ends with ``D``.  Without a suffix the sign is lost (reference behaviour).
    """
    s = strip_ws(_c(col))
    value = F.abs(br_number(F.regexp_replace(s, "[CD]", "")))
    return F.when(s.endswith(F.lit("D")), -value).otherwise(value)


def to_money(col: Column | str) -> Column:
    """Cast a numeric column to the exact money type."""
    return _c(col).cast(MONEY)


def flow_class(col: Column | str) -> Column:
    """``In`` for values >= 0, ``Out`` otherwise (NULL counts as ``Out``)."""
    return F.when(_c(col) >= 0, F.lit("In")).otherwise(F.lit("Out"))


def ratio_or_default(num: Column | str, den: Column | str, default: float = 100.0) -> Column:
    """``abs(num) / abs(den)`` with float division semantics.

    0/0 (and NULLs) give ``default``; x/0 with x != 0 gives +infinity.  ANSI
    Spark would raise on the division, so the zero cases are written out.
    """
    n = F.abs(_c(num)).cast("double")
    d = F.abs(_c(den)).cast("double")
    return (
        F.when(n.isNull() | d.isNull(), F.lit(default))
        .when(d == 0, F.when(n == 0, F.lit(default)).otherwise(F.lit(float("inf"))))
        .otherwise(n / d)
    )


def round_half_even(col: Column | str, scale: int = 2) -> Column:
    """Banker's rounding, as pandas ``round`` does on the reference side."""
    return F.bround(_c(col), scale)


def currency_text(col: Column | str) -> Column:
    """Right-aligned amount text: width 11, thousands ``,``, 2 decimals, and a
    trailing `` +`` / `` -`` sign, e.g. ``"   1,234.50 -"``.  Wider values are
    not truncated."""
    v = _c(col).cast("double")
    body = F.format_number(F.abs(v), 2)
    padded = F.lpad(body, F.greatest(F.lit(11), F.length(body)), " ")
    return F.concat(padded, F.when(v < 0, F.lit(" -")).otherwise(F.lit(" +")))
