"""Date and interval columns: strict statement dates, statement-year dates,
time index, running time and interval breakdown / text."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def br_date(col: Column | str) -> Column:
    """``dd/MM/yyyy`` text (also ``d/M/yyyy``) -> DATE; invalid text gives NULL
    (quarantine)."""
    return F.try_to_date(strip_ws(_c(col)), "d/M/yyyy")


def day_month_in_year(day_month: Column | str, year: Column | str | int) -> Column:
    """``dd/MM`` text plus a statement year -> DATE (NULL when invalid)."""
    y = F.lit(year) if isinstance(year, int) else _c(year)
    return F.try_to_date(F.concat(strip_ws(_c(day_month)), F.lit("/"), y.cast("string")),
                         "d/M/yyyy")


def year_of(col: Column | str) -> Column:
    """Calendar year (``Ano``) as INT."""
    return F.year(_c(col))


def month_key(col: Column | str) -> Column:
    """``yyyy-MM`` month key (``Mes``)."""
    return F.date_format(_c(col), "yyyy-MM")


def month_key_from_parts(year: Column | str, month: Column | str) -> Column:
    return F.format_string("%04d-%02d", _c(year), _c(month))


def as_of_literal(as_of: str | _dt.date | _dt.datetime) -> Column:
    """A fixed 'now' as TIMESTAMP_NTZ: operators that read the clock take it."""
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, _dt.datetime) else as_of.isoformat()
    return F.to_timestamp_ntz(F.lit(str(as_of)))


def running_seconds(start: Column | str, as_of: str) -> Column:
    """Whole seconds between ``start`` and ``as_of`` (``now - start``)."""
    end = as_of_literal(as_of)
    s = _c(start).cast("timestamp_ntz")
    # wall-clock difference of zone-less timestamps: no session time zone
    return F.timestamp_diff("SECOND", s, end)


def age_years(start: Column | str, as_of: str) -> Column:
    """Age in whole years: days // 365, truncated toward zero."""
    days = F.datediff(as_of_literal(as_of).cast("date"), _c(start).cast("date"))
    return (days / F.lit(365)).cast("long")


def interval_parts(seconds: Column | str) -> Column:
    """Break a duration in seconds into ``Years, Months, Days, Hours,
    Minutes, Seconds`` with floor semantics: Years = days // 365, Months =
    remaining days // 30; the clock part is always in [0, 1 day)."""
    s = _c(seconds).cast("long")
    days = F.floor(s / 86400).cast("long")
    rest = s - days * 86400
    years = F.floor(days / 365).cast("long")
    rdays = days - years * 365
    months = F.floor(rdays / 30).cast("long")
    return F.struct(
        years.alias("Years"),
        months.alias("Months"),
        (rdays - months * 30).alias("Days"),
        F.floor(rest / 3600).cast("long").alias("Hours"),
        F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("long").alias("Minutes"),
        F.pmod(rest, F.lit(60)).cast("long").alias("Seconds"),
    )


# Fixed labels of the human-readable running time (same as the reference).
HUMAN_LABELS = {"Years": "yr", "Months": "mth"}


def interval_text(parts: Column | str, labels: dict[str, str] | None = None) -> Column:
    """``"yr: 3, mth: 2"`` text of ``interval_parts``: one ``label: value``
    item per requested part, in the order given."""
    p = _c(parts)
    labels = labels or HUMAN_LABELS
    items = [F.concat(F.lit(f"{label}: "), p[field].cast("string"))
             for field, label in labels.items()]
    return F.concat_ws(", ", *items)
