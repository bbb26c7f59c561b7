"""Budget: a record table of expected / executed revenues and expenses.

Signed values, effective-budget filter, totals, summaries by status /
contract / tags / type, tag token counts, the automatic status update, the
column-formula registry and the recurrence expansion of an annual budget.
Summaries are aggregates (partial + final); no row travels to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the budget table layout (same as the reference).
BUDGET_DATA_COLUMNS = [
    "Type", "Status", "Contract", "Name", "Value",
    "Date_Due", "Date_Exe", "Tags", "Method", "Protocol",
    "File_Receipt", "File_Invoice", "File_NF",
]
NON_EFFECTIVE_STATUS = ["Prospected", "Cancelled"]


def signed(df: DataFrame) -> DataFrame:
    """``Sign`` = 1 for Revenue, -1 for anything else (NULL included);
    ``Value_Signed`` = Sign * Value."""
    sign = F.when(F.col("Type") == "Revenue", F.lit(1)).otherwise(F.lit(-1))
    return df.withColumn("Sign", sign).withColumn("Value_Signed", F.col("Sign") * F.col("Value"))


def effective(df: DataFrame) -> DataFrame:
    """Drop Prospected and Cancelled rows; NULL status is kept."""
    cond = F.lit(True)
    for s in NON_EFFECTIVE_STATUS:
        cond = cond & ~F.col("Status").eqNullSafe(s)
    return df.filter(cond)


def _scope(df: DataFrame, filter_effective: bool) -> DataFrame:
    return effective(df) if filter_effective else df


def totals(df: DataFrame, filter_effective: bool = True) -> DataFrame:
    """One row: ``Total_Revenue``, ``Total_Expenses`` (sums of signed values
    of that type, rounded to 3 decimals, 0 when none), ``Total_Net`` and
    ``Ascending`` (summaries sort ascending when the net is <= 0)."""
    d = _scope(df, filter_effective)
    vt = d.schema["Value_Signed"].dataType
    zero = F.lit(0).cast(vt)
    agg = d.agg(
        F.coalesce(F.sum(F.when(F.col("Type") == "Revenue", F.col("Value_Signed"))), zero).alias("r"),
        F.coalesce(F.sum(F.when(F.col("Type") == "Expense", F.col("Value_Signed"))), zero).alias("e"),
    )
    rev = F.bround(F.col("r"), 3)
    exp = F.bround(F.col("e"), 3)
    return agg.select(rev.cast("double").alias("Total_Revenue"),
                      exp.cast("double").alias("Total_Expenses"),
                      (rev + exp).cast("double").alias("Total_Net"),
                      ((rev + exp) <= 0).alias("Ascending"))


def summary_by(df: DataFrame, key: str, filter_effective: bool = True,
               ascending: bool | None = None) -> DataFrame:
    """Sum of signed values per ``key`` (NULL keys dropped, as a pandas
    group-by does), ordered by value: ascending when the budget's net
    (revenue + expenses, NULL keys included) is <= 0.

    The direction shapes the plan (the sort order), so it is one scalar of
    ``totals`` fetched first (a global aggregate, partial before its
    shuffle); pass ``ascending`` to skip that job.
    """
    d = _scope(df, filter_effective)
    out = (d.filter(F.col(key).isNotNull()).groupBy(key)
           .agg(F.sum("Value_Signed").cast("double").alias("Value_Signed")))
    if ascending is None:
        ascending = bool(totals(df, filter_effective).first()["Ascending"])
    return out.orderBy(F.col("Value_Signed").asc() if ascending else F.col("Value_Signed").desc())


def tag_tokens(df: DataFrame, filter_effective: bool = True) -> DataFrame:
    """Whitespace tokens of ``Tags`` with their counts, most frequent first."""
    d = _scope(df, filter_effective)
    tok = d.select(F.explode(F.split(F.trim(F.col("Tags")), r"\s+")).alias("token"))
    return (tok.filter(F.col("token") != "").groupBy("token")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "token"))


def summary_by_type(df: DataFrame, filter_effective: bool = True) -> DataFrame:
    """Long form of the totals: ``measure, value`` (Total_Expenses,
    Total_Revenue, Total_Net), ordered by value in the totals' direction."""
    t = totals(df, filter_effective)
    rows = t.select("Ascending", F.explode(F.array(
        F.struct(F.lit("Total_Expenses").alias("measure"), F.col("Total_Expenses").alias("value")),
        F.struct(F.lit("Total_Revenue").alias("measure"), F.col("Total_Revenue").alias("value")),
        F.struct(F.lit("Total_Net").alias("measure"), F.col("Total_Net").alias("value")),
    )).alias("r"))
    return rows.select("r.measure", "r.value", "Ascending").withColumn(
        "_k", F.when(F.col("Ascending"), F.col("value")).otherwise(-F.col("value"))
    ).orderBy("_k").drop("_k", "Ascending")


def auto_status(as_of: str, date_col: str = "Date_Due") -> Column:
    """``Executed`` for automatic, expected items due on or before
    ``as_of``; otherwise the current status (NULL due date never fires)."""
    due = F.col(date_col).cast("timestamp_ntz")
    now = F.to_timestamp_ntz(F.lit(as_of))
    fire = (F.col("Method") == "Automatic") & (F.col("Status") == "Expected") & (due <= now)
    return F.when(F.coalesce(fire, F.lit(False)), F.lit("Executed")).otherwise(F.col("Status"))


Formula = Callable[[DataFrame], Column]


def apply_formulas(df: DataFrame, formulas: dict[str, Formula]) -> DataFrame:
    """Spreadsheet-like column formulas, applied in order: each formula
    receives the frame with the earlier results already in place."""
    for name, formula in formulas.items():
        df = df.withColumn(name, formula(df))
    return df


def budget_formulas(as_of: str) -> dict[str, Formula]:
    """The budget's formula registry: signed value and automatic status."""
    return {
        "Sign": lambda d: F.when(F.col("Type") == "Revenue", F.lit(1)).otherwise(F.lit(-1)),
        "Value_Signed": lambda d: F.col("Sign") * F.col("Value"),
        "Status": lambda d: auto_status(as_of),
    }


# Names in pandas offset aliases.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
# An alias without its anchor has this one.
DEFAULT_ANCHORS = {"W": "SUN", "QS": "JAN", "QE": "DEC", "BQS": "JAN", "BQE": "DEC",
                   "YS": "JAN", "YE": "DEC", "BYS": "JAN", "BYE": "DEC"}
_FREQ = r"^(\d*)([A-Z]+)(?:-([0-9A-Z]+))?$"


def date_rules(spark: SparkSession, year: int) -> DataFrame:
    """``rule, date, i``: the dates of every offset rule from Jan 1 of ``year`` to
    Jan 1 of the next, both included, numbered from 0.

    D days, B weekdays, W-SUN.. weekdays by name; MS / ME month starts and ends,
    BMS / BME those on business days; SMS the 1st and 15th, SME the 15th and the
    last; QS- / QE- / YS- / YE- with their anchor month, BQS-.. on business days;
    WOM-1MON.. the n-th weekday of a month.  A few thousand rows, whatever the
    data.
    """
    start = F.lit(f"{year}-01-01").cast("date")
    end = F.lit(f"{year + 1}-01-01").cast("date")
    days = spark.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias("date"))
    d, day, month = F.col("date"), F.dayofmonth("date"), F.month("date")
    left = F.datediff(F.last_day("date"), "date")  # days to the month's end
    weekday = F.weekday("date")  # Monday is 0
    business = weekday < 5
    first, last = day == 1, left == 0
    opens = business & (first | ((weekday == 0) & (day <= 3)))
    closes = business & (last | ((weekday == 4) & (left <= 2)))
    name = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), weekday + 1)

    def rule(when: Column, text: Column) -> Column:
        return F.when(when, text)

    rules = [rule(F.lit(True), F.lit("D")), rule(business, F.lit("B")), rule(F.lit(True), F.concat(F.lit("W-"), name)),
             rule(first | (day == 15), F.lit("SMS")), rule(last | (day == 15), F.lit("SME")),
             rule(day <= 28, F.concat(F.lit("WOM-"), F.ceil(day / 7).cast("string"), name))]
    for prefix, begins, ends in (("", first, last), ("B", opens, closes)):
        for suffix, at in (("S", begins), ("E", ends)):
            rules.append(rule(at, F.lit(f"{prefix}M{suffix}")))
            for n, anchor in enumerate(MONTHS, start=1):
                rules.append(rule(at & (F.pmod(month - n, F.lit(3)) == 0), F.lit(f"{prefix}Q{suffix}-{anchor}")))
                rules.append(rule(at & (month == n), F.lit(f"{prefix}Y{suffix}-{anchor}")))
    tagged = days.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), d)
    return tagged.withColumn("i", F.row_number().over(Window.partitionBy("rule").orderBy("date")) - 1)


def parsed_frequency(freq: Column) -> tuple[Column, Column]:
    """``(rule, n)`` of a frequency such as ``2W-MON`` or ``QS``: every n-th date
    of the rule.  NULL where the text has no such form or n is 0."""
    count, unit, anchor = (F.regexp_extract(freq, _FREQ, i) for i in (1, 2, 3))
    n = F.when(count == "", F.lit(1)).otherwise(count.try_cast("int"))
    default = F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_ANCHORS.items() for x in kv]), unit)
    rule = F.concat_ws("-", unit, F.coalesce(F.nullif(anchor, F.lit("")), default))
    return F.when((unit != "") & (n > 0), rule), n


def expand_annual(template: DataFrame, year: int, freq_col: str = "Freq") -> DataFrame:
    """Repeat each template row for every date of its frequency in ``year``
    (``Date_Due`` set to that date).

    The rules' dates are a fixed small table that every task gets, so a row is
    expanded where it is read.  A leading number n takes every n-th date, from
    the first on.  Rows of an unknown frequency are in ``expand_quarantine``.
    """
    rule, n = parsed_frequency(F.col(f"`{freq_col}`"))
    others = [F.col(f"`{c}`") for c in template.columns if c != "Date_Due"]
    rows = template.select(F.struct(*others).alias("_row"), rule.alias("_rule"), n.alias("_n"))
    dates = F.broadcast(date_rules(template.sparkSession, year))
    hit = (F.col("_rule") == F.col("rule")) & (F.pmod(F.col("i"), F.col("_n")) == 0)
    return rows.join(dates, hit).select("_row.*", F.col("date").alias("Date_Due"))


def expand_quarantine(template: DataFrame, year: int, freq_col: str = "Freq") -> DataFrame:
    """Template rows that ``expand_annual`` cannot expand, with a ``reason``: no
    such frequency, or one without a date in the year."""
    rule, _ = parsed_frequency(F.col(f"`{freq_col}`"))
    known = F.broadcast(date_rules(template.sparkSession, year).select("rule").distinct())
    rows = template.withColumn("_rule", rule)
    return rows.join(known, F.col("_rule") == F.col("rule"), "left_anti").drop("_rule").withColumn("reason", F.lit("bad_frequency"))
