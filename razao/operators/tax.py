"""Tax-bracket lookups (INSS contribution, IRRF withholding).

Each amount finds the one bracket whose half-open interval ``(previous
upper, upper]`` contains it (the first IRRF bracket starts at its own lower
bound).  The bracket tables are four fixed rows, so the lookup is compiled
into one CASE expression over the amount: a projection inside whole-stage
code generation, with no join and no shuffle.  Amounts above the last INSS
bracket and below the first IRRF bracket get NULL.  ``inss_table`` /
``irrf_table`` expose the same tables as DataFrames.

``lookup`` takes any bracket table as data, with several versions by date:
``table, valid_from, lo, hi, rate, deduction`` (``lo`` NULL: no lower bound, ``hi``
NULL: no upper one; a later version replaces the whole table).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .windows import chunked_forward_fill

RATE = DecimalType(6, 4)
BOUND = DecimalType(18, 2)

# 2025 tables (same as the reference).
# INSS: (upper bound of the bracket, rate)
INSS_2025 = [(1518.00, 0.075), (2793.88, 0.09), (4190.83, 0.12), (8157.41, 0.14)]
# IRRF: (lower bound, upper bound or None for no limit, rate, deduction)
IRRF_2025 = [
    (2428.81, 2826.65, 0.075, 182.16),
    (2826.66, 3751.05, 0.15, 394.16),
    (3751.06, 4664.68, 0.225, 675.49),
    (4664.68, None, 0.275, 908.73),
]


def _dec(v):
    return None if v is None else Decimal(str(v))


def inss_table(spark: SparkSession) -> DataFrame:
    """``bracket, lo_excl, hi, rate``: bracket i covers (upper[i-1], upper[i]]."""
    rows = [(i + 1, _dec(hi), _dec(rate)) for i, (hi, rate) in enumerate(INSS_2025)]
    df = spark.createDataFrame(rows, f"bracket int, hi {BOUND.simpleString()}, rate {RATE.simpleString()}")
    w = Window.orderBy("bracket")
    return df.withColumn("lo_excl", F.lag("hi").over(w))


def irrf_table(spark: SparkSession) -> DataFrame:
    """``bracket, lo, lo_excl, hi, rate, deduction``.  Consecutive IRRF rows
    share 4664.68 as an end point, so membership is ``(previous hi, hi]``;
    the first bracket starts at its own lower bound (inclusive)."""
    rows = [(i + 1, _dec(lo), _dec(hi), _dec(rate), _dec(ded))
            for i, (lo, hi, rate, ded) in enumerate(IRRF_2025)]
    b = BOUND.simpleString()
    df = spark.createDataFrame(
        rows, f"bracket int, lo {b}, hi {b}, rate {RATE.simpleString()}, deduction {b}")
    w = Window.orderBy("bracket")
    return df.withColumn("lo_excl", F.lag("hi").over(w))


def _brackets(amount, rows):
    """CASE over bracket rows ``(lo_inclusive, lo_exclusive, hi, payload)``:
    the payload struct of the first matching bracket, else NULL."""
    out = None
    for lo_inc, lo_exc, hi, payload in rows:
        cond = F.lit(True)
        if lo_exc is not None:
            cond = cond & (amount > F.lit(lo_exc).cast(BOUND))
        elif lo_inc is not None:
            cond = cond & (amount >= F.lit(lo_inc).cast(BOUND))
        if hi is not None:
            cond = cond & (amount <= F.lit(hi).cast(BOUND))
        out = F.when(cond, payload) if out is None else out.when(cond, payload)
    return out


def inss(df: DataFrame, amount_col: str) -> DataFrame:
    """Add ``inss_bracket`` and ``inss_rate`` (NULL above the ceiling)."""
    a = F.col(amount_col).cast(BOUND)
    rows, prev = [], None
    for i, (hi, rate) in enumerate(INSS_2025, start=1):
        rows.append((None, _dec(prev), _dec(hi),
                     F.struct(F.lit(i).alias("b"), F.lit(_dec(rate)).cast(RATE).alias("r"))))
        prev = hi
    hit = _brackets(a, rows)
    return df.withColumns({"inss_bracket": hit["b"], "inss_rate": hit["r"]})


def irrf(df: DataFrame, amount_col: str) -> DataFrame:
    """Add ``irrf_bracket``, ``irrf_rate``, ``irrf_deduction`` and
    ``irrf_tax`` = amount * rate - deduction (NULL below the exemption)."""
    a = F.col(amount_col).cast(BOUND)
    rows, prev = [], None
    for i, (lo, hi, rate, ded) in enumerate(IRRF_2025, start=1):
        payload = F.struct(F.lit(i).alias("b"), F.lit(_dec(rate)).cast(RATE).alias("r"),
                           F.lit(_dec(ded)).cast(BOUND).alias("d"))
        rows.append((_dec(lo), _dec(prev), _dec(hi), payload))
        prev = hi
    hit = _brackets(a, rows)
    return df.withColumns({
        "irrf_bracket": hit["b"], "irrf_rate": hit["r"], "irrf_deduction": hit["d"],
        "irrf_tax": a * hit["r"] - hit["d"],
    })


BRACKETS = f"table string, valid_from date, lo {BOUND.simpleString()}, hi {BOUND.simpleString()}, " \
           f"rate {RATE.simpleString()}, deduction {BOUND.simpleString()}"
_CENTS = 100
_LOWEST = -(10 ** 18)


def _cents(c: Column) -> Column:
    return (c.cast(BOUND) * _CENTS).cast("long")


def _starts(brackets: DataFrame) -> DataFrame:
    """Brackets with their first and last cent; a bracket starts after the one before it ends."""
    w = Window.partitionBy("table", "valid_from").orderBy(F.col("lo").asc_nulls_first(), F.col("hi").asc_nulls_last())
    x = brackets.withColumns({"before": F.lag("hi").over(w), "bracket": F.row_number().over(w)})
    start = F.greatest(F.coalesce(_cents(F.col("lo")), F.lit(_LOWEST)), F.coalesce(_cents(F.col("before")) + 1, F.lit(_LOWEST)))
    return x.withColumns({"start": start, "end": _cents(F.col("hi"))})


def overlaps(brackets: DataFrame) -> DataFrame:
    """Brackets that begin before the one below them ends, or below one without an end."""
    x = _starts(brackets)
    return x.where((F.col("lo") <= F.col("before")) | ((F.col("bracket") > 1) & F.col("before").isNull())) \
        .select("table", "valid_from", "bracket", "lo", F.col("before").alias("hi_below"))


def lookup(df: DataFrame, amount_col: str, date_col: str, brackets: DataFrame, table: str) -> DataFrame:
    """Add ``bracket, rate, deduction`` of the table version valid at the row's date (NULL: none).

    Dates find their version, and distinct amounts their bracket, by a sorted
    union with the table's own dates and first cents and a forward fill, in
    chunks, so a version that most rows fall under is not one task.  The rows
    take both answers by equality.  Of overlapping brackets the lower one holds
    up to its end.
    """
    own = _starts(brackets.where(F.col("table") == table)).drop("table")
    day = F.datediff(F.col("_date"), F.lit("1900-01-01").cast("date"))
    rows = df.withColumns({"_date": F.col(date_col).cast("date"), "_cents": _cents(F.col(amount_col))})
    # dates -> version
    days = rows.where("_date is not null").select("_date").distinct().select(
        F.lit(1).alias("_all"), F.col("_date"), (day * 2 + 1).cast("long").alias("_pos"), F.lit(None).cast("date").alias("_v"))
    froms = own.select("valid_from").distinct().select(F.col("valid_from").alias("_date")).select(
        F.lit(1).alias("_all"), F.col("_date"), (day * 2).cast("long").alias("_pos"), F.col("_date").alias("_v"))
    version = chunked_forward_fill(days.unionByName(froms), ["_all"], "_pos", "_v", "_version").where("_pos % 2 = 1") \
        .select(F.col("_date").alias("_of_date"), "_version")
    rows = rows.join(version, F.col("_date") == F.col("_of_date"), "left").drop("_of_date")
    # (version, amount) -> bracket
    payload = F.struct("bracket", "end", "rate", "deduction")
    amounts = rows.where("_version is not null and _cents is not null").select("_version", "_cents").distinct().select(
        "_version", "_cents", (F.col("_cents") * 2 + 1).alias("_pos"))
    starts = own.where(F.col("end").isNull() | (F.col("end") >= F.col("start"))).select(
        F.col("valid_from").alias("_version"), (F.col("start") * 2).alias("_pos"), payload.alias("_b"))
    union = amounts.unionByName(starts, allowMissingColumns=True)
    hit = chunked_forward_fill(union, ["_version"], "_pos", "_b", "_hit").where("_cents is not null").select(
        F.col("_version").alias("_of"), F.col("_cents").alias("_of_cents"), "_hit")
    inside = F.col("_hit.end").isNull() | (F.col("_cents") <= F.col("_hit.end"))
    out = rows.join(hit, (F.col("_version") == F.col("_of")) & (F.col("_cents") == F.col("_of_cents")), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[F.when(inside, F.col(f"_hit.{c}")).alias(c) for c in ("bracket", "rate", "deduction")])
