"""Cash-flow analysis: time index, flow classes, dense monthly summary with
within-year cumulatives, yearly roll-up and the consolidated daily table.

Plan shape at scale: the only pass over the transactions is one scan with a
partial (map-side) aggregate on ``(keys, Ano, Mes)``; one shuffle carries the
partials (at most 12 rows per year and key per task).  Calendar densification,
cumulative windows and the yearly roll-up run on those aggregated rows, whose
count does not grow with the number of transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import flow_class, ratio_or_default, round_half_even
from ..functions.dates import month_key, month_key_from_parts, year_of

DEFAULT_CATEGORY = "Geral"
MONTHLY_COLUMNS = [
    "Ano", "Mes", "Categoria", "Entradas", "Entradas_N", "Saidas", "Saidas_N",
    "Fluxo", "Entradas_Acum", "Saidas_Acum", "Fluxo_Acum", "OIR",
]
YEARLY_COLUMNS = [
    "Ano", "Categoria", "Entradas", "Entradas_N", "Saidas", "Saidas_N", "Fluxo",
    "Entradas_Acum", "Saidas_Acum", "Fluxo_Acum", "OIR",
]
_MONEY_OUT = ["Entradas", "Saidas", "Fluxo", "Entradas_Acum", "Saidas_Acum", "Fluxo_Acum"]


def enrich_time_index(df: DataFrame, date_col: str = "Data") -> DataFrame:
    """Add ``Ano`` (INT year) and ``Mes`` (``yyyy-MM``)."""
    return df.withColumns({"Ano": year_of(date_col), "Mes": month_key(date_col)})


def classify_flows(df: DataFrame, value_col: str = "Valor") -> DataFrame:
    """Add ``Flow``: ``In`` when the value is >= 0, else ``Out``."""
    return df.withColumn("Flow", flow_class(value_col))


def filter_category(df: DataFrame, category: str | None) -> tuple[DataFrame, str]:
    """No category: every row, labelled ``Geral``; else rows of that one."""
    if category is None:
        return df, DEFAULT_CATEGORY
    return df.filter(F.col("Categoria") == F.lit(category)), category


def _flow_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, Ano, Mes): inflow / outflow sums and counts (one aggregate,
    partial + final).  ``count`` skips NULL values like pandas does.

    The grouping key is the integer (year, month); the ``yyyy-MM`` text is
    formatted on the aggregated rows only, not once per transaction."""
    is_in = F.col("Valor") >= 0          # the Flow rule; NULL counts as Out
    is_out = ~F.coalesce(is_in, F.lit(False))
    sums = df.groupBy(*keys, F.year("Data").alias("Ano"), F.month("Data").alias("_mm")).agg(
        F.sum(F.when(is_in, F.col("Valor"))).alias("Entradas"),
        F.count(F.when(is_in, F.col("Valor"))).alias("Entradas_N"),
        F.sum(F.when(is_out, F.col("Valor"))).alias("Saidas"),
        F.count(F.when(is_out, F.col("Valor"))).alias("Saidas_N"),
    )
    return sums.withColumn("Mes", month_key_from_parts("Ano", "_mm")).drop("_mm")


def densify_months(sums: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Twelve ``Mes`` rows for every year between each key's first and last
    year with data (years without data included), values filled with 0.

    One aggregate over the already aggregated months: per key the year span
    and a ``Mes -> values`` map (at most 12 entries per year, independent of
    the number of transactions), then the calendar is generated and looked
    up.  No second pass over the input and no join.
    """
    per_key = sums.groupBy(*keys).agg(
        F.min("Ano").alias("_lo"), F.max("Ano").alias("_hi"),
        F.map_from_entries(F.collect_list(F.struct("Mes", F.struct(*values)))).alias("_m"),
    )
    cal = (
        per_key.select(*keys, "_m", F.explode(F.sequence("_lo", "_hi")).alias("Ano"))
        .select(*keys, "_m", "Ano", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_mm"))
        .withColumn("Mes", month_key_from_parts("Ano", "_mm"))
        .withColumn("_v", F.try_element_at("_m", F.col("Mes")))
    )
    filled = []
    for v in values:
        zero = F.lit(0).cast(sums.schema[v].dataType)
        filled.append(F.coalesce(F.col("_v")[v], zero).alias(v))
    return cal.select(*keys, "Ano", "Mes", *filled)


def _cumulative(col: str, window: Window) -> Column:
    return F.sum(col).over(window)


def monthly_summary(df: DataFrame, category: str | None = None,
                    by_category: bool = False, rounded: bool = True, group_by: tuple[str, ...] = ()) -> DataFrame:
    """Dense monthly cash-flow summary.

    ``df`` needs ``Data``, ``Valor`` (exact decimal) and, for a category
    filter or ``by_category``, ``Categoria``.  With ``by_category`` every
    category gets its own calendar (its own year span) in one pass, the
    same rows as running the single-category analysis once per category.
    ``group_by`` columns (such as the account) give a summary each, likewise in
    one pass, and come first in the result.
    """
    keys = [*group_by, "Categoria"] if by_category else [*group_by]
    if by_category:
        df = df.filter(F.col("Categoria").isNotNull())
        label = None
    else:
        df, label = filter_category(df, category)
    sums = _flow_sums(df, keys).filter(F.col("Ano").isNotNull())
    dense = densify_months(sums, keys, ["Entradas", "Entradas_N", "Saidas", "Saidas_N"])
    w = (Window.partitionBy(*keys, "Ano").orderBy("Mes")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = dense.withColumn("Fluxo", F.col("Entradas") + F.col("Saidas")).withColumns({
        "Entradas_Acum": _cumulative("Entradas", w),
        "Saidas_Acum": _cumulative("Saidas", w),
        "Fluxo_Acum": _cumulative("Fluxo", w),
    })
    if not by_category:
        out = out.withColumn("Categoria", F.lit(label))
    out = out.withColumn("OIR", ratio_or_default("Saidas", "Entradas"))
    out = out.select(*group_by, *MONTHLY_COLUMNS)
    return finish(out) if rounded else out


def yearly_summary(monthly: DataFrame, cumulative_across_years: bool = True,
                   rounded: bool = True, group_by: tuple[str, ...] = ()) -> DataFrame:
    """Yearly roll-up of the (unrounded) monthly summary.

    Cumulatives run across years (one in-memory call).  With
    ``cumulative_across_years=False`` they restart each year, which is what
    the per-year file outputs of the batch tool contain.  Rows are per
    ``Categoria`` (a single ``Geral`` label or one per category) and ``group_by``
    columns, as in ``monthly_summary``.
    """
    keys = [*group_by, "Categoria"]
    out = monthly.groupBy(*keys, "Ano").agg(
        F.sum("Entradas").alias("Entradas"),
        F.sum("Entradas_N").alias("Entradas_N"),
        F.sum("Saidas").alias("Saidas"),
        F.sum("Saidas_N").alias("Saidas_N"),
        F.sum("Fluxo").alias("Fluxo"),
    )
    if cumulative_across_years:
        w = (Window.partitionBy(*keys).orderBy("Ano")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumns({
            "Entradas_Acum": _cumulative("Entradas", w),
            "Saidas_Acum": _cumulative("Saidas", w),
            "Fluxo_Acum": _cumulative("Fluxo", w),
        })
    else:
        out = out.withColumns({
            "Entradas_Acum": F.col("Entradas"),
            "Saidas_Acum": F.col("Saidas"),
            "Fluxo_Acum": F.col("Fluxo"),
        })
    out = out.withColumn("OIR", ratio_or_default("Saidas", "Entradas"))
    out = out.select(*group_by, *YEARLY_COLUMNS)
    return finish(out) if rounded else out


def finish(df: DataFrame) -> DataFrame:
    """Output form: money as DOUBLE (2 decimals), ratio rounded half-even."""
    cols = {c: F.col(c).cast("double") for c in _MONEY_OUT if c in df.columns}
    if "OIR" in df.columns:
        cols["OIR"] = round_half_even("OIR", 2)
    return df.withColumns(cols)


def cashflow_analysis(df: DataFrame, category: str | None = None) -> dict[str, DataFrame]:
    """Monthly and yearly summaries of one category (or all as ``Geral``)."""
    monthly = monthly_summary(df, category=category, rounded=False)
    return {"monthly": finish(monthly), "yearly": yearly_summary(monthly)}


# Column order of the daily table: these first, the rest after.
PRIORITY_COLUMNS = ["Data", "Categoria", "Valor", "Descricao"]


def priority_order(df: DataFrame, priority: list[str] = PRIORITY_COLUMNS) -> DataFrame:
    """Put the priority columns first, keep the others in their order."""
    first = [c for c in priority if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def consolidated_daily(df: DataFrame) -> DataFrame:
    """All years of the daily table in one chronological table (``Ano`` is
    kept as the partition column for the writer)."""
    out = priority_order(df).withColumn("Ano", year_of("Data"))
    return out.orderBy("Data", *[c for c in out.columns if c != "Data"])
