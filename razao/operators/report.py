"""Yearly cash-flow report: monthly panel with one column per category and
flow, running account balance from an opening-balance table, and the yearly
summary by category.

Plan shape: the year's transactions are filtered (pushed to the scan) and
aggregated once into a long table ``(Mes, Flow, Categoria) -> sum`` whose
size is bounded by 12 x 2 x categories.  For the panel that table is
checkpointed to the shared checkpoint folder (category discovery and the
panel both read it; the input is scanned once).  The summary is one
aggregate per (flow, category) plus windows over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import round_half_even
from ..functions.dates import month_key_from_parts
from ..session import ensure_checkpoint_dir
from .cashflow import classify_flows

MAX_PIVOT_CATEGORIES = 1000


def year_filter(df: DataFrame, year: int, date_col: str = "Data") -> DataFrame:
    """Rows of one calendar year, as a range on the date column so that the
    predicate reaches the Parquet scan."""
    lo = F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{year + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    c = F.col(date_col)
    return df.filter((c >= lo) & (c < hi))


def opening_balances(cash_flow: DataFrame) -> DataFrame:
    """Opening balance of each year = net of all earlier years (``Year``,
    ``Value``): the balance table a statement archive would hold, derived
    here from the cash flow itself (one aggregate, then a window over one
    row per year)."""
    net = (cash_flow.filter(F.col("Data").isNotNull())
           .groupBy(F.year("Data").alias("Ano")).agg(F.sum("Valor").alias("net")))
    w = Window.orderBy("Ano").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(net.schema["net"].dataType)
    return net.select(F.col("Ano").alias("Year"),
                      F.coalesce(F.sum("net").over(w), zero).alias("Value"))


def _long_flows(df_year: DataFrame) -> DataFrame:
    """(Mes, Flow, Categoria) -> sum, grouped on the integer month; the
    ``yyyy-MM`` text is formatted on the aggregated rows."""
    df = classify_flows(df_year)
    g = df.groupBy(F.year("Data").alias("_y"), F.month("Data").alias("_mm"), "Flow", "Categoria") \
        .agg(F.sum("Valor").alias("v"))
    return g.select(month_key_from_parts("_y", "_mm").alias("Mes"), "Flow", "Categoria", "v")


def cashflow_long(cash_flow: DataFrame, year: int) -> DataFrame:
    """The panel in long form, ``Mes, Flow, Categoria, Valor`` (one row per
    month, flow and category with movements): the shape to use when there
    are too many categories for one column each."""
    return _long_flows(year_filter(cash_flow, year)).withColumn("v", F.col("v").cast("double")) \
        .withColumnRenamed("v", "Valor")


def _category_columns(long: DataFrame, max_categories: int) -> list[tuple[str, str, str]]:
    """(flow, category, column name); a category present in both flows gets
    ``__In`` / ``__Out`` suffixes so the two columns do not clash."""
    rows = (long.filter(F.col("Categoria").isNotNull())
            .select("Flow", "Categoria").distinct()
            .orderBy("Flow", "Categoria").limit(max_categories + 1).collect())
    if len(rows) > max_categories:
        raise ValueError(
            f"more than {max_categories} category columns; use cashflow_panel_map() instead")
    pairs = [(r["Flow"], r["Categoria"]) for r in rows]
    ins = {c for f, c in pairs if f == "In"}
    outs = {c for f, c in pairs if f == "Out"}
    both = ins & outs
    return [(f, c, f"{c}__{f}" if c in both else c) for f, c in pairs]


def cashflow_panel_map(cash_flow: DataFrame, year: int) -> DataFrame:
    """Monthly panel for any number of categories: ``Ano, Mes, Fluxo, Entradas,
    Saidas`` and the MAP columns ``Entradas_Categoria`` and
    ``Saidas_Categoria`` (category -> sum) of the months with movements.  One
    aggregate of the year's rows; nothing comes to the driver."""
    long = _long_flows(year_filter(cash_flow, year))

    def total(flow: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("Flow") == flow, F.col("v"))), F.lit(0)).cast("double")

    def by_category(flow: str) -> Column:
        entry = F.when((F.col("Flow") == flow) & F.col("Categoria").isNotNull(),
                       F.struct("Categoria", F.col("v").cast("double")))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    per_month = long.groupBy("Mes").agg(
        total("In").alias("Entradas"), total("Out").alias("Saidas"),
        by_category("In").alias("Entradas_Categoria"), by_category("Out").alias("Saidas_Categoria"))
    return per_month.select(F.lit(year).alias("Ano"), "Mes", (F.col("Entradas") + F.col("Saidas")).alias("Fluxo"),
                            "Entradas", "Saidas", "Entradas_Categoria", "Saidas_Categoria")


def cashflow_panel(cash_flow: DataFrame, year: int, opening=None,
                   max_categories: int = MAX_PIVOT_CATEGORIES) -> DataFrame:
    """Monthly panel of ``year``: ``Ano, Mes, Fluxo, Entradas, Saidas``, one
    column per inflow and per outflow category, ``Saldo`` (opening balance +
    running net) and ``Saldo_Inicial_Found`` (False when the opening-balance
    table has no row for the year and 0 was used).

    ``opening`` is a number, or a DataFrame ``(Year, Value)`` whose value for
    the year is read as a scalar subquery; None means 0.
    """
    ensure_checkpoint_dir(cash_flow.sparkSession)
    long = _long_flows(year_filter(cash_flow, year)).checkpoint(eager=True)
    cols = _category_columns(long, max_categories)
    cal = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_mm")
    months = (long.sparkSession.range(1).select(cal)
              .select(F.lit(year).alias("Ano"), month_key_from_parts(F.lit(year), "_mm").alias("Mes")))
    money = long.schema["v"].dataType
    zero = F.lit(0).cast(money)
    is_in = F.col("Flow") == "In"
    aggs = [F.sum(F.when(is_in, F.col("v"))).alias("Entradas"),
            F.sum(F.when(~is_in, F.col("v"))).alias("Saidas")]
    for flow, cat, name in cols:
        aggs.append(F.sum(F.when((F.col("Flow") == flow) & (F.col("Categoria") == cat),
                                 F.col("v"))).alias(name))
    per_month = long.groupBy("Mes").agg(*aggs)
    value_cols = ["Entradas", "Saidas"] + [n for _, _, n in cols]
    panel = months.join(per_month, "Mes", "left").select(
        "Ano", "Mes", *[F.coalesce(F.col(f"`{c}`"), zero).alias(c) for c in value_cols])
    panel = panel.withColumn("Fluxo", F.col("Entradas") + F.col("Saidas"))

    if isinstance(opening, DataFrame):
        # a lookup of one value among the balances of the year (none: 0, and
        # the flag is False)
        of_year = opening.filter(F.col("Year") == year)
        # (largest of several balances, found): one subquery, one scan
        found = of_year.agg(F.struct(F.max("Value").cast(money).alias("value"),
                                     (F.count(F.lit(1)) > 0).alias("found"))).scalar()
        panel = panel.withColumns({
            "_open": F.coalesce(found["value"], zero),
            "Saldo_Inicial_Found": found["found"],
        })
    else:
        panel = panel.withColumns({
            "_open": F.lit(float(opening or 0.0)).cast(money),
            "Saldo_Inicial_Found": F.lit(opening is not None),
        })
    w = Window.orderBy("Mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    panel = panel.withColumn("Saldo", F.col("_open") + F.sum("Fluxo").over(w))
    ordered = ["Ano", "Mes", "Fluxo", "Entradas", "Saidas", *[n for _, _, n in cols],
               "Saldo", "Saldo_Inicial_Found"]
    money_cols = [c for c in ordered if c not in ("Ano", "Mes", "Saldo_Inicial_Found")]
    return panel.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in money_cols
                          else F.col(c) for c in ordered])


def cashflow_summary(cash_flow: DataFrame, year: int) -> DataFrame:
    """Yearly summary: ``Ano, Categoria, Total, Media, Pct_Entradas`` with the
    rows ENTRADAS, SAIDAS and one per (flow, category) column of the panel.

    ``Media`` is the mean over the 12 months (zeros included);
    ``Pct_Entradas`` = |Total| / total inflow * 100, 0 when there is no
    inflow.  One aggregate per (flow, category) over the year's rows; the
    total inflow is a scalar subquery over those rows, the two total rows a
    one-row aggregate of them, and the name clash rule a window per
    category (at most two rows each).
    """
    df = classify_flows(year_filter(cash_flow, year))
    g = df.groupBy("Flow", "Categoria").agg(F.sum("Valor").alias("Total"))
    money = g.schema["Total"].dataType
    zero = F.lit(0).cast(money)
    e_sum = F.coalesce(F.sum(F.when(F.col("Flow") == "In", F.col("Total"))), zero)
    s_sum = F.coalesce(F.sum(F.when(F.col("Flow") == "Out", F.col("Total"))), zero)
    n_flows = F.size(F.collect_set("Flow").over(Window.partitionBy("Categoria")))
    per_cat = (g.filter(F.col("Categoria").isNotNull()).withColumn("_nf", n_flows)
               .select(F.when(F.col("_nf") > 1, F.concat("Categoria", F.lit("__"), "Flow"))
                       .otherwise(F.col("Categoria")).alias("Categoria"), "Total"))
    totals = g.agg(e_sum.alias("E"), s_sum.alias("S")).select(F.explode(F.array(
        F.struct(F.lit("ENTRADAS").alias("Categoria"), F.col("E").alias("Total")),
        F.struct(F.lit("SAIDAS").alias("Categoria"), F.col("S").alias("Total")),
    )).alias("r")).select("r.Categoria", "r.Total")
    inflow = g.agg(e_sum.alias("E")).scalar()
    e = inflow.cast("double")
    pct = F.when(F.col("Categoria") == "ENTRADAS", F.lit(100.0)).when(
        e == 0, F.lit(0.0)).otherwise(F.abs(F.col("Total").cast("double")) / e * 100)
    return totals.unionByName(per_cat).select(
        F.lit(year).alias("Ano"), "Categoria",
        round_half_even(F.col("Total").cast("double"), 2).alias("Total"),
        # exact decimal mean: Total / 12 can end in an exact 5 at the third
        # decimal, which float rounding would resolve either way
        round_half_even(F.col("Total") / 12, 2).cast("double").alias("Media"),
        round_half_even(pct, 2).alias("Pct_Entradas"),
    )


def account_balances(cash_flow: DataFrame, opening: DataFrame, account_col: str = "Conta") -> DataFrame:
    """Monthly running balance of every account over all its years:
    ``<account>, Ano, Mes, Entradas, Saidas, Fluxo, Saldo, Saldo_Inicial_Found``.

    ``opening`` has ``<account>, Year, Value``.  The balance starts anew at each
    opening balance (the largest, if a year has several) and runs on over years
    without one; before the first it starts at 0.  ``Saldo_Inicial_Found`` tells
    whether the month's own year has an opening balance.  The transactions are
    aggregated once; all windows run over the months of an account.
    """
    money = cash_flow.schema["Valor"].dataType
    flows = cash_flow.where(F.col("Data").isNotNull()).groupBy(
        account_col, F.year("Data").alias("Ano"), F.month("Data").alias("_mm")).agg(
        F.sum(F.when(F.col("Valor") >= 0, F.col("Valor"))).alias("Entradas"),
        F.sum(F.when(F.col("Valor") < 0, F.col("Valor"))).alias("Saidas"))
    start = opening.where("Year is not null and Value is not null").groupBy(
        account_col, F.col("Year").cast("int").alias("Ano")).agg(F.max("Value").alias("_open"))
    months = flows.unionByName(start.select(account_col, "Ano", F.lit(1).alias("_mm")), allowMissingColumns=True)
    # twelve months for each year from an account's first to its last
    span = months.groupBy(account_col).agg(F.min("Ano").alias("_lo"), F.max("Ano").alias("_hi"))
    calendar = span.select(account_col, F.explode(F.sequence("_lo", "_hi")).alias("Ano")).select(
        account_col, "Ano", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_mm"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (account_col, "Ano", "_mm")]
    dense = calendar.alias("c").join(flows.alias("f"), same, "left").select("c.*", "f.Entradas", "f.Saidas")
    years = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (account_col, "Ano")]
    zero = F.lit(0).cast(money)
    dense = dense.alias("c").join(start.alias("s"), years, "left").select(
        f"c.{account_col}", "c.Ano", "c._mm", F.coalesce("c.Entradas", zero).alias("Entradas"),
        F.coalesce("c.Saidas", zero).alias("Saidas"), F.col("s._open").cast(money).alias("_open"))
    in_order = Window.partitionBy(account_col).orderBy("Ano", "_mm")
    opens = F.when(F.col("_mm") == 1, F.col("_open"))
    dense = dense.withColumns({"Fluxo": F.col("Entradas") + F.col("Saidas"), "_segment": F.count(opens).over(in_order),
                               "_first": opens})
    segment = Window.partitionBy(account_col, "_segment").orderBy("Ano", "_mm") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dense.select(account_col, "Ano", month_key_from_parts("Ano", "_mm").alias("Mes"), "Entradas", "Saidas", "Fluxo",
                        (F.coalesce(F.first("_first").over(segment), zero) + F.sum("Fluxo").over(segment)).alias("Saldo"),
                        F.col("_open").isNotNull().alias("Saldo_Inicial_Found"))
