"""Cash flow: golden hand-computed case and invariants."""

import datetime as dt
from decimal import Decimal

from razao.operators import cashflow as cfo
from razao.operators import report as rpt

SCHEMA = "Data timestamp_ntz, Categoria string, Valor decimal(18,2), Descricao string"


def golden(spark):
    rows = [
        (dt.datetime(2024, 1, 10), "Venda", Decimal("100.00"), ""),
        (dt.datetime(2024, 1, 20), "Custeio", Decimal("-40.00"), ""),
        (dt.datetime(2024, 3, 5), "Custeio", Decimal("-10.00"), ""),
        (dt.datetime(2024, 3, 6), "Venda", Decimal("0.00"), ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_monthly_golden(spark):
    m = {r.Mes: r for r in cfo.monthly_summary(golden(spark)).collect()}
    assert len(m) == 12
    jan, feb, mar, dec = m["2024-01"], m["2024-02"], m["2024-03"], m["2024-12"]
    assert (jan.Entradas, jan.Entradas_N, jan.Saidas, jan.Saidas_N, jan.Fluxo) == (100, 1, -40, 1, 60)
    assert jan.OIR == 0.4
    assert (feb.Entradas, feb.Saidas, feb.Fluxo, feb.Fluxo_Acum, feb.OIR) == (0, 0, 0, 60, 100)
    assert (mar.Entradas, mar.Entradas_N, mar.Saidas, mar.Fluxo) == (0, 1, -10, -10)
    assert mar.OIR == float("inf")
    assert (dec.Entradas_Acum, dec.Saidas_Acum, dec.Fluxo_Acum, dec.OIR) == (100, -50, 50, 100)
    assert {r.Categoria for r in m.values()} == {"Geral"}


def test_yearly_golden(spark):
    y = cfo.cashflow_analysis(golden(spark))["yearly"].collect()
    assert len(y) == 1
    r = y[0]
    assert (r.Entradas, r.Entradas_N, r.Saidas, r.Saidas_N, r.Fluxo, r.OIR) == (100, 2, -50, 2, 50, 0.5)


def test_category_filter_and_by_category(spark):
    one = cfo.monthly_summary(golden(spark), category="Custeio").collect()
    allc = cfo.monthly_summary(golden(spark), by_category=True).filter("Categoria = 'Custeio'").collect()
    key = lambda r: r.Mes
    assert sorted(one, key=key) == sorted(allc, key=key)
    assert sum(r.Saidas for r in one) == -50


def test_report_golden(spark):
    panel = rpt.cashflow_panel(golden(spark), 2024, opening=10.0).orderBy("Mes").collect()
    assert [r.Saldo for r in panel[:3]] == [70.0, 70.0, 60.0]
    assert panel[-1].Saldo == 60.0
    # both Custeio (out) and Venda (in, also a zero inflow) get their own columns
    assert panel[0].Venda == 100.0 and panel[0].Custeio == -40.0
    summ = {r.Categoria: r for r in rpt.cashflow_summary(golden(spark), 2024).collect()}
    assert (summ["ENTRADAS"].Total, summ["ENTRADAS"].Media, summ["ENTRADAS"].Pct_Entradas) == (100, 8.33, 100)
    assert (summ["SAIDAS"].Total, summ["SAIDAS"].Media, summ["SAIDAS"].Pct_Entradas) == (-50, -4.17, 50)
    assert (summ["Venda"].Total, summ["Custeio"].Total, summ["Custeio"].Pct_Entradas) == (100, -50, 50)


def test_report_missing_opening_year_defaults_to_zero(spark):
    opening = spark.createDataFrame([(2023, Decimal("5.00"))], "Year int, Value decimal(18,2)")
    panel = rpt.cashflow_panel(golden(spark), 2024, opening=opening).orderBy("Mes").collect()
    assert panel[0].Saldo == 60.0 and panel[0].Saldo_Inicial_Found is False


def test_invariants_on_driver_table(spark):
    from razao.plans import views
    from tests.conftest import SF_SMALL

    cf = views.cash_flow(spark, SF_SMALL, with_category=False)
    monthly = cfo.monthly_summary(cf, rounded=False)
    yearly = cfo.yearly_summary(monthly).collect()
    mrows = monthly.collect()
    years = {r.Ano for r in mrows}
    for y in years:
        months = [r for r in mrows if r.Ano == y]
        assert len(months) == 12
        last = max(months, key=lambda r: r.Mes)
        yr = [r for r in yearly if r.Ano == y][0]
        assert float(last.Fluxo_Acum) == yr.Fluxo
        assert float(sum(r.Entradas for r in months)) == yr.Entradas
