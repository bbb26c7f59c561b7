"""Invariants from the test strategy: format/parse identity, idempotent
keep-last, balance closure."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from razao.functions import amounts as amt
from razao.operators import catalog as cat
from razao.operators import report as rpt
from razao.plans import views
from tests.conftest import SF_SMALL

CENTS = st.integers(min_value=-10**13, max_value=10**13)


@settings(max_examples=5, deadline=None)
@given(st.lists(CENTS, min_size=1, max_size=50))
def test_br_text_parse_identity(spark, cents):
    values = [Decimal(c).scaleb(-2) for c in cents]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)")
    text = df.select("v", views.br_text(F.col("v").cast("double"), F.col("v") < 0).alias("t"))
    out = text.select("v", amt.br_amount("t").alias("p"),
                      amt.cd_amount(F.concat(F.regexp_replace("t", "-", ""),
                                             F.when(F.col("v") < 0, F.lit(" D")).otherwise(F.lit(" C")))).alias("c"))
    for r in out.collect():
        assert r.p == r.v and r.c == r.v


def test_keep_last_idempotent(spark):
    log = views.catalog_log(spark, SF_SMALL)
    once = cat.latest(log)
    twice = cat.latest(once)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_balance_closure(spark):
    cf = views.cash_flow(spark, SF_SMALL)
    opening = rpt.opening_balances(views.cash_flow(spark, SF_SMALL, with_category=False))
    panel = rpt.cashflow_panel(cf, 1998, opening=opening).orderBy("Mes").collect()
    start = [r.Value for r in opening.collect() if r.Year == 1998][0]
    assert len(panel) == 12
    assert abs(panel[-1].Saldo - (float(start) + sum(r.Fluxo for r in panel))) < 1e-6
    nxt = [r.Value for r in opening.collect() if r.Year == 1999][0]
    assert abs(panel[-1].Saldo - float(nxt)) < 1e-6      # closing balance = next opening
