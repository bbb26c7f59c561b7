"""Partitioning helper, report category cap, dict table, tag tokens."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from razao.operators import budget as bdg
from razao.operators import catalog as cat
from razao.operators import report as rpt
from razao.operators.partitioning import spread


def test_spread_only_when_few_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 100, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, numPartitions=cores + 3)
    assert spread(many) is many                       # no shuffle added


def _flows(spark, n_categories):
    rows = [(dt.datetime(2024, 1 + i % 12, 1), f"c{i}", Decimal("1.00")) for i in range(n_categories)]
    return spark.createDataFrame(rows, "Data timestamp_ntz, Categoria string, Valor decimal(18,2)")


def test_panel_category_cap_and_long_form(spark):
    df = _flows(spark, 5)
    with pytest.raises(ValueError):
        rpt.cashflow_panel(df, 2024, max_categories=3)
    long = rpt.cashflow_long(df, 2024)
    assert long.count() == 5 and set(long.columns) == {"Mes", "Flow", "Categoria", "Valor"}
    panel = rpt.cashflow_panel(df, 2024, max_categories=5)
    assert {f"c{i}" for i in range(5)} <= set(panel.columns)


def test_dict_table_uses_first_entry_keys(spark):
    df = spark.createDataFrame([("b", 2, {"x": "1", "y": "2", "z": "3"}), ("a", 1, {"x": "9", "y": "8"})],
                               "k string, o int, m map<string,string>")
    out = cat.dict_table(df, "k", "m", "o")
    assert out.columns == ["k", "x", "y"]                # keys of the first entry (o = 1)
    assert {r.k: (r.x, r.y) for r in out.collect()} == {"a": ("9", "8"), "b": ("1", "2")}


def test_tag_tokens_counts(spark):
    df = spark.createDataFrame([("Revenue", "Executed", "a  b", Decimal(1)), ("Expense", "Cancelled", "a", Decimal(1)),
                                ("Expense", None, " b c ", Decimal(1))],
                               "Type string, Status string, Tags string, Value decimal(18,2)")
    out = [(r.token, r["count"]) for r in bdg.tag_tokens(bdg.signed(df)).collect()]
    assert out == [("b", 2), ("a", 1), ("c", 1)]          # cancelled row left out, ties by token
