"""Rename chains, balances by segment, dated brackets, offsets, statement trees."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from razao.operators import budget as bdg
from razao.operators import catalog as cat
from razao.operators import report as rpt
from razao.operators import tax
from razao.sources.csv import read_statement_tree


def names(spark, rows, order=True):
    df = spark.createDataFrame(rows, "old_name string, new_name string, n int")
    return {r.old_name: r.new_name for r in cat.current_names(df, "n" if order else None).collect()}


def test_rename_chains_and_circles(spark):
    chain = [(f"c{i}", f"c{i + 1}", 1) for i in range(40)]
    circle = [("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("in", "x", 1), ("into", "in", 1)]
    got = names(spark, chain + circle + [("a", "b", 5), ("a", "c0", 2), ("s", "s", 1), ("t", None, 1), (None, "u", 1)])
    assert all(got[f"c{i}"] == "c40" for i in range(40))
    assert [got[k] for k in ("x", "y", "z", "in", "into")] == [None] * 5
    assert got["a"] == "b" and not {"s", "t", "c40"} & set(got)


def test_last_rename_holds(spark):
    rows = [("a", "z", 1), ("a", "b", 2), ("b", "c", 1)]
    assert names(spark, rows) == {"a": "c", "b": "c"}
    assert names(spark, rows, order=False) == {"a": "z", "b": "c"}
    assert names(spark, []) == {}
    df = spark.createDataFrame([("x", "y", 1), ("y", "x", 1)], "old_name string, new_name string, n int")
    assert {r.name for r in cat.rename_circles(df, "n").collect()} == {"x", "y"}
    log = spark.createDataFrame([("a", 1), ("c", 2), ("x", 3)], "name string, seq int")
    df = spark.createDataFrame(rows + [("x", "y", 1), ("y", "x", 1)], "old_name string, new_name string, n int")
    assert [(r.name, r.seq) for r in cat.refresh(log, df, order_col="n").collect()] == [("c", 2), ("x", 3)]


def test_balance_starts_anew_at_each_opening(spark):
    flow = spark.createDataFrame(
        [("A", "2020-03-01", "10.00"), ("A", "2022-02-01", "-4.00"), ("A", "2023-01-05", "1.00"), ("B", "2021-12-31", "7.00"),
         ("A", None, "99.00"), (None, "2021-01-01", "3.00")], "Conta string, Data string, Valor string") \
        .select("Conta", F.col("Data").cast("date").alias("Data"), F.col("Valor").cast("decimal(18,2)").alias("Valor"))
    opening = spark.createDataFrame([("A", 2022, "100.00"), ("A", 2022, "90.00"), ("B", 2019, "1.00"), ("C", 2021, "5.00")],
                                    "Conta string, Year int, Value string").withColumn("Value", F.col("Value").cast("decimal(18,2)"))
    rows = {(r.Conta, r.Mes): (float(r.Saldo), r.Saldo_Inicial_Found) for r in rpt.account_balances(flow, opening).collect()}
    assert len([k for k in rows if k[0] == "A"]) == 48 and len([k for k in rows if k[0] == "B"]) == 36
    assert rows["A", "2020-02"] == (0.0, False) and rows["A", "2021-12"] == (10.0, False)
    assert rows["A", "2022-01"] == (100.0, True) and rows["A", "2022-12"] == (96.0, True) and rows["A", "2023-06"] == (97.0, False)
    assert rows["B", "2019-01"] == (1.0, True) and rows["B", "2021-12"] == (8.0, False)
    assert rows["C", "2021-07"] == (5.0, True) and rows[None, "2021-05"] == (3.0, False)
    assert rpt.account_balances(flow.limit(0), opening.limit(0)).count() == 0


BRACKETS = [("T", "2020-01-01", None, "10.00", "0.1000"), ("T", "2020-01-01", "10.00", "20.00", "0.2000"),
            ("T", "2020-01-01", "25.00", None, "0.3000"), ("T", "2021-01-01", "5.00", "15.00", "0.4000"),
            ("T", "2021-01-01", "12.00", "30.00", "0.5000"), ("U", "2000-01-01", None, None, "0.9000")]


def bracket_table(spark):
    df = spark.createDataFrame(BRACKETS, "table string, valid_from string, lo string, hi string, rate string")
    return df.select("table", F.col("valid_from").cast("date").alias("valid_from"), F.col("lo").cast(tax.BOUND).alias("lo"),
                     F.col("hi").cast(tax.BOUND).alias("hi"), F.col("rate").cast(tax.RATE).alias("rate"),
                     F.lit(0).cast(tax.BOUND).alias("deduction"))


def test_brackets_by_date(spark):
    cases = {("2019-12-31", "5.00"): None, ("2020-01-01", "-3.00"): 0.1, ("2020-12-31", "10.00"): 0.1, ("2020-05-05", "10.01"): 0.2,
             ("2020-05-05", "20.01"): None, ("2020-05-05", "24.99"): None, ("2020-05-05", "25.00"): 0.3, ("2020-05-05", "1e9"): 0.3,
             ("2021-01-01", "4.99"): None, ("2021-01-01", "5.00"): 0.4, ("2022-07-07", "15.00"): 0.4, ("2022-07-07", "15.01"): 0.5,
             ("2022-07-07", "30.01"): None, (None, "5.00"): None, ("2021-01-01", None): None}
    rows = [(i, d, v) for i, (d, v) in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "bracket_of int, d string, v string").select(
        "bracket_of", F.col("d").cast("date").alias("d"), F.col("v").cast("double").cast(tax.BOUND).alias("v"))
    out = tax.lookup(df, "v", "d", bracket_table(spark), "T").collect()
    assert len(out) == len(rows)
    want = list(cases.values())
    assert all((None if r.rate is None else float(r.rate)) == want[r.bracket_of] for r in out)
    assert [(str(r.valid_from), r.bracket) for r in tax.overlaps(bracket_table(spark)).collect()] == [
        ("2020-01-01", 2), ("2021-01-01", 2)]
    assert tax.lookup(df, "v", "d", bracket_table(spark), "none").where("rate is not null").count() == 0


@pytest.mark.parametrize("year", [2024, 2025])
def test_all_offsets_as_pandas_has_them(spark, year):
    freqs = ["D", "3D", "B", "5B", "W", "W-MON", "3W-SAT", "MS", "2MS", "ME", "BMS", "BME", "2BME", "SMS", "SME", "3SME", "WOM-1MON",
             "WOM-4SUN", "2WOM-2TUE"]
    freqs += [f"{p}{k}{s}-{m}" for p in ("", "B") for k in "QY" for s in "SE" for m in ("JAN", "FEB", "MAY", "DEC")]
    freqs += ["QS", "QE", "YS", "YE", "BQS", "BQE", "BYS", "BYE", "2QS", "2QE-NOV"]
    tpl = spark.createDataFrame([(f,) for f in freqs], "Freq string")
    got = {f: [] for f in freqs}
    for r in bdg.expand_annual(tpl, year).collect():
        got[r.Freq].append(r.Date_Due)
    for f in freqs:
        want = [d.date() for d in pd.date_range(f"{year}-01-01", f"{year + 1}-01-01", freq=f)]
        assert sorted(got[f]) == want, f


def test_statement_tree_opens_only_what_is_asked_for(spark):
    root = tempfile.mkdtemp(prefix="razao-tree-")
    good = "Data,Lançamento,Valor,N° documento,Detalhes\n01/02/{y},Pix,\"1,00\",{a},x\n"
    for y in (2020, 2021, 2022):
        os.makedirs(f"{root}/{y}")
        for a in ("CC", "PP"):
            with open(f"{root}/{y}/EXTRATO_BB_{a}_01_T0.csv", "w", encoding="cp1252") as fh:
                fh.write(good.format(y=y, a=a))
    with open(f"{root}/2021/EXTRATO_BB_CC_01_T1.csv", "w", encoding="utf-8") as fh:
        fh.write("other;tier\n1;2\n")
    some = read_statement_tree(spark, root, "bb-cc", years=[2020, 2022])
    assert sorted((r.Conta, r.Ano, r["N° documento"]) for r in some.collect()) == [("BB_CC", 2020, "CC"), ("BB_CC", 2022, "CC")]
    assert sorted(os.path.basename(os.path.dirname(f)) for f in some.inputFiles()) == ["2020", "2022"]
    assert {r.Ano for r in read_statement_tree(spark, root, "bb-pp").collect()} == {2020, 2021, 2022}


def test_edits_replace_their_buckets_only(spark):
    import glob

    from razao.sinks import record_store as store

    path = tempfile.mkdtemp(prefix="razao-store-") + "/t"
    table = spark.createDataFrame([(f"Rec{i:04d}", "T", "2020-01-01 00:00:00", "On", f"n{i}") for i in range(1, 41)],
                                  "RecId string, RecTable string, RecTimestamp string, RecStatus string, Name string")
    store.create(table, path, 8)
    files = lambda: {p for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}
    before = files()
    edits = spark.createDataFrame([("Rec0007", {"Name": "first"}, 1), ("Rec0007", {"Name": "last"}, 2), ("Rec9999", {"Name": "x"}, 1)],
                                  "RecId string, changes map<string,string>, n int")
    left = store.edit(spark, path, edits, "2025-01-01 00:00:00", ["Name"], "n")
    assert [r.RecId for r in left.collect()] == ["Rec9999"]
    gone = {p.split("_bucket=")[1].split("/")[0] for p in before - files()}
    assert 1 <= len(gone) <= 2 and len(before & files()) == len(before) - len(before - files()) >= 1
    store.insert(spark, path, spark.createDataFrame([("b", 2), ("a", 1)], "Name string, k int"), ["Name"], "T", ["k"],
                 "2025-01-02 00:00:00")
    rows = {r.RecId: (r.Name, r.RecTimestamp) for r in store.read(spark, path).collect()}
    assert len(rows) == 42 and rows["Rec0007"] == ("last", "2025-01-01 00:00:00") and rows["Rec0008"][0] == "n8"
    assert rows["Rec0041"] == ("a", "2025-01-02 00:00:00") and rows["Rec0042"][0] == "b"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.create(table, path, 8)
