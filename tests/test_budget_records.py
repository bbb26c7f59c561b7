"""Budget golden case, recurrence counts and record-table traps."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from razao.operators import budget as bdg
from razao.operators import records as rec


def golden(spark):
    rows = [("Revenue", "Executed", "100"), ("Expense", "Expected", "30"), ("Expense", "Cancelled", "999"),
            ("Revenue", "Prospected", "999"), ("Expense", None, "5"), ("Transfer", "Executed", "7")]
    df = spark.createDataFrame(rows, "Type string, Status string, Value string")
    return bdg.signed(df.withColumn("Value", F.col("Value").cast("decimal(18,2)"))
                      .withColumn("Tags", F.lit("a b")))


def test_totals_and_status(spark):
    t = bdg.totals(golden(spark)).collect()[0]
    assert (t.Total_Revenue, t.Total_Expenses, t.Total_Net, t.Ascending) == (100.0, -35.0, 65.0, False)
    s = {r.Status: r.Value_Signed for r in bdg.summary_by(golden(spark), "Status").collect()}
    assert s == {"Executed": 93.0, "Expected": -30.0}       # null group dropped, null status kept in totals
    assert [r.Status for r in bdg.summary_by(golden(spark), "Status").collect()] == ["Executed", "Expected"]
    order = [r.measure for r in bdg.summary_by_type(golden(spark)).collect()]
    assert order == ["Total_Revenue", "Total_Net", "Total_Expenses"]   # descending: net > 0


def test_recurrence_counts(spark):
    df = spark.createDataFrame([(f,) for f in ("MS", "QS", "YS", "D", "W", "ME", "XX")], "Freq string")
    out = {r.Freq: r.n for r in bdg.expand_annual(df, 2025).groupBy("Freq").agg(F.count("*").alias("n")).collect()}
    assert out == {"MS": 13, "QS": 5, "YS": 2, "D": 366, "W": 52, "ME": 12}


def test_auto_status(spark):
    df = spark.createDataFrame(
        [("Automatic", "Expected", dt.date(2025, 1, 1)), ("Automatic", "Expected", None),
         ("Manual", "Expected", dt.date(2025, 1, 1)), ("Automatic", "Expected", dt.date(2026, 1, 1))],
        "Method string, Status string, Date_Due date")
    out = [r.s for r in df.select(bdg.auto_status("2025-06-30 00:00:00").alias("s")).collect()]
    assert out == ["Executed", "Expected", "Expected", "Expected"]


def test_next_id_is_numeric(spark):
    df = spark.createDataFrame([("Rec9999",), ("Rec10000",), ("Rec0002",)], "RecId string")
    r = rec.next_id(df).collect()[0]
    assert (r.last, r.next) == (10000, "Rec10001")


def test_conform_ids_and_defaults(spark):
    existing = spark.createDataFrame([("Rec0007", "T", "x", "On", "1")],
                                     "RecId string, RecTable string, RecTimestamp string, RecStatus string, Kind string")
    new = spark.createDataFrame([(3, "b", "zz"), (1, "a", "zz")], "k int, Kind string, extra string")
    out = rec.conform(new, "T", ["Kind", "Value"], existing=existing, order_cols=["k"], as_of="2025-01-01 00:00:00")
    rows = sorted(out.collect(), key=lambda r: r.RecId)
    assert [(r.RecId, r.Kind, r.Value, r.RecStatus) for r in rows] == [
        ("Rec0007", "1", "", "On"), ("Rec0008", "a", "", "On"), ("Rec0009", "b", "", "On")]
    assert rows[1].RecTimestamp == "2025-01-01 00:00:00" and "extra" not in out.columns


def test_consecutive_index_many_partitions(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k").repartition(13)
    out = rec.consecutive_index(df, ["k"], start=10, partitions=7)
    assert out.filter(F.col("_idx") != F.col("k") + 10).count() == 0


def test_keep_first_with_hot_key(spark):
    # one key holds most rows: resolved by a partial aggregate
    df = spark.range(0, 20000).select(F.when(F.col("id") < 15000, F.lit("Rec0001"))
                                      .otherwise(F.format_string("Rec%04d", F.col("id"))).alias("RecId"),
                                      F.col("id").alias("ord"), (F.col("id") * 2).alias("v"))
    first = rec.keep_first(df, "RecId", "ord").filter("RecId = 'Rec0001'").collect()[0]
    assert (first.ord, first.v) == (0, 0)


def test_edit_and_archive(spark):
    t = spark.createDataFrame([("Rec0001", "T", "s", "On", "a"), ("Rec0002", "T", "s", "On", "b")],
                              "RecId string, RecTable string, RecTimestamp string, RecStatus string, Kind string")
    edits = spark.createDataFrame([("Rec0002", {"Kind": None}), ("Rec0009", {"Kind": "z"})],
                                  "RecId string, changes map<string,string>")
    out = {r.RecId: r for r in rec.edit_records(t, edits, as_of="2025-01-01 00:00:00").collect()}
    assert out["Rec0002"].Kind is None and out["Rec0002"].RecTimestamp == "2025-01-01 00:00:00"
    assert out["Rec0001"].Kind == "a" and out["Rec0001"].RecTimestamp == "s"
    assert [r.RecId for r in rec.unmatched_edits(t, edits).collect()] == ["Rec0009"]
    arch = {r.RecId: r.RecStatus for r in rec.archive_records(
        t, spark.createDataFrame([("Rec0001",)], "RecId string")).collect()}
    assert arch == {"Rec0001": "Off", "Rec0002": "On"}
