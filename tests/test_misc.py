"""Tax brackets, catalog, dates, text helpers, incremental processing."""

import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from razao.functions import dates as dts
from razao.functions import text as txt
from razao.operators import catalog as cat
from razao.operators import tax


def test_irrf_boundaries_match_once(spark):
    amounts = ["2428.80", "2428.81", "2826.65", "2826.66", "4664.68", "4664.69", "10000.00"]
    df = spark.createDataFrame([(Decimal(a),) for a in amounts], "amount decimal(18,2)")
    out = {str(r.amount): r.irrf_bracket for r in tax.irrf(df, "amount").collect()}
    assert len(out) == len(amounts)                        # no row duplicated
    assert out["2428.80"] is None and out["2428.81"] == 1 and out["2826.65"] == 1
    assert out["2826.66"] == 2 and out["4664.68"] == 3 and out["4664.69"] == 4 and out["10000.00"] == 4


def test_inss_ceiling(spark):
    df = spark.createDataFrame([(Decimal("1518.00"),), (Decimal("1518.01"),), (Decimal("9000.00"),)],
                               "amount decimal(18,2)")
    out = [r.inss_bracket for r in tax.inss(df, "amount").orderBy("amount").collect()]
    assert out == [1, 2, None]


def test_catalog_keep_last_and_alias(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("Q", 4, "w")],
                                "name string, seq long, v string")
    latest = {r.name: r.v for r in cat.latest(log).collect()}
    assert latest == {"a": "y", "b": "z", "Q": "w"}
    al = {r.name: r.al for r in log.select("name", cat.alias_of("name").alias("al")).collect()}
    assert al["Q"] == "Q"
    assert cat.size(cat.latest(log)).collect()[0]["size"] == 3


def test_interval_parts_floor(spark):
    df = spark.createDataFrame([(400 * 86400 + 3 * 3600 + 61,), (-1,)], "s long")
    p = [r.p for r in df.select(dts.interval_parts("s").alias("p")).collect()]
    assert (p[0].Years, p[0].Months, p[0].Days, p[0].Hours, p[0].Minutes, p[0].Seconds) == (1, 1, 5, 3, 1, 1)
    assert (p[1].Years, p[1].Months, p[1].Days, p[1].Hours, p[1].Seconds) == (-1, 12, 4, 23, 59)
    t = df.select(dts.interval_text(dts.interval_parts("s")).alias("t")).collect()[0].t
    assert t == "yr: 1, mth: 1"


def test_cp1252_decode(spark):
    raw = bytes([0x93, 0x41, 0x94, 0x20, 0x96, 0xE7])   # “A” – ç
    bad = bytes([0x81, 0x41, 0x93])                     # undefined byte -> latin1 for the whole text
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(bad),)], "b binary")
    out = [r.t for r in df.select(txt.decode_cp1252("b").alias("t")).collect()]
    assert out == [raw.decode("cp1252"), bad.decode("latin1")]


def test_strip_and_squeeze(spark):
    df = spark.createDataFrame([("\t  x 　\n",)], "s string")
    assert df.select(txt.strip_ws("s").alias("v")).collect()[0].v == "x"
    df = spark.createDataFrame([("a\n\n \n\t\nb\n",)], "s string")
    assert df.select(txt.squeeze_blank_lines("s").alias("v")).collect()[0].v == "a\n\nb\n"


def test_incremental_is_idempotent(spark):
    from razao.streaming.incremental import run_incremental

    root = tempfile.mkdtemp(prefix="razao-inc-")
    os.makedirs(f"{root}/t0/2025")
    header = '"Data","Lançamento","Detalhes","N° documento","Valor"\n'

    def write(name, lines):
        with open(f"{root}/t0/2025/{name}", "w", encoding="cp1252") as fh:
            fh.write(header + "".join(lines))

    write("EXTRATO_BB_CC_2025-01_T0.csv", ['"02/01/2025","Pix – Recebido","","1","1.000,00"\n',
                                          '"03/01/2025","Saldo do dia","","","1.000,00"\n'])
    assert run_incremental(spark, f"{root}/t0", f"{root}/t1", f"{root}/ckpt") == 1   # the balance row is dropped
    assert run_incremental(spark, f"{root}/t0", f"{root}/t1", f"{root}/ckpt") == 0
    write("EXTRATO_BB_CC_2025-02_T0.csv", ['"05/02/2025","Compra","","2","-10,00"\n'])
    assert run_incremental(spark, f"{root}/t0", f"{root}/t1", f"{root}/ckpt") == 1
    t1 = spark.read.parquet(f"{root}/t1").collect()
    assert sorted((r.Lancamento, r.t1_file) for r in t1) == [
        ("Compra", "EXTRATO_BB_CC_2025-02_T1.csv"), ("Pix – Recebido", "EXTRATO_BB_CC_2025-01_T1.csv")]
