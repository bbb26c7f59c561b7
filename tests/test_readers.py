"""Readers that bind by header and keep or quarantine every row; text and record edge cases."""

import datetime as dt
import os
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from razao.functions import amounts as amt
from razao.functions import dates as dts
from razao.functions import text as txt
from razao.operators import budget as bdg
from razao.operators import catalog as cat
from razao.operators import cdb
from razao.operators import invoices as nfs
from razao.operators import records as rec
from razao.operators import report as rpt
from razao.operators import statements as stm
from razao.sinks.writers import write_table_csv
from razao.sources import csv as csvs
from razao.streaming.incremental import RAW_COLUMNS, run_incremental


def put(folder, name, text, encoding="cp1252"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode(encoding))


LAYOUTS = {
    "a.csv": '"Data","Lançamento","Detalhes","N° documento","Valor"\n"1/2/2024","Pix – ok","say ""hi"" ok","1","1.000,00"\n',
    "b.csv": '"Data","Histórico","Número do documento","Valor"\n"02/02/2024","Old","2","-5,00"\n"xx","Bad","3","1,00"\n',
    "c.csv": '"Valor","Detalhes","Data","Lançamento","N° documento"\n"7,50","two\nlines","03/02/2024","Turned","4"\n"?","","03/02/2024","Amount","5"\n',
}


def test_raw_statements_by_header(spark, tmp_path):
    for name, text in LAYOUTS.items():
        put(tmp_path / "t0", name, text)
    put(tmp_path / "t0", "d.csv", LAYOUTS["a.csv"].encode("cp1252").replace(b"Pix", b"P\x81x\x96"))
    raw = csvs.read_raw_statement(spark, str(tmp_path / "t0"), columns=RAW_COLUMNS["bb-cc"], aliases=stm.LEGACY_HEADER_ALIASES)
    good = {r["Documento"] + os.path.basename(r["file"])[0]: r for r in stm.standardize(raw, "bb-cc", keep=("file",)).collect()}
    bad = stm.quarantine(raw, "bb-cc").collect()
    assert raw.count() == len(good) + len(bad) == 6
    assert good["1a"]["Detalhes"] == 'say "hi" ok' and good["1a"]["Data"] == dt.date(2024, 2, 1)
    assert good["1a"]["Lancamento"] == "Pix – ok"
    assert good["1d"]["Lancamento"] == "P\x81x\x96 \x96 ok"  # undefined byte: Latin-1 for the whole file
    assert good["2b"]["Valor"] == -5 and good["2b"]["Lancamento"] == "Old"
    assert good["4c"]["Detalhes"] == "two\nlines" and good["4c"]["Valor"] == Decimal("7.5")
    assert sorted(r["reason"] for r in bad) == ["bad_amount", "bad_date"]


def test_lines_are_not_sorted_for_the_headers(spark):
    lines = "v string, file_path string, file_block_start long, n long"
    rows = [("a;b", "f", 0, 1), ("", "f", 0, 0), ('1;"x', "f", 9, 5), ('y"', "f", 9, 6), ("c", "g", 0, 7), ("\x81", "g", 0, 8),
            ("", "h", 0, 9)]
    facts = csvs._file_facts(spark.createDataFrame(rows, lines).repartition(3))
    got = {r["file_path"]: (r["header"], r["first"], r["multiline"], r["undefined"]) for r in facts.collect()}
    assert got == {"f": ("a;b", "a;b", True, False), "g": ("c", "c", False, True), "h": (None, None, False, False)}
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


def test_stream_binds_by_header(spark, tmp_path):
    t0, t1, bad = (str(tmp_path / x) for x in ("t0", "t1", "bad"))
    for name, text in LAYOUTS.items():
        put(t0, name, text)
    assert run_incremental(spark, t0, t1, str(tmp_path / "ckpt"), quarantine_folder=bad) == 3
    assert run_incremental(spark, t0, t1, str(tmp_path / "ckpt"), quarantine_folder=bad) == 0
    assert sorted(r["Lancamento"] for r in spark.read.parquet(t1).collect()) == ["Old", "Pix – ok", "Turned"]
    assert spark.read.parquet(bad).count() == 2


def test_tables_by_header(spark, tmp_path):
    put(tmp_path / "t", "a.csv", "x;y\n1;2\n", "utf-8")
    put(tmp_path / "t", "b.csv", 'y;x;z\n20;10;"a ""q""; b"\n', "utf-8")
    put(tmp_path / "t", "c.csv", 'z;x\n"line\nbreak";100\n', "utf-8")
    rows = csvs.read_many(spark, [str(tmp_path / "t")]).drop("file").collect()
    assert sorted((r["x"], r["y"], r["z"]) for r in rows if r["y"]) == [("1", "2", None), ("10", "20", 'a "q"; b')]
    assert [(r["x"], r["z"]) for r in rows if not r["y"]] == [("100", "line\nbreak")]
    typed = csvs.read_table_csv(spark, str(tmp_path / "t"), schema="x int, y int").collect()
    assert sorted((r["x"], r["y"]) for r in typed if r["y"]) == [(1, 2), (10, 20)]


def test_quotes_and_breaks_round_trip(spark, tmp_path):
    rows = [("a;b", 'he said "x"'), ("two\nlines", "c"), ("d", None)]
    path = write_table_csv(spark.createDataFrame(rows, "k string, v string").coalesce(1), str(tmp_path / "w"))
    assert sorted(map(tuple, csvs.read_table_csv(spark, path).collect())) == sorted(rows)
    assert csvs.read_table_csv(spark, write_table_csv(spark.createDataFrame([], "k string"), str(tmp_path / "e"))).count() == 0


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn("s").alias("v")).first()["v"]


@pytest.mark.parametrize("value,want", [("5,00 D\t", -5), (" 5,00 C", 5)])
def test_cd_amount_white_space(spark, value, want):
    assert one(spark, value, amt.cd_amount) == want


def test_amounts_and_dates(spark):
    assert one(spark, "1.23456", amt.br_amount) == Decimal("1.23456")
    assert one(spark, " -1.000,50\t", amt.br_amount) == Decimal("-1000.5")
    assert one(spark, "\t1/2/2024 ", dts.br_date) == dt.date(2024, 2, 1)
    assert one(spark, "31/02/2024", dts.br_date) is None
    assert one(spark, " 1/2", lambda c: dts.day_month_in_year(c, 2023)) == dt.date(2023, 2, 1)


@pytest.mark.parametrize("value,want", [
    ("a" + "\n" * 100_000 + "b", "a\n\nb"), ("foo \n\n\nbar", "foo \n\nbar"), ("\n\n\n", "\n"), ("", ""), (None, None),
    ("a\n \t\n\n  b", "a\n \t\n  b"), ("x\n\n", "x\n\n"), ("x\n\n\n", "x\n\n"), ("x\n\n  ", "x\n\n  ")])
def test_squeeze(spark, value, want):
    assert one(spark, value, txt.squeeze_blank_lines) == want


def test_repeated_edits_make_one_row(spark):
    table = spark.createDataFrame([("Rec0001", "old", "On", "t"), ("Rec0002", "x", "On", "t")],
                                  "RecId string, Name string, RecStatus string, RecTimestamp string")
    edits = spark.createDataFrame([("Rec0001", {"Name": "first"}, 1), ("Rec0001", {"Name": "last", "RecStatus": "Off"}, 3),
                                   ("Rec0001", {"Name": None}, 2)], "RecId string, changes map<string,string>, n int")
    got = rec.edit_records(table, edits, as_of="2025-01-01 00:00:00", order_col="n").collect()
    assert sorted((r["RecId"], r["Name"], r["RecStatus"]) for r in got) == [("Rec0001", "last", "Off"), ("Rec0002", "x", "On")]
    ids = spark.createDataFrame([("Rec0002",), ("Rec0002",)], "RecId string")
    assert rec.archive_records(table, ids).count() == 2
    log = spark.createDataFrame([("a", 1)], "name string, seq int")
    names = spark.createDataFrame([("a", "b"), ("a", "c")], "old_name string, new_name string")
    assert [r["name"] for r in cat.refresh(log, names).collect()] == ["c"]


@pytest.mark.parametrize("freq,first,n", [
    ("D", "2025-01-01", 366), ("2W", "2025-01-05", 26), ("W-MON", "2025-01-06", 52), ("B", "2025-01-01", 262),
    ("3MS", "2025-01-01", 5), ("ME", "2025-01-31", 12), ("QE", "2025-03-31", 4), ("2QS", "2025-01-01", 3), ("YE", "2025-12-31", 1)])
def test_frequencies(spark, freq, first, n):
    import pandas as pd

    tpl = spark.createDataFrame([("r", freq)], "RecId string, Freq string")
    got = sorted(r["Date_Due"] for r in bdg.expand_annual(tpl, 2025).collect())
    want = [d.date() for d in pd.date_range("2025-01-01", "2026-01-01", freq=freq)]
    assert got == want and len(got) == n and str(got[0]) == first


def test_unknown_frequencies_are_quarantined(spark):
    tpl = spark.createDataFrame([(str(i), f) for i, f in enumerate(["X", None, "0D", "W-XYZ", "D-MON", "MS"])],
                                "RecId string, Freq string")
    assert {r["RecId"] for r in bdg.expand_quarantine(tpl, 2025).collect()} == {"0", "1", "2", "3", "4"}
    assert {r["RecId"] for r in bdg.expand_annual(tpl, 2025).collect()} == {"5"}


def test_malformed_share_and_prefixed_namespace(spark):
    from test_invoices import NS, doc

    share = "<trib><totTrib><pTotTribSN>{}</pTotTribSN></totTrib></trib>"
    plain = doc(7, "<CNPJ>1</CNPJ>", "", share.format("5.5"))
    prefixed = re.sub(r"<(/?)(?=[A-Za-z])", r"<\1n:", plain).replace("xmlns=", "xmlns:n=")
    rows = [("ok", plain), ("prefixed", prefixed), ("bad", doc(8, "<CNPJ>1</CNPJ>", "", share.format("abc"))),
            ("absent", doc(9, "<CNPJ>1</CNPJ>", "", ""))]
    assert NS in plain and "<n:NFSe" in prefixed
    inv = nfs.extract(spark.createDataFrame(rows, "file_data string, xml string"), keep=["file_data"])
    assert {r["file_data"]: r["servico"]["p_tributo_SN"] for r in nfs.valid(inv).collect()} == {
        "ok": 5.5, "prefixed": 5.5, "absent": 6.0}
    assert [(r["file_data"], r["missing"]) for r in nfs.quarantine(inv).collect()] == [("bad", ["servico.p_tributo_SN"])]


def test_panel_map_has_no_cap(spark):
    flows = spark.range(3000).selectExpr("timestamp_ntz'2024-03-05 00:00:00' AS Data", "concat('c', id) AS Categoria",
                                         "CAST(id - 1000 AS DECIMAL(18,2)) AS Valor")
    (r,) = rpt.cashflow_panel_map(flows, 2024).collect()
    assert len(r["Entradas_Categoria"]) == 2000 and len(r["Saidas_Categoria"]) == 1000
    assert r["Fluxo"] == sum(range(-1000, 2000)) and r["Entradas_Categoria"]["c1500"] == 500


STATEMENT = """Período: 01/12/2024 a 31/12/2024
BB CDB DI
Data  Historico  Documento  Valor
02/12 Aplicacao 555
      1.000,00
SALDO NOS ULTIMOS 6 MESES
Data Capital Juros IR Capital
31/12/2024 1.000,00 12,34 2,00 1.010,34
BB CDB PROGRESSIVO
Data  Historico  Documento  Valor
05/12 Aplicação 777
      2,00
"""


def test_cdb_files_and_long_statements(spark, tmp_path):
    put(tmp_path / "cdb", "one.txt", STATEMENT)
    put(tmp_path / "cdb", "long.txt", STATEMENT * 2000)
    started = time.time()
    out = cdb.statement_files(spark, str(tmp_path / "cdb"))
    n = {r["f"]: r["n"] for r in out["EXTRATO"].groupBy(F.regexp_extract("file", r"([^/]+)$", 1).alias("f"))
         .agg(F.count("*").alias("n")).collect()}
    assert n["one.txt"] == 2 and n["long.txt"] > 0
    assert {r["Categoria"] for r in out["EXTRATO"].where("file LIKE '%one.txt'").collect()} == {"Aplicacao", "Aplicação"}
    assert time.time() - started < 120


def test_cdb_is_no_table_dialect(spark):
    with pytest.raises(ValueError, match="statement_files"):
        stm.standardize(spark.createDataFrame([("",)], "Data string"), "bb-cdb")


def test_blank_lines_before_the_header(spark, tmp_path):
    """The header is the first line that is not blank; no row is lost."""
    (tmp_path / "a.csv").write_text("\n  \na;b\n1;x\n2;y\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes(b"\r\na;b\r\n3;\"two\r\nlines\"\r\n")
    (tmp_path / "empty.csv").write_text("\n\n", encoding="utf-8")
    rows = csvs.read_table_csv(spark, str(tmp_path), columns=["a", "b"]).collect()
    assert sorted((r["a"], r["b"].replace("\r", "")) for r in rows) == [("1", "x"), ("2", "y"), ("3", "two\nlines")]


def test_file_without_header_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("  \na;b\n1;\"x\ny\"\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no header"):
        csvs.read_table_csv(spark, str(tmp_path))
