"""Statement dialects on the hand-written sample of FIXTURES.md."""

from decimal import Decimal

from pyspark.sql import functions as F

from razao.functions import amounts as amt
from razao.operators import statements as stm

SAMPLE = [
    ("31/10/2025", "Saldo Anterior", "", "", "1.000,00"),
    ("03/11/2025", "Pix – Recebido", "Fulano", "101", "5.000,00"),
    ("04/11/2025", "Compra", "", "102", "-403,00"),
    ("04/11/2025", "Saldo do dia", "", "", "5.597,00"),
    ("00/00/0000", "S A L D O", "", "", "5.597,00"),
]
COLS = ["Data", "Lançamento", "Detalhes", "N° documento", "Valor"]


def test_personal_sample(spark):
    raw = spark.createDataFrame(SAMPLE, COLS)
    out = stm.standardize(raw, "bb-cc").orderBy("Data").collect()
    assert len(out) == 2
    a, b = out
    assert (str(a.Data), a.Valor, a.Categoria, a.Descricao, a.Lancamento, a.Detalhes, a.Documento) == (
        "2025-11-03", Decimal("5000.0000"), "", "", "Pix – Recebido", "Fulano", "101")
    assert (str(b.Data), b.Valor, b.Lancamento, b.Documento) == ("2025-11-04", Decimal("-403.0000"), "Compra", "102")


def test_legacy_header(spark):
    raw = spark.createDataFrame(SAMPLE, ["Data", "Histórico", "Detalhes", "Número do documento", "Valor"])
    assert stm.standardize(raw, "bb-cc").count() == 2


def test_amount_table(spark):
    df = spark.createDataFrame([("5.000,00",), ("-403,00",), ("5.000,00 C",), ("-403,00 D",), ("1.234",)], "t string")
    rows = df.select(amt.br_amount("t").alias("p"), amt.cd_amount("t").alias("c")).collect()
    assert [r.p for r in rows] == [Decimal("5000"), Decimal("-403"), None, None, Decimal("1.234")]
    assert [r.c for r in rows] == [Decimal("5000"), Decimal("403"), Decimal("5000"), Decimal("-403"), Decimal("1234")]


def test_company_keeps_balance_rows(spark):
    rows = [("01/02/2025", "Saldo do dia", "", "", "10,00 C"),
            ("01/02/2025", "BB Rende Fácil", "", "", "10,00 C"),
            ("01/02/2025", "Pix", "", "", "0,00 C"),
            ("01/02/2025", "Pix", "", "", "7,00 D")]
    out = stm.standardize(spark.createDataFrame(rows, COLS), "bb-ccpj").collect()
    assert sorted(r.Valor for r in out) == [Decimal("-7"), Decimal("10")]


def test_quarantine_reasons(spark):
    raw = spark.createDataFrame(SAMPLE + [("32/13/2025", "Pix", "", "1", "1,00"),
                                          ("01/01/2025", "Pix", "", "2", "abc")], COLS)
    reasons = {r.reason: r.n for r in stm.quarantine(raw, "bb-cc").groupBy("reason")
               .agg(F.count("*").alias("n")).collect()}
    assert reasons == {"dropped": 3, "bad_date": 1, "bad_amount": 1}


def test_currency_text(spark):
    df = spark.createDataFrame([(1234.5,), (-0.5,), (12345678901.0,)], "v double")
    out = [r.t for r in df.select(amt.currency_text("v").alias("t")).collect()]
    assert out == ["   1,234.50 +", "       0.50 -", "12,345,678,901.00 +"]


def test_raw_statement_cp1252_file(spark):
    import os
    import tempfile

    from razao.sources.csv import read_raw_statement

    folder = tempfile.mkdtemp(prefix="razao-t0-")
    text = ('"Data","Lançamento","Detalhes","N° documento","Valor"\n'
            '"03/11/2025","Pix – Recebido","Fulano","101","5.000,00"\n'
            '"04/11/2025","Compra “loja”","","102","-403,00"\n'
            '"04/11/2025","Saldo do dia","",,"5.597,00"\n')
    with open(os.path.join(folder, "EXTRATO_BB_CC_2025-11_T0.csv"), "wb") as fh:
        fh.write(text.encode("cp1252"))
    raw = read_raw_statement(spark, folder)
    rows = raw.orderBy("N° documento").collect()
    assert [r["Lançamento"] for r in rows] == ["Saldo do dia", "Pix – Recebido", "Compra “loja”"]
    assert rows[0]["N° documento"] == "" and rows[2]["Detalhes"] == ""     # empty cells stay ''
    out = stm.standardize(raw, "bb-cc").orderBy("Documento").collect()
    assert [(r.Lancamento, r.Valor) for r in out] == [("Pix – Recebido", Decimal("5000.0000")),
                                                      ("Compra “loja”", Decimal("-403.0000"))]
