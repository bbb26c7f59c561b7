"""CDB text statement on a hand-written sample."""

import datetime as dt
from decimal import Decimal

from razao.operators import cdb

TEXT = "\n".join([
    "EXTRATO CONTA INVESTIMENTO",
    "Período: 01/12/2024 a 31/12/2024",
    "",
    "BB CDB DI",
    "Saldo anterior  1.000,00",
    "Data  Historico  Documento  Valor",
    "--------------------------------",
    "02/12 Aplicacao 555",
    "      1.000,00",
    "30/12 Rendimento  mensal 555",
    "      valor juros 12,34",
    "Saldo final 1.012,34",
    "SALDO NOS ULTIMOS 6 MESES",
    "Data Capital Juros IR Capital",
    "31/12/2024 1.000,00 12,34 2,00 1.010,34",
    "RESUMO DOS DEPOSITOS EM SER",
    "Deposito Aplicacao Capital Saldo Taxa Vencimento",
    "555 02/12/2024 1.000,00 1.012,34 0,98 02/12/2026",
    "RENDIMENTO BRUTO NO PERIODO POR DEPOSITO",
    "Data Deposito Rendimento",
    "30/12 555 12,34",
    "BB CDB PROGRESSIVO",
    "Data  Historico  Documento  Valor",
    "05/12 Aplicacao 777",
    "==========",
])


def test_parse_sample(spark):
    lines = cdb.statement_lines(spark.createDataFrame([("s.txt", TEXT)], "file_data string, text string"))
    out = cdb.parse(lines)
    ext = sorted(out["EXTRATO"].collect(), key=lambda r: r.pos)
    assert [(r.account, r.Data, r.Valor, r.Categoria) for r in ext] == [
        ("CDBDI", dt.date(2024, 12, 2), Decimal("1000.0000"), "Aplicacao"),
        ("CDBDI", dt.date(2024, 12, 30), Decimal("12.3400"), "Juros"),
    ]
    s = out["SALDOS"].collect()
    assert len(s) == 1 and s[0].Capital_Projetado == Decimal("1010.3400") and s[0].Data == dt.date(2024, 12, 31)
    d = out["DEPOSITOS"].collect()
    assert d[0].Deposito == "555" and d[0].Taxa == Decimal("0.9800") and d[0].Data_Vencimento == dt.date(2026, 12, 2)
    r = out["RENDIMENTOS"].collect()
    assert r[0].Rendimento_Bruto == Decimal("12.3400")
    # the second account has 3 EXTRATO lines: no records, nothing leaks from the first
    assert not [x for x in ext if x.account == "CDBPG"]
    # its one body line is in the quarantine
    assert [(r.account, r.section, r.pos) for r in out["quarantine"].collect()] == [("CDBPG", "EXTRATO", TEXT.split("\n").index("05/12 Aplicacao 777"))]


def test_unpaired_line_is_quarantined(spark):
    text = "\n".join(["Período: 01/01/2024 a 31/01/2024", "BB CDB DI", "Data Historico Documento Valor",
                      "02/01 Aplicacao 1", "   10,00", "03/01 Aplicacao 2"])
    out = cdb.parse(cdb.statement_lines(spark.createDataFrame([("t.txt", text)], "file_data string, text string")))
    assert out["EXTRATO"].count() == 1
    assert [r.section for r in out["quarantine"].collect()] == ["EXTRATO"]


def test_chunked_scans_match_plain_windows(spark):
    """Chunk widths smaller than a section give the same labels and ranks."""
    lines = cdb.statement_lines(spark.createDataFrame([("s.txt", TEXT)], "file_data string, text string"))
    base = {r.pos: (r.account, r.section, r.rn, r.n_lines) for r in cdb.labelled_lines(lines).collect()}
    for width in (1, 2, 3, 7):
        got = {r.pos: (r.account, r.section, r.rn, r.n_lines) for r in cdb.labelled_lines(lines, width).collect()}
        assert got == base
    ext = cdb.parse(lines, width=2)["EXTRATO"].count()
    assert ext == 2
