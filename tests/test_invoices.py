"""Invoice extraction on synthetic NFS-e files in the fixture shapes."""

import contextlib
import datetime
import io
import os
import re
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from razao.operators import invoices as nfs
from razao.plans import registry, views
from razao.sources.documents import read_invoice_files

NS = 'xmlns="http://www.sped.fazenda.gov.br/nfse" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def doc(numero, taker, place, trib, incid='<cLocIncid>9999999</cLocIncid>'):
    return (f'<?xml version="1.0" encoding="utf-8"?><NFSe versao="1.00" {NS}><infNFSe Id="NFS{numero}">'
            f'<xLocEmi>Vila Nova</xLocEmi><xLocPrestacao>Vila Nova</xLocPrestacao><nNFSe>{numero}</nNFSe>'
            f'{incid}<xTribNac>Pesquisa.</xTribNac><dhProc>2031-02-03T04:05:06-03:00</dhProc>'
            '<emit><CNPJ>11222333000144</CNPJ><xNome>PRESTADOR LTDA</xNome><enderNac><xLgr>RUA A</xLgr>'
            '<nro>1</nro><xBairro>CENTRO</xBairro><cMun>9999999</cMun><UF>RS</UF><CEP>87654321</CEP></enderNac>'
            '<fone>1155550000</fone><email>p@x.com</email></emit><valores><vLiq>1180.00</vLiq></valores>'
            '<DPS versao="1.00"><infDPS Id="D"><dCompet>2031-02-03</dCompet>'
            f'<toma>{taker}<xNome>TOMADOR</xNome><end>{place}<xLgr>AV B</xLgr><nro>2</nro></end></toma>'
            '<serv><cServ><cTribNac>020101</cTribNac><xDescServ>\nSuporte.</xDescServ></cServ></serv>'
            f'<valores><vServPrest><vServ>1250.00</vServ></vServPrest>{trib}</valores>'
            '</infDPS></DPS></infNFSe></NFSe>')


def test_extract_files(spark):
    folder = tempfile.mkdtemp(prefix="razao-nfse-")
    files = {
        "NFSe_001.xml": doc(80, "<CNPJ>01234567000199</CNPJ>",
                            "<endNac><cMun>9999999</cMun><CEP>12345678</CEP></endNac>",
                            "<trib><totTrib><pTotTribSN>6.00</pTotTribSN></totTrib></trib>"),
        "NFSe_004.xml": doc(59, "<NIF>ZZ-1234567</NIF>",
                            "<endExt><cPais>US</cPais><cEndPost>1</cEndPost><xCidade>NY</xCidade>"
                            "<xEstProvReg>NY</xEstProvReg></endExt>", "",
                            incid='<cLocIncid xsi:nil="true"/>'),
    }
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    inv = nfs.valid(nfs.extract(read_invoice_files(spark, folder + "/*.xml"), keep=["file_data"]))
    rows = {r.numero_nfse: r for r in inv.collect()}
    a, b = rows["80"], rows["59"]
    assert a.Tomador.cnpj == "01234567000199"          # leading zero kept
    assert a.servico.descricao_servico == "\nSuporte."  # leading newline kept
    assert a.servico.p_tributo_SN == 6.0 and b.servico.p_tributo_SN == 6.0
    assert b.codigo_local_incidencia is None            # nil element
    assert b.Tomador.endereco.cidade is None and b.Tomador.endereco.cep is None
    cat = {r.name: r for r in nfs.catalog(inv).collect()}
    assert set(cat) == {"NFSe_NFSe_001", "NFSe_NFSe_004"}
    assert cat["NFSe_NFSe_001"].Tomador == "01234567000199 (CNPJ) -- TOMADOR"
    assert cat["NFSe_NFSe_004"].Tomador == "ZZ-1234567 (NIF) -- TOMADOR"
    assert cat["NFSe_NFSe_001"].Prestador == "11222333000144 -- PRESTADOR LTDA"
    assert cat["NFSe_NFSe_001"].ValorServico == 1250.0


def test_missing_required_goes_to_quarantine(spark):
    bad = doc(1, "<CNPJ>1</CNPJ>", "", "").replace("<xNome>TOMADOR</xNome>", "")
    df = spark.createDataFrame([("f.xml", bad)], "file_data string, xml string")
    inv = nfs.extract(df, keep=["file_data"])
    assert nfs.valid(inv).count() == 0
    q = nfs.quarantine(inv).collect()
    assert q[0].missing == ["Tomador.nome"]


def test_same_stem_in_two_folders_is_one_object(spark):
    x = doc(1, "<CNPJ>1</CNPJ>", "", "")
    df = spark.createDataFrame([("/a/NFSe_9.xml", x), ("/b/NFSe_9.xml", x.replace("<nNFSe>1<", "<nNFSe>2<"))],
                               "file_data string, xml string")
    rows = nfs.catalog(nfs.valid(nfs.extract(df, keep=["file_data"]))).collect()
    assert [(r.name, r.file_data) for r in rows] == [("NFSe_NFSe_9", "/b/NFSe_9.xml")]


def test_missing_lists_all_in_order_and_is_empty_when_none(spark):
    x = doc(1, "<CNPJ>1</CNPJ>", "", "")
    bad = x.replace("<email>p@x.com</email>", "").replace("<xLocEmi>Vila Nova</xLocEmi>", "").replace("1180.00", "-")
    df = spark.createDataFrame([("a", x), ("b", bad), ("c", "<lote/>"), ("d", None)], "file_data string, xml string")
    rows = {r.file_data: r.missing for r in nfs.extract(df, keep=["file_data"]).collect()}
    assert rows == {"a": [], "b": ["local_emissao", "Prestador.email", "valor_liquido"], "c": ["NFSe"], "d": ["NFSe"]}


def test_generated_code_can_be_compiled(spark, monkeypatch):
    """The JVM never compiles a method of more than 8,000 bytes."""
    x = F.replace(F.lit(doc(1, "<CNPJ>1</CNPJ>", "", "")), F.lit("NFS1"), F.concat(F.lit("NFS"), F.col("id").cast("string")))
    docs = spark.range(3).select(F.format_string("%d.xml", "id").alias("file_data"), x.alias("xml"))
    monkeypatch.setattr(views, "invoice_documents", lambda spark, sf_dir: docs)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.nfse_extract(spark, "").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000
    assert {r.nfse_id for r in registry.nfse_extract(spark, "").collect()} == {"NFS0", "NFS1", "NFS2"}


def test_invoices_of_one_customer_are_dealt_to_many_tasks(spark, tmp_path):
    n = 800
    pq.write_table(pa.table({
        "o_orderkey": pa.array(range(n), pa.int64()), "o_custkey": pa.array([7] * n, pa.int64()),
        "o_orderstatus": ["O"] * n, "o_totalprice": [1.5] * n,
        "o_orderdate": pa.array([datetime.datetime(2030, 1, 2)] * n, pa.timestamp("us")),
        "o_orderpriority": ["1-URGENT"] * n}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({
        "c_custkey": pa.array([7, 8], pa.int64()), "c_name": ["A", "B"], "c_nationkey": pa.array([1, 2], pa.int32()),
        "c_acctbal": [1.0, -1.0], "c_mktsegment": ["X", "Y"]}), tmp_path / "customer.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = views.invoice_documents(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(r["count"] for r in rows) == n
    assert max(r["count"] for r in rows) <= n // 8
