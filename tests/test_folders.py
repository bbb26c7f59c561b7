"""Folders of files: XML records, cp1252 lines, a file per row, outputs rewritten by change."""

import datetime
import glob
import os
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from razao.operators import cdb
from razao.operators import invoices as nfs
from razao.operators import statements as stm
from razao.plans import folders
from razao.session import checkpoint_dir, shuffles_dropped
from razao.sinks import cashbook
from razao.sinks.named_files import remove_named_files, write_named_files
from razao.sources.documents import read_lines_cp1252, read_whole_text, read_xml_records
from tests.test_invoices import doc


def folder(files):
    path = tempfile.mkdtemp(prefix="razao-folder-")
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        with open(f"{path}/{name}", "wb") as fh:
            fh.write(data if isinstance(data, bytes) else data.encode())
    return path


def plain(n, **kw):
    return doc(n, "<CNPJ>1</CNPJ>", "", "", **kw)


def bare(n):
    return plain(n).split("?>", 1)[1]


# -- invoices ---------------------------------------------------------------


def test_records_of_all_kinds_of_files(spark):
    prefixed = bare(5).replace("<", "<p:").replace("<p:/", "</p:").replace("xmlns=", "xmlns:p=")
    path = folder({
        "one.xml": plain(1), "sub/two.v1.xml": plain(2), "lot.xml": f"<lote>{bare(3)}\n{bare(4)}</lote>", "pre.xml": prefixed,
        "broken.xml": f"<lote>{bare(6)}{bare(7).replace('</fone>', '</fon>')}{bare(8)}</lote>",
        "cut.xml": plain(9)[:300], "none.xml": "<a>no invoice</a>", "text.xml": "no xml", "empty.xml": ""})
    inv = nfs.read_folder(spark, path)
    good = {r.numero_nfse: r.object_name for r in nfs.valid(inv).collect()}
    assert good == {"1": "NFSe_one", "2": "NFSe_two", "3": "NFSe_lot_NFS3", "4": "NFSe_lot_NFS4", "5": "NFSe_pre",
                    "6": "NFSe_broken_NFS6", "8": "NFSe_broken_NFS8"}
    bad = {os.path.basename(r.file_data): r for r in nfs.quarantine(inv).collect()}
    assert all(r.missing == ["NFSe"] for r in bad.values())
    assert set(bad) == {"broken.xml", "cut.xml", "text.xml", "none.xml"}  # an empty file is none
    assert 'Id="NFS7"' in bad["broken.xml"].raw and 'Id="NFS8"' not in bad["broken.xml"].raw
    assert {r.name for r in nfs.catalog(nfs.valid(inv)).collect()} == set(good.values())


def test_small_files_are_not_listed_by_the_driver(spark, monkeypatch):
    path = folder({f"d{i % 3}/e {i}é%.xml": plain(i) for i in range(7)} | {"_hidden.xml": plain(8), ".part/x.xml": plain(9)})
    by_spark = {r.file_data for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                .select(F.col("_metadata.file_path").alias("file_data")).collect()}

    def load(self, *_, **__):
        raise AssertionError("the driver lists the files")

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameReader.load", load)
    got = read_xml_records(spark, path, "NFSe", nfs.NFSE_SCHEMA, nfs.XML_OPTIONS).collect()
    assert sorted(r.record.infNFSe._Id for r in got) == [f"NFS{i}" for i in range(7)]
    assert {r.file_data for r in got} == by_spark


ODD_XML = {
    "cdata.xml": f"<l><![CDATA[{bare(2)}]]>{bare(3)}<!-- {bare(4)} --></l>", "self.xml": "<l><NFSe/><NFSe></NFSe></l>",
    "nested.xml": bare(5).replace("</infNFSe>", "</infNFSe><NFSe/><NFSe><infNFSe Id='x'/></NFSe>"), "space.xml": " \n ",
    "spaces.xml": '<p:l xmlns:p="u&amp;v" a="x>y">' + bare(6).replace("<", "<p:").replace("<p:/", "</p:") + "</p:l>",
    "latin.xml": plain(7).replace("utf-8", "ISO-8859-1").replace("RUA A", "RUA É").encode("latin-1"), "tail.xml": plain(8) + "junk",
    "bom.xml": b"\xef\xbb\xbf" + plain(9).encode(), "end.xml": f"<l>{bare(10)}</m>", "two.xml": bare(11) + bare(12),
    "entity.xml": '<!DOCTYPE l [<!ENTITY e "E">]><l>' + bare(13).replace("RUA A", "&e;") + bare(14) + "</l>",
    "none.xml": "<a/>", "text.xml": "no xml", "empty.xml": ""}


def test_small_files_give_what_streamed_files_give(spark, monkeypatch):
    path = folder(ODD_XML)

    def rows():
        found = read_xml_records(spark, path, "NFSe", nfs.NFSE_SCHEMA, nfs.XML_OPTIONS).collect()
        return sorted(((r.file_data, r.record and str(r.record.asDict(True)), r.raw) for r in found), key=str)

    small = rows()
    monkeypatch.setattr("razao.sources.documents.LARGE_FILE", 0)
    assert small and small == rows()


def test_several_rows_of_a_file(spark, monkeypatch):
    path = folder({"one.xml": plain(1), "two.xml": f"<l>{bare(2)}{bare(3)}</l>", "broken.xml": f"<l>{bare(4)}{bare(5)}</m>",
                   "cut.xml": plain(6)[:300], "none.xml": "<a/>"})

    def several():
        rows = read_xml_records(spark, path, "NFSe", nfs.NFSE_SCHEMA, nfs.XML_OPTIONS).collect()
        return sorted((os.path.basename(r.file_data), r.several) for r in rows)

    small = several()
    assert small == [("broken.xml", True)] * 2 + [("cut.xml", False), ("none.xml", False), ("one.xml", False)] + [("two.xml", True)] * 2
    monkeypatch.setattr("razao.sources.documents.LARGE_FILE", 0)
    assert several() == small


def invoice_tables(path, n=240):
    """Orders of all kinds, one of them twice and one without a key, and their customers."""
    keys = [*range(1, n), 5]
    pq.write_table(pa.table({
        "o_orderkey": pa.array([None if k == n - 1 else k for k in keys], pa.int64()), "o_custkey": pa.array([k % 8 for k in keys], pa.int64()),
        "o_orderstatus": ["FPO"[k % 3] for k in keys], "o_totalprice": [k + 0.25 for k in keys],
        "o_orderdate": pa.array([datetime.datetime(2030, 1, 1 + k % 28) for k in keys], pa.timestamp("us")),
        "o_orderpriority": ["1-URGENT"] * len(keys)}), f"{path}/orders.parquet")
    pq.write_table(pa.table({
        "c_custkey": pa.array(range(8), pa.int64()), "c_name": [f"C{i}" for i in range(8)],
        "c_nationkey": pa.array([i % 5 for i in range(8)], pa.int32()), "c_acctbal": [i - 3.5 for i in range(8)],
        "c_mktsegment": ["X"] * 8}), f"{path}/customer.parquet")


@pytest.mark.parametrize("query", ["nfse_quarantine", "nfse_folder"])
def test_invoice_files_are_on_disk_a_part_at_a_time(spark, monkeypatch, tmp_path, query):
    invoice_tables(tmp_path)

    def on_disk():
        return {os.path.basename(p) for p in glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/invoices/*/part-*/*.xml")}

    before, seen = on_disk(), []
    read = nfs.read_folder

    def watched(spark, path):
        seen.append(on_disk() - before)
        return read(spark, path)

    monkeypatch.setattr(nfs, "read_folder", watched)
    monkeypatch.setattr(folders, "LOT", 20)

    def rows():
        return sorted(map(str, folders.QUERIES[query](spark, str(tmp_path)).collect()))

    whole = rows()
    assert len(whole) > 5 and len(seen) == 1 and not on_disk() - before
    monkeypatch.setattr(folders, "SLICE", 60)
    assert rows() == whole and not on_disk() - before
    first, parts = seen[0], seen[1:]
    assert len(parts) == 4 and set().union(*parts) == first and sum(map(len, parts)) == len(first)
    assert max(map(len, parts)) < len(first)


def test_files_go_when_their_rows_fail(spark, monkeypatch, tmp_path):
    invoice_tables(tmp_path, 30)
    monkeypatch.setattr(nfs, "quarantine", lambda inv: inv.select(F.raise_error(F.lit("no rows"))))
    roots = lambda: set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/invoices/*"))
    before = roots()
    with pytest.raises(Exception, match="no rows"):
        folders.nfse_quarantine(spark, str(tmp_path))
    assert roots() == before


def test_shuffle_files_go_with_their_action(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {n for top in disk.localDirs() for _, _, names in os.walk(top.getPath()) for n in names if n.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = shuffles(), spark.conf.get(key, None)
    path = tempfile.mkdtemp(prefix="razao-shuffle-") + "/out"
    with shuffles_dropped(spark):
        spark.range(1000).repartition(7, "id").write.parquet(path)
        for _ in range(50):  # they go in the background
            if not shuffles() - before:
                break
            time.sleep(0.2)
        assert not shuffles() - before
    assert spark.conf.get(key, None) == conf and spark.read.parquet(path).count() == 1000


def test_no_files(spark):
    inv = nfs.read_folder(spark, tempfile.mkdtemp(prefix="razao-folder-"))
    assert inv.count() == 0 and nfs.catalog(nfs.valid(inv)).count() == 0


def test_same_tag_nested_or_similar(spark):
    path = folder({"a.xml": "<r><rowx>no</rowx><row><v>1</v></row><row><v>2</w></row><row/><row><v>3</v></row></r>"})
    got = sorted((r.record.v if r.record else None, r.raw) for r in
                 read_xml_records(spark, path, "row", "v string", {}).collect() if r.record and r.record.v)
    assert got == [("1", None), ("3", None)]
    assert read_xml_records(spark, path, "row", "v string", {}).where("raw is not null").count() >= 1


REQUIRED = {
    "xLocEmi": "local_emissao", "xLocPrestacao": "local_prestacao", "nNFSe": "numero_nfse", "cLocIncid": "codigo_local_incidencia",
    "xTribNac": "descricao_servico", "dhProc": "data_processo", "dCompet": "Date", "vLiq": "valor_liquido", "vServ": "ValorServico",
    "xLgr": "Prestador.endereco.logradouro", "nro": "Prestador.endereco.numero", "xBairro": "Prestador.endereco.bairro",
    "cMun": "Prestador.endereco.cidade", "UF": "Prestador.endereco.uf", "CEP": "Prestador.endereco.cep", "fone": "Prestador.telefone",
    "email": "Prestador.email", "cTribNac": "servico.codigo_servico", "xDescServ": "servico.descricao_servico"}


def test_every_required_element(spark):
    """Absent: quarantined.  Empty: allowed, but for numbers."""
    import re

    rows = []
    for tag in REQUIRED:
        rows.append((tag, "absent", re.sub(f"(?s)<{tag}>.*?</{tag}>", "", plain(1), count=1)))
        rows.append((tag, "empty", re.sub(f"(?s)<{tag}>.*?</{tag}>", f"<{tag}/>", plain(1), count=1)))
    df = spark.createDataFrame(rows, "tag string, how string, xml string")
    got = {(r.tag, r.how): r.missing for r in nfs.extract(df).collect()}
    for tag, field in REQUIRED.items():
        assert got[tag, "absent"] == [field]
        assert got[tag, "empty"] == ([field] if tag in ("vLiq", "vServ") else [])


def test_tax_share_absent_empty_or_malformed(spark):
    share = lambda v: doc(1, "<CNPJ>1</CNPJ>", "", f"<trib><totTrib><pTotTribSN>{v}</pTotTribSN></totTrib></trib>")
    df = spark.createDataFrame([("absent", plain(1)), ("empty", share("")), ("bad", share("x")), ("good", share("4.5"))],
                               "how string, xml string")
    got = {r.how: (r.servico.p_tributo_SN, r.missing) for r in nfs.extract(df).collect()}
    assert got == {"absent": (6.0, []), "empty": (None, ["servico.p_tributo_SN"]), "bad": (None, ["servico.p_tributo_SN"]),
                   "good": (4.5, [])}


# -- lines ------------------------------------------------------------------


def test_lines_of_split_files_keep_their_order(spark):
    many = [f"linha {i} – “{i % 7}”" for i in range(3000)]
    path = folder({"a.txt": "\r\n".join(many).encode("cp1252"), "b.txt": "só\n\n  uma, \"aspas\"\n".encode("cp1252"),
                   "c.txt": b"caf\xe9 \x81 \x96\n", "d.txt": b""})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = read_lines_cp1252(spark, path).orderBy("file", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    of = lambda n: [r.line.rstrip("\r") for r in got if r.file.endswith(n)]
    assert of("a.txt") == many
    assert of("b.txt") == ["só", "  uma, \"aspas\""]
    assert of("c.txt") == ["café \x81 \x96"]  # a byte that cp1252 lacks: Latin-1 as a whole
    assert len({(r.file, r.pos) for r in got}) == len(got)


STATEMENT = """EXTRATO
Período: 01/01/2023 a 31/12/2023
BB CDB DI  Agencia
titulo
Data Historico Documento Valor
05/02 Aplicação™ 17
   1.250,00
06/02 Rendimento  mensal 17
   valor juros 3,50
RESUMO DOS DEPOSITOS EM SER
colunas
17 05/02/2023 1.250,00 1.253,50 0,95 05/02/2025
só dois
"""


def test_cdb_files_through_the_common_entry(spark):
    path = folder({"x/cdb.txt": STATEMENT.replace("titulo\n", "").encode("cp1252")})
    raw = stm.read_statements(spark, path, "bb-cdb")
    rows = sorted((str(r.Data), str(r.Valor), r.Categoria, r.account) for r in
                  stm.standardize(raw, "bb-cdb", keep=("account",)).collect())
    assert rows == [("2023-02-05", "1250.00", "Aplicação™", "CDBDI"), ("2023-02-06", "3.50", "Juros", "CDBDI")]
    parts = cdb.statement_files(spark, path)
    assert [float(r.Saldo) for r in parts["DEPOSITOS"].collect()] == [1253.5]
    assert [r.section for r in parts["quarantine"].collect()] == ["DEPOSITOS"]
    assert stm.quarantine(raw, "bb-cdb").count() == 0


def test_table_dialects_through_the_common_entry(spark):
    path = folder({"s.csv": "Data,Histórico,Valor,Número do documento,Detalhes\n01/02/2024,Pix,\"-10,50\",7,x\nx,Pix,\"1,00\",8,\n".encode("cp1252")})
    raw = stm.read_statements(spark, path, "bb-cc")
    assert [(r.Lancamento, float(r.Valor), r.Documento) for r in stm.standardize(raw, "bb-cc").collect()] == [("Pix", -10.5, "7")]
    assert [r.reason for r in stm.quarantine(raw, "bb-cc").collect()] == ["bad_date"]


# -- a file per row ---------------------------------------------------------


def names(path):
    return sorted(os.path.basename(p) for p in glob.glob(f"{path}/part-*/*"))


def test_files_are_committed_together(spark):
    path = tempfile.mkdtemp(prefix="razao-named-") + "/out"
    df = spark.range(20).select(F.format_string("n%d.md", "id").alias("name"), F.concat(F.lit("té\n\nxt "), "id").alias("text"))
    write_named_files(df.repartition(3), path)
    assert names(path) == sorted(f"n{i}.md" for i in range(20))
    back = {os.path.basename(r.file_data): r.text for r in read_whole_text(spark, path).collect()}
    assert back["n7.md"] == "té\n\nxt 7" and len(back) == 20
    bad = df.select(F.when(F.col("name") == "n3.md", F.lit("a/b")).otherwise(F.col("name")).alias("name"), "text")
    with pytest.raises(Exception, match="not a file name"):
        write_named_files(bad.repartition(4), path)
    assert names(path) == sorted(f"n{i}.md" for i in range(20)) and not glob.glob(f"{path}/_staging*")
    write_named_files(df.limit(2), "file://" + path, "overwrite")
    assert names(path) == ["n0.md", "n1.md"]
    data = spark.createDataFrame([("raw.bin", bytearray(b"\x00\xff"))], "name string, content binary")
    write_named_files(data, path)
    assert names(path) == ["n0.md", "n1.md", "raw.bin"]
    with open(glob.glob(f"{path}/part-*/raw.bin")[0], "rb") as fh:
        assert fh.read() == b"\x00\xff"


def test_files_are_removed(spark):
    path = tempfile.mkdtemp(prefix="razao-named-") + "/out"
    df = spark.range(9).select(F.format_string("n%d.md", "id").alias("name"), F.lit("x").alias("text"))
    for p in (path, "file://" + path):
        write_named_files(df.repartition(3), p)
        remove_named_files(spark, p)
        assert not os.path.exists(path)
    write_named_files(df.limit(0), path)
    remove_named_files(spark, path)
    assert not os.path.exists(path)


def test_names_of_a_task_are_its_own(spark):
    df = spark.createDataFrame([("a.md", "1"), ("a.md", "2")], "name string, text string").coalesce(1)
    path = tempfile.mkdtemp(prefix="razao-named-") + "/out"
    with pytest.raises(Exception, match="not a file name"):
        write_named_files(df, path)
    assert names(path) == []


# -- cash-flow outputs --------------------------------------------------------


def put(spark, root, rows, mode="append"):
    df = spark.createDataFrame(rows, "Data string, Categoria string, Valor string, Descricao string, Conta string, Ano int")
    (df.select(F.col("Data").cast("timestamp_ntz").alias("Data"), "Categoria", F.col("Valor").cast("decimal(18,2)").alias("Valor"),
               "Descricao", "Conta", "Ano").coalesce(1).write.mode(mode).partitionBy("Conta", "Ano").parquet(f"{root}/t1"))


def run(spark, root):
    return sorted(map(tuple, cashbook.update(spark, f"{root}/t1", f"{root}/out", f"{root}/state").collect()))


def files(root, scale):
    return {p: os.stat(p).st_ino for p in glob.glob(f"{root}/out/{scale}/**/*.csv", recursive=True)}


def consolidated(spark, root):
    rows = cashbook.read_output(spark, f"{root}/out", "O_ANUAL", "Categoria string, Entradas double, Entradas_N long, Saidas double, "
                                "Saidas_N long, Fluxo double, Entradas_Acum double, Saidas_Acum double, Fluxo_Acum double, OIR double, "
                                "Ano int, Conta string").collect()
    return sorted((r.Conta, r.Ano, r.Entradas, r.Saidas, r.Entradas_N) for r in rows)


def test_only_changed_years_are_written(spark):
    root = tempfile.mkdtemp(prefix="razao-cashbook-")
    put(spark, root, [("2020-03-04", "a;\"x\"", "10.00", "d", "001", 2020), ("2021-01-01", None, "-4.00", "", "001", 2021),
                      ("2021-05-05", "b", "7.50", "línea\nquebrada", "BB CC", 2021)])
    assert run(spark, root) == [("001", 2020), ("001", 2021), ("BB CC", 2021)]
    assert consolidated(spark, root) == [("001", 2020, 10.0, 0.0, 1), ("001", 2021, 0.0, -4.0, 0), ("BB CC", 2021, 7.5, 0.0, 1)]
    before = {s: files(root, s) for s in cashbook.SCALES}
    assert run(spark, root) == []  # nothing new, nothing written
    assert {s: files(root, s) for s in cashbook.SCALES} == before

    put(spark, root, [("2021-02-01", "c", "1.00", "", "001", 2021)])
    assert run(spark, root) == [("001", 2021)]
    for scale in cashbook.SCALES:
        after = files(root, scale)
        same = {p for p in after if before[scale].get(p) == after[p]}
        assert {("Conta=001/Ano=2020" in p, "BB" in p) for p in same} == {(True, False), (False, True)}
        assert all("Conta=001/Ano=2021" in p for p in set(after) - same)
    assert consolidated(spark, root) == [("001", 2020, 10.0, 0.0, 1), ("001", 2021, 1.0, -4.0, 1), ("BB CC", 2021, 7.5, 0.0, 1)]

    for p in glob.glob(f"{root}/t1/Conta=001/Ano=2020/*.parquet"):  # a year's files are gone
        os.remove(p)
    assert run(spark, root) == [("001", 2020)]
    assert consolidated(spark, root) == [("001", 2021, 1.0, -4.0, 1), ("BB CC", 2021, 7.5, 0.0, 1)]


def test_consolidated_files_are_in_order(spark):
    root = tempfile.mkdtemp(prefix="razao-cashbook-")
    put(spark, root, [(f"20{20 + i % 3}-{i % 12 + 1:02d}-{i % 28 + 1:02d}", "x", f"{i}.00", "", "A", 2020 + i % 3) for i in range(90)])
    run(spark, root)
    dates = []
    for p in sorted(glob.glob(f"{root}/out/O_DIARIO/Conta=A/*.csv")):
        with open(p, encoding="utf-8") as fh:
            head = fh.readline().strip().split(";")
            dates += [line.split(";")[head.index("Data")] for line in fh]
    assert len(dates) == 90 and dates == sorted(dates)
