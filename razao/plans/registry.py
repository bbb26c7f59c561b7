"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads whole driver tables (through ``views``) and is matched by
an oracle SQL text in ``oracle`` under the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts as amt
from ..functions import dates as dts
from ..operators import budget as bdg
from ..operators import cashflow as cfo
from ..operators import catalog as cat
from ..operators import cdb as cdbo
from ..operators import files as fls
from ..operators import invoices as nfs
from ..operators import keyvalue as kvo
from ..operators import notes as nts
from ..operators import records as rec
from ..operators import report as rpt
from ..operators import statements as stm
from ..operators import tax as taxo
from ..session import scratch_path
from ..sinks import writers as wr
from ..sources import csv as csvs
from ..streaming import incremental as inc
from . import views

Query = Callable[[SparkSession, str], DataFrame]


def cf_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfo.monthly_summary(views.cash_flow(spark, sf_dir, with_category=False))


def cf_monthly_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfo.monthly_summary(views.cash_flow(spark, sf_dir), by_category=True)


def cf_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = cfo.monthly_summary(views.cash_flow(spark, sf_dir, with_category=False), rounded=False)
    return cfo.yearly_summary(monthly)


def cf_yearly_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = cfo.monthly_summary(views.cash_flow(spark, sf_dir), by_category=True, rounded=False)
    return cfo.yearly_summary(monthly)


QUERIES: dict[str, Query] = {
    "cf_monthly": cf_monthly,
    "cf_monthly_category": cf_monthly_category,
    "cf_yearly": cf_yearly,
    "cf_yearly_category": cf_yearly_category,
}


# --------------------------------------------------------------------------
# report: panel, summary, opening balances
# --------------------------------------------------------------------------

REPORT_YEAR = 1998


def report_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.opening_balances(views.cash_flow(spark, sf_dir, with_category=False))


def report_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cf = views.cash_flow(spark, sf_dir)
    opening = rpt.opening_balances(views.cash_flow(spark, sf_dir, with_category=False))
    return rpt.cashflow_panel(cf, REPORT_YEAR, opening=opening)


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpt.cashflow_summary(views.cash_flow(spark, sf_dir), REPORT_YEAR)


QUERIES.update({
    "report_opening": report_opening,
    "report_panel": report_panel,
    "report_summary": report_summary,
})


# --------------------------------------------------------------------------
# statements: raw -> canonical, drops, amounts, currency text
# --------------------------------------------------------------------------


def _canonical_out(df: DataFrame) -> DataFrame:
    return df.withColumn("Valor", F.col("Valor").cast("double"))


def t0_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_out(stm.standardize(views.statement_personal(spark, sf_dir), "bb-cc"))


def t0_header_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.statement_personal(spark, sf_dir, legacy_header=True)
    return _canonical_out(stm.standardize(raw, "bb-cc"))


def t0_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stm.drop_report(views.statement_personal(spark, sf_dir), "bb-cc")


def pj_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_out(stm.standardize(views.statement_company(spark, sf_dir), "bb-ccpj"))


def pj_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stm.drop_report(views.statement_company(spark, sf_dir), "bb-ccpj")


def pp_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_out(stm.standardize(views.statement_savings(spark, sf_dir), "bb-pp"))


def amount_br(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.statement_personal(spark, sf_dir)
    return raw.select(F.col("`N° documento`").alias("Documento"), F.col("Valor").alias("Texto"),
                      amt.br_amount("Valor").cast("double").alias("Valor"),
                      amt.br_number("Valor").cast("double").alias("Valor_Numero"))


def amount_cd(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.statement_company(spark, sf_dir)
    return raw.select(F.col("`N° documento`").alias("Documento"), F.col("Valor").alias("Texto"),
                      amt.cd_amount("Valor").cast("double").alias("Valor"))


def currency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_acctbal", amt.currency_text("c_acctbal").alias("Texto"))


QUERIES.update({
    "t0_standardize": t0_standardize,
    "t0_header_alias": t0_header_alias,
    "t0_drops": t0_drops,
    "pj_standardize": pj_standardize,
    "pj_drops": pj_drops,
    "pp_standardize": pp_standardize,
    "amount_br": amount_br,
    "amount_cd": amount_cd,
    "currency_text": currency_text,
})


# --------------------------------------------------------------------------
# budget and record tables
# --------------------------------------------------------------------------

AS_OF = "1998-06-30 00:00:00"          # fixed "now" of clock-reading operators
STAMP_AS_OF = "2025-01-01 00:00:00"    # fixed audit stamp of record edits
RECURRENCE_YEAR = 1998


def _signed_budget(spark, sf_dir):
    return bdg.signed(views.budget(spark, sf_dir))


def budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bdg.totals(_signed_budget(spark, sf_dir))


def budget_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bdg.summary_by(_signed_budget(spark, sf_dir), "Status")


def budget_by_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bdg.summary_by(_signed_budget(spark, sf_dir), "Contract")


def budget_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bdg.summary_by(_signed_budget(spark, sf_dir), "Tags")


def budget_tag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bdg.tag_tokens(_signed_budget(spark, sf_dir))


def budget_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bdg.summary_by_type(_signed_budget(spark, sf_dir))


def budget_auto_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.budget(spark, sf_dir)
    return b.select("RecId", "Status", "Method", "Date_Due",
                    bdg.auto_status(AS_OF).alias("Status_Updated"))


def _freq_of_status() -> "F.Column":
    s = F.col("Status")
    return (F.when(s == "Executed", F.lit("W")).when(s == "Expected", F.lit("MS"))
            .when(s == "Prospected", F.lit("QS")).when(s == "Cancelled", F.lit("ME"))
            .otherwise(F.lit("YS")))


def budget_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tpl = views.budget(spark, sf_dir).withColumn("Freq", _freq_of_status())
    out = bdg.expand_annual(tpl.select("RecId", "Freq", "Value", "Date_Due"), RECURRENCE_YEAR)
    return out.withColumn("Value", F.col("Value").cast("double"))


def budget_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bdg.apply_formulas(views.budget(spark, sf_dir), bdg.budget_formulas(AS_OF))
    return b.select("RecId", "Sign", F.col("Value_Signed").cast("double").alias("Value_Signed"), "Status")


def rec_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.conform(views.budget_raw(spark, sf_dir), "Budget", bdg.BUDGET_DATA_COLUMNS,
                       order_cols=["o_orderkey"], as_of=STAMP_AS_OF)


def _customer_entries(spark, sf_dir):
    c = views.read_table(spark, sf_dir, "customer")
    bal = F.col("c_acctbal")
    return c.select(
        "c_custkey",
        F.when(bal >= 0, F.lit("Revenue")).otherwise(F.lit("Expense")).alias("Type"),
        F.lit("Expected").alias("Status"),
        F.concat(F.lit("C"), F.pmod(F.col("c_custkey"), F.lit(20)).cast("string")).alias("Contract"),
        F.col("c_name").alias("Name"),
        F.abs(bal).cast(amt.MONEY).alias("Value"),
        F.col("c_mktsegment").alias("Tags"),
    )


def rec_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.insert_records(views.budget(spark, sf_dir), _customer_entries(spark, sf_dir),
                              bdg.BUDGET_DATA_COLUMNS, "Budget", order_cols=["c_custkey"],
                              as_of=STAMP_AS_OF)


def _edits(spark, sf_dir):
    o = views.read_table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "2-HIGH")
    return o.select(
        F.format_string("Rec%04d", F.col("o_orderkey") + 1).alias("RecId"),
        F.create_map(F.lit("Status"), F.lit("Executed"), F.lit("Date_Exe"),
                     F.date_add(F.to_date("o_orderdate"), 30).cast("string")).alias("changes"))


def rec_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.edit_records(views.budget(spark, sf_dir), _edits(spark, sf_dir), as_of=STAMP_AS_OF,
                            data_columns=bdg.BUDGET_DATA_COLUMNS)


def rec_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.read_table(spark, sf_dir, "orders")
    ids = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))) \
        .select(F.format_string("Rec%04d", F.col("o_orderkey") + 1).alias("RecId"))
    return rec.archive_records(views.budget(spark, sf_dir), ids, as_of=STAMP_AS_OF)


def rec_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.next_id(views.budget(spark, sf_dir))


def rec_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.vertical(views.budget(spark, sf_dir))


def rec_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.active(views.budget(spark, sf_dir))


def rec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.read_table(spark, sf_dir, "lineitem")
    ids = li.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")) \
        .select(F.format_string("Rec%04d", F.col("l_orderkey") + 1).alias("RecId"))
    return rec.lookup(views.budget(spark, sf_dir), ids)


def rec_first_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.read_table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.format_string("Rec%04d", F.col("l_orderkey") + 1).alias("RecId"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("Name"),
        F.col("l_extendedprice").cast(amt.MONEY).alias("Value"),
        "l_linenumber", "l_partkey", "l_suppkey")
    # "first" = smallest line number; part and supplier break ties
    return rec.conform(rows, "Budget", bdg.BUDGET_DATA_COLUMNS,
                       order_cols=["l_linenumber", "l_partkey", "l_suppkey"],
                       as_of=STAMP_AS_OF)


def running_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.budget(spark, sf_dir).select("RecId", "Date_Due")
    secs = dts.running_seconds("Date_Due", STAMP_AS_OF)
    parts = dts.interval_parts(secs)
    return b.select("RecId", secs.alias("Seconds_Total"), parts.alias("p"),
                    dts.age_years("Date_Due", STAMP_AS_OF).alias("Age")) \
        .select("RecId", "Seconds_Total", "p.*", "Age")


def interval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.budget(spark, sf_dir).select("RecId", "Date_Due")
    parts = dts.interval_parts(dts.running_seconds("Date_Due", STAMP_AS_OF))
    return b.select("RecId", dts.interval_text(parts).alias("Running"),
                    dts.interval_text(parts, {"Years": "Expected years", "Days": "d"}).alias("Custom"))


QUERIES.update({
    "budget_totals": budget_totals,
    "budget_by_status": budget_by_status,
    "budget_by_contract": budget_by_contract,
    "budget_by_tags": budget_by_tags,
    "budget_tag_tokens": budget_tag_tokens,
    "budget_by_type": budget_by_type,
    "budget_auto_status": budget_auto_status,
    "budget_recurrence": budget_recurrence,
    "budget_formulas": budget_formulas,
    "rec_conform": rec_conform,
    "rec_insert": rec_insert,
    "rec_edit": rec_edit,
    "rec_archive": rec_archive,
    "rec_next_id": rec_next_id,
    "rec_vertical": rec_vertical,
    "rec_active": rec_active,
    "rec_lookup": rec_lookup,
    "rec_first_dup": rec_first_dup,
    "running_time": running_time,
    "interval_text": interval_text,
})


# --------------------------------------------------------------------------
# catalog, tax
# --------------------------------------------------------------------------


def _catalog(spark, sf_dir, ordered=False):
    return cat.latest(views.catalog_log(spark, sf_dir), ordered=ordered).withColumn("alias", cat.alias_of("name"))


def catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir, ordered=True)


def catalog_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.read_table(spark, sf_dir, "events")
    names = ev.filter((F.col("event_type") == "signup") & (F.col("value") > 300)).select(
        F.concat(F.lit("User_"), F.col("user_id").cast("string")).alias("name"))
    return cat.remove(_catalog(spark, sf_dir), names)


def catalog_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = cat.latest(views.catalog_log(spark, sf_dir), ordered=False)
    renames = latest.filter(F.col("source") == "purchase").select(
        F.col("name").alias("old_name"), F.regexp_replace("name", "^User_", "Member_").alias("new_name"))
    return cat.refresh(views.catalog_log(spark, sf_dir), renames).withColumn("alias", cat.alias_of("name"))


def catalog_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.size(_catalog(spark, sf_dir))


def catalog_metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.metadata_rows(_catalog(spark, sf_dir))


def catalog_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.read_table(spark, sf_dir, "events")
    names = ev.select(F.col("user_id").cast("string").alias("name")).distinct()
    return names.select("name", cat.alias_of("name").alias("alias"))


def dict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = views.read_table(spark, sf_dir, "events")
    inner = F.map_concat(
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")),
        F.when(F.col("event_type") == "purchase",
               F.create_map(F.lit("value"), F.col("value").cast("string")))
        .otherwise(F.create_map().cast("map<string,string>")))
    entries = ev.select(F.col("event_id").cast("string").alias("key"), "event_id", inner.alias("fields"))
    return cat.dict_table(entries, "key", "fields", "event_id")


def catalog_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.preview(_catalog(spark, sf_dir))


def _salaries(spark, sf_dir):
    c = views.read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.col("c_acctbal").cast(amt.MONEY).alias("amount"))


def tax_inss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taxo.inss(_salaries(spark, sf_dir), "amount")
    return out.withColumns({"amount": F.col("amount").cast("double"),
                            "inss_rate": F.col("inss_rate").cast("double")})


def tax_irrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taxo.irrf(_salaries(spark, sf_dir), "amount")
    return out.withColumns({c: F.col(c).cast("double") for c in
                            ("amount", "irrf_rate", "irrf_deduction", "irrf_tax")})


QUERIES.update({
    "catalog_latest": catalog_latest,
    "catalog_remove": catalog_remove,
    "catalog_refresh": catalog_refresh,
    "catalog_size": catalog_size,
    "catalog_metadata_rows": catalog_metadata_rows,
    "catalog_alias": catalog_alias,
    "dict_table": dict_table,
    "catalog_preview": catalog_preview,
    "tax_inss": tax_inss,
    "tax_irrf": tax_irrf,
})


# --------------------------------------------------------------------------
# invoices
# --------------------------------------------------------------------------


def _invoices(spark, sf_dir):
    return nfs.valid(nfs.extract(views.invoice_documents(spark, sf_dir), keep=["file_data"]))


def nfse_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the nested invoice rows, flattened for comparison."""
    i = _invoices(spark, sf_dir)
    p, t, s = F.col("Prestador"), F.col("Tomador"), F.col("servico")
    return i.select(
        "file_data", "nfse_id", "local_emissao", "local_prestacao", "numero_nfse",
        "codigo_local_incidencia", "descricao_servico", "valor_liquido", "data_processo", "Date",
        p["cnpj"].alias("prestador_cnpj"), p["nome"].alias("prestador_nome"),
        p["endereco"]["logradouro"].alias("prestador_logradouro"), p["endereco"]["numero"].alias("prestador_numero"),
        p["endereco"]["bairro"].alias("prestador_bairro"), p["endereco"]["cidade"].alias("prestador_cidade"),
        p["endereco"]["uf"].alias("prestador_uf"), p["endereco"]["cep"].alias("prestador_cep"),
        p["telefone"].alias("prestador_telefone"), p["email"].alias("prestador_email"),
        t["cnpj"].alias("tomador_cnpj"), t["nif"].alias("tomador_nif"), t["nome"].alias("tomador_nome"),
        t["endereco"]["logradouro"].alias("tomador_logradouro"), t["endereco"]["numero"].alias("tomador_numero"),
        t["endereco"]["complemento"].alias("tomador_complemento"), t["endereco"]["bairro"].alias("tomador_bairro"),
        t["endereco"]["cidade"].alias("tomador_cidade"), t["endereco"]["cep"].alias("tomador_cep"),
        s["codigo_servico"].alias("servico_codigo"), s["descricao_servico"].alias("servico_descricao"),
        "ValorServico", s["p_tributo_SN"].alias("p_tributo_SN"),
    )


def nfse_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nfs.catalog(_invoices(spark, sf_dir))


def nfse_party_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _invoices(spark, sf_dir)
    return i.select("file_data", nfs.emitter_label().alias("Prestador"), nfs.taker_label().alias("Tomador"))


QUERIES.update({
    "nfse_extract": nfse_extract,
    "nfse_catalog": nfse_catalog,
    "nfse_party_label": nfse_party_label,
})


# --------------------------------------------------------------------------
# CDB text statements
# --------------------------------------------------------------------------


def _cdb(spark, sf_dir):
    return cdbo.parse(views.cdb_statement_lines(spark, sf_dir))


def _doubles(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def cdb_extrato(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _cdb(spark, sf_dir)["EXTRATO"].drop("pos")
    return _doubles(e, ["Valor"])


def cdb_saldos(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _cdb(spark, sf_dir)["SALDOS"].drop("pos")
    return _doubles(s, ["Capital_Inicial", "Juros", "IR_Projetado", "Capital_Projetado"])


def cdb_depositos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cdb(spark, sf_dir)["DEPOSITOS"].drop("pos")
    return _doubles(d, ["Capital", "Saldo", "Taxa"])


def cdb_rendimentos(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _cdb(spark, sf_dir)["RENDIMENTOS"].drop("pos")
    return _doubles(r, ["Rendimento_Bruto"])


QUERIES.update({
    "cdb_extrato": cdb_extrato,
    "cdb_saldos": cdb_saldos,
    "cdb_depositos": cdb_depositos,
    "cdb_rendimentos": cdb_rendimentos,
})


# --------------------------------------------------------------------------
# notes
# --------------------------------------------------------------------------


def note_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nts.front_matter_long(views.note_documents(spark, sf_dir))


def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nts.sections(views.note_documents(spark, sf_dir))


def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nts.tags(views.note_documents(spark, sf_dir))


def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nts.links(views.note_documents(spark, sf_dir))


def note_squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nts.squeeze(views.note_documents(spark, sf_dir))


def note_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.note_documents(spark, sf_dir)
    return nts.render(nts.front_matter_long(docs), nts.sections(docs))


QUERIES.update({
    "note_frontmatter": note_frontmatter,
    "note_sections": note_sections,
    "note_tags": note_tags,
    "note_links": note_links,
    "note_squeeze": note_squeeze,
    "note_render": note_render,
})


# --------------------------------------------------------------------------
# files, sources and sinks, incremental processing, consolidated outputs
# --------------------------------------------------------------------------


def _scratch(spark, name):
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def _statement_files(spark, sf_dir):
    """One raw statement file per (user, day) of ``events``, with its
    account type from the user (three dialects)."""
    ev = views.read_table(spark, sf_dir, "events")
    acc = F.element_at(F.array(F.lit("bb-cc"), F.lit("bb-ccpj"), F.lit("bb-pp")),
                       (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int"))
    code = fls.account_codes(acc)
    day = F.date_format("ts", "yyyy-MM-dd")
    path = F.concat(F.lit("/extratos/"), F.date_format("ts", "yyyy"), F.lit("/"),
                    F.concat_ws("_", F.lit(fls.T0_PREFIX), code["bank"],
                                F.concat(code["account"], F.col("user_id").cast("string")), day),
                    F.lit("_T0.csv"))
    return ev.select(path.alias("path"), acc.alias("account_type"), "user_id", "event_type", "ts")


def tier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _statement_files(spark, sf_dir).select("path", "account_type").distinct()
    reg = F.broadcast(stm.registry_table(spark))          # 4 rows
    f = f.join(reg, "account_type", "left")
    code = fls.account_codes("account_type")
    year = fls.year_of_folder("path")
    names = fls.cash_names(code["bank"], code["account"], year)
    return f.select("path", year.alias("year"), fls.base_name(fls.t1_name("path")).alias("t1_file"),
                    code["bank"].alias("bank_code"), code["account"].alias("account_code"),
                    F.col("bank").alias("bank_name"), F.col("account").alias("account_name"),
                    names["DIARIO"].alias("daily_file"), names["MENSAL"].alias("monthly_file"),
                    names["ANUAL"].alias("yearly_file"))


def files_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _statement_files(spark, sf_dir)
    t0 = f.select("path").distinct()
    # canonical outputs exist for the statements with a purchase
    t1 = f.filter(F.col("event_type") == "purchase").select(fls.t1_name("path").alias("path")).distinct()
    return fls.unprocessed(t0, t1)


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.read_table(spark, sf_dir, "orders")
    rec_id = F.format_string("Rec%04d", F.col("o_orderkey") + 1)
    refs = o.select(rec_id.alias("RecId"), F.explode(F.array(
        F.struct(F.lit("File_Invoice").alias("field"),
                 F.format_string("/invoices/NFSe_%06d.xml", F.col("o_orderkey")).alias("file")),
        F.struct(F.lit("File_Receipt").alias("field"),
                 F.when(F.col("o_orderstatus") == "F",
                        F.format_string("/receipts/R_%06d.pdf", F.col("o_orderkey"))).alias("file")),
    )).alias("r")).select("RecId", "r.field", "r.file").filter(F.col("file").isNotNull())
    # the manifest of stored files is written and read back as a ';' table
    folder = _scratch(spark, "manifest")
    manifest = views.invoice_documents(spark, sf_dir).select(
        F.lit("/invoices").alias("folder"), fls.base_name("file_data").alias("file"),
        F.lit("NFSe_{n}.xml").alias("file_template"))
    wr.write_table_csv(manifest, folder)
    inv = csvs.read_table_csv(spark, folder, schema=csvs.MANIFEST_SCHEMA) \
        .select(F.concat_ws("/", "folder", "file").alias("path"))
    return fls.file_status(refs, inv)


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fls.inventory(spark, f"{sf_dir}/*.parquet").drop("path")


def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.read_table(spark, sf_dir, "lineitem")
    folder = _scratch(spark, "typed_scan")
    wr.write_table_csv(li.select(
        F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("rm"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("tas"),
        F.col("l_linestatus").alias("label")), folder)
    return csvs.read_typed(spark, folder, "p double, rm double, tas double, label string", ["p", "rm", "tas"])


def multi_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    personal = stm.standardize(views.statement_personal(spark, sf_dir), "bb-cc")
    savings = stm.standardize(views.statement_savings(spark, sf_dir), "bb-pp")
    root = _scratch(spark, "multi_file_scan")
    wr.write_table_csv(personal.withColumn("Ano", F.year("Data")), f"{root}/cc", partition_by=["Ano"])
    wr.write_table_csv(savings, f"{root}/pp")
    return csvs.read_many(spark, [f"{root}/cc", f"{root}/pp"]).drop("file")


def roundtrip_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bdg.signed(views.budget(spark, sf_dir))
    path = _scratch(spark, "records")
    wr.export_records(b, path, bdg.BUDGET_DATA_COLUMNS, only_active=True)
    return csvs.read_table_csv(spark, path)


def kv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = views.read_table(spark, sf_dir, "conversations")
    return kvo.pivot_fields(conv, "conv_id", "role", "text", "turn", ["system", "user", "assistant"])


def cf_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cfo.consolidated_daily(views.cash_flow(spark, sf_dir))
    return out.withColumn("Valor", F.col("Valor").cast("double"))


def t0_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "incremental")
    raw = views.statement_personal(spark, sf_dir).withColumn(
        "Mes", F.concat(F.substring("Data", 7, 4), F.lit("-"), F.substring("Data", 4, 2)))
    raw.write.partitionBy("Mes").option("header", True).option("encoding", "ISO-8859-1") \
        .option("quoteAll", True).option("escape", '"').csv(f"{root}/t0")
    inc.run_incremental(spark, f"{root}/t0", f"{root}/t1", f"{root}/ckpt")
    inc.run_incremental(spark, f"{root}/t0", f"{root}/t1", f"{root}/ckpt")   # no new files: no rows
    t1 = spark.read.parquet(f"{root}/t1").drop("batch")
    return t1.select(*stm.CANONICAL).withColumn("Valor", F.col("Valor").cast("double"))


QUERIES.update({
    "tier_names": tier_names,
    "files_unprocessed": files_unprocessed,
    "file_status": file_status,
    "file_inventory": file_inventory,
    "typed_scan": typed_scan,
    "multi_file_scan": multi_file_scan,
    "roundtrip_export": roundtrip_export,
    "kv_pivot": kv_pivot,
    "cf_consolidated": cf_consolidated,
    "t0_incremental": t0_incremental,
})


def cf_file_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch tool end to end: daily cash flow written per year as ';'
    CSV, read back with a typed schema, monthly summary."""
    root = _scratch(spark, "cashflow_files")
    daily = cfo.priority_order(views.cash_flow(spark, sf_dir))
    wr.write_table_csv(daily.withColumn("Ano", F.year("Data")), f"{root}/diario", partition_by=["Ano"])
    back = csvs.read_table_csv(
        spark, f"{root}/diario",
        schema="Data timestamp_ntz, Categoria string, Valor decimal(18,2), Descricao string, Ano int",
        columns=["Data", "Categoria", "Valor", "Descricao"])
    return cfo.monthly_summary(back)


def t0_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw statements written as ',' CSV files (one folder per month),
    scanned back as text (cp1252 rules) and standardised."""
    root = _scratch(spark, "t0_csv")
    raw = views.statement_personal(spark, sf_dir).withColumn(
        "Mes", F.concat(F.substring("Data", 7, 4), F.lit("-"), F.substring("Data", 4, 2)))
    raw.write.partitionBy("Mes").option("header", True).option("encoding", "ISO-8859-1") \
        .option("quoteAll", True).option("escape", '"').csv(f"{root}/t0")
    back = csvs.read_raw_statement(spark, f"{root}/t0", columns=inc.RAW_COLUMNS["bb-cc"])
    t1 = stm.standardize(back, "bb-cc")
    return t1.withColumn("Valor", F.col("Valor").cast("double"))


def report_panel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report panel with the opening balances read from a ';' balances file."""
    path = _scratch(spark, "saldos")
    opening = rpt.opening_balances(views.cash_flow(spark, sf_dir, with_category=False))
    wr.write_table_csv(opening, path)
    saldos = csvs.read_table_csv(spark, path, schema=csvs.BALANCES_SCHEMA)
    return rpt.cashflow_panel(views.cash_flow(spark, sf_dir), REPORT_YEAR, opening=saldos)


def dataset_bootfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset export with its metadata boot file, read back as one record
    restricted to the expected fields."""
    root = _scratch(spark, "dataset")
    data = views.cash_flow(spark, sf_dir)
    fields = [("name", F.lit("CashFlow")), ("alias", cat.alias_of(F.lit("CashFlow"))),
              ("size", F.col("size").cast("string")), ("start", F.col("start").cast("string")),
              ("end", F.col("end").cast("string")), ("source", F.lit("lineitem"))]
    meta = data.agg(F.count(F.lit(1)).alias("size"), F.min("Data").alias("start"),
                    F.max("Data").alias("end")).select(F.explode(F.array(*[
                        F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields])).alias("m")) \
        .select("m.field", "m.value")
    data_path, meta_path = wr.export_dataset(data, meta, root, "cashflow", suffix="bootfile")
    kv = csvs.read_key_values(spark, meta_path).withColumn("id", F.lit("CashFlow")) \
        .withColumn("seq", F.monotonically_increasing_id())
    return kvo.pivot_fields(kv, "id", "field", "value", "seq", ["name", "alias", "size", "start", "end"])


QUERIES.update({
    "cf_file_pipeline": cf_file_pipeline,
    "t0_csv_scan": t0_csv_scan,
    "report_panel_files": report_panel_files,
    "dataset_bootfile": dataset_bootfile,
})


def cf_consolidated_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated yearly file of the batch tool: each year's summary is
    computed on its own, so its cumulatives restart every year."""
    monthly = cfo.monthly_summary(views.cash_flow(spark, sf_dir, with_category=False), rounded=False)
    return cfo.yearly_summary(monthly, cumulative_across_years=False).orderBy("Ano")


QUERIES["cf_consolidated_yearly"] = cf_consolidated_yearly


def rec_export_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the lookup set exported in Field;Value form and read back."""
    path = _scratch(spark, "record_fields")
    wr.export_record_fields(rec.vertical(rec_lookup(spark, sf_dir)), path)
    return csvs.read_table_csv(spark, path, schema="RecId string, Field string, Value string")


QUERIES["rec_export_fields"] = rec_export_fields


def _mixed_statements(spark: SparkSession, sf_dir: str) -> str:
    """Statement files of three layouts: current headers, legacy headers, and
    another column order; with quotes and line breaks inside cells, unpadded
    dates between white space, and dates and amounts that cannot be read."""
    raw = views.statement_personal(spark, sf_dir)
    n = F.col("`N° documento`").cast("long")
    raw = raw.withColumns({
        "_n": n,
        "Detalhes": F.when(n % 5 == 0, F.concat(F.lit('said "'), F.col("`Lançamento`"), F.lit('", then\nleft; ok')))
        .otherwise(F.col("Detalhes")),
        "Data": F.when(n % 97 == 0, F.lit("31/02/2024"))
        .when(n % 7 == 0, F.concat(F.lit("\t"), F.regexp_replace("Data", r"\b0", ""), F.lit("\u00a0"))).otherwise(F.col("Data")),
        "Valor": F.when(n % 83 == 0, F.lit("R$ ?")).otherwise(F.concat("Valor", F.lit("\t"))),
    })
    root = _scratch(spark, "t0_mixed")
    legacy = {"Lançamento": "Histórico", "N° documento": "Número do documento"}
    order = ["Valor", "N° documento", "Lançamento", "Data", "Detalhes"]
    names = inc.RAW_COLUMNS["bb-cc"]
    for i, df in enumerate([raw.select("_n", *names), raw.select("_n", *names).withColumnsRenamed(legacy),
                            raw.select("_n", *order)]):
        df.filter(F.col("_n") % 3 == i).drop("_n").write.option("header", True).option("encoding", "ISO-8859-1") \
            .option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(f"{root}/layout{i}")
    return root


def t0_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of a folder of mixed layouts, bound by header name."""
    raw = csvs.read_raw_statement(spark, _mixed_statements(spark, sf_dir), columns=inc.RAW_COLUMNS["bb-cc"],
                                  aliases=stm.LEGACY_HEADER_ALIASES)
    return stm.standardize(raw, "bb-cc").withColumn("Valor", F.col("Valor").cast("double"))


def t0_mixed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same folder, processed as a stream, leaves out, with the reason."""
    root = _mixed_statements(spark, sf_dir)
    inc.run_incremental(spark, root, f"{root}-t1", f"{root}-ckpt", quarantine_folder=f"{root}-bad")
    bad = spark.read.parquet(f"{root}-bad")
    return bad.select("reason", F.col("`N° documento`").alias("Documento"), "Data", "Valor")


def rec_edit_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of line items, several per record: the last line number wins."""
    li = views.read_table(spark, sf_dir, "lineitem")
    edits = li.select(F.format_string("Rec%04d", F.col("l_orderkey") + 1).alias("RecId"),
                      F.create_map(F.lit("Method"), F.col("l_returnflag"), F.lit("Protocol"),
                                   F.col("l_linenumber").cast("string")).alias("changes"), "l_linenumber")
    out = rec.edit_records(views.budget(spark, sf_dir), edits, as_of=STAMP_AS_OF,
                           data_columns=bdg.BUDGET_DATA_COLUMNS, order_col="l_linenumber")
    return out.select("RecId", "RecTimestamp", "Protocol")


def rec_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of ids that the table doesn't have."""
    c = views.read_table(spark, sf_dir, "customer")
    edits = c.select(F.format_string("Rec%04d", F.col("c_custkey") * 1000 + 1).alias("RecId"))
    return rec.unmatched_edits(views.budget(spark, sf_dir), edits)


def budget_frequency_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template rows whose frequency (here the priority text) is none."""
    tpl = views.budget(spark, sf_dir).withColumn(
        "Freq", F.when(F.col("Status") == "Expected", F.lit("2W")).otherwise(F.col("Status")))
    return bdg.expand_quarantine(tpl.select("RecId", "Freq", "Date_Due"), RECURRENCE_YEAR).select("RecId", "Freq", "reason")


QUERIES.update({
    "t0_mixed_headers": t0_mixed_headers,
    "t0_mixed_quarantine": t0_mixed_quarantine,
    "rec_edit_repeated": rec_edit_repeated,
    "rec_unmatched": rec_unmatched,
    "budget_frequency_quarantine": budget_frequency_quarantine,
})
