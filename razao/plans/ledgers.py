"""Queries over all accounts, years and table versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts as amt
from ..operators import budget as bdg
from ..operators import cashflow as cfo
from ..operators import catalog as cat
from ..operators import records as rec
from ..operators import report as rpt
from ..operators import statements as stm
from ..operators import tax as taxo
from ..session import scratch_path
from ..sinks import record_store as store
from ..sinks import writers as wr
from ..sources import csv as csvs
from . import registry, views
from .oracle import CF_SQL, MONTHLY_COLS, finish_sql, monthly_sql

# --------------------------------------------------------------------------
# renames: chains, several renames of a name, circles
# --------------------------------------------------------------------------


def _renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase of a user renames its object to a neighbour's name; every fourth user keeps its name."""
    ev = views.read_table(spark, sf_dir, "events").where("event_type = 'purchase' AND user_id % 4 <> 0")
    u = F.col("user_id")
    new = F.when((u % 20 == 7) | (u % 20 == 11), u - 1).otherwise(u + 1 + F.col("event_id") % 2)
    return ev.select(F.concat(F.lit("User_"), u.cast("string")).alias("old_name"),
                     F.concat(F.lit("User_"), new.cast("string")).alias("new_name"), F.col("event_id").alias("seq_no"))


def catalog_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current name of every renamed object; none where its renames go round in a circle."""
    return cat.current_names(_renames(spark, sf_dir), "seq_no")


def catalog_rename_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog under the current names."""
    return cat.refresh(views.catalog_log(spark, sf_dir), _renames(spark, sf_dir), order_col="seq_no")


_RENAMES_SQL = f"""WITH RECURSIVE {views.CAT_SQL.strip()},
r AS (
  SELECT 'User_' || user_id AS old_name, event_id AS seq_no,
         'User_' || CASE WHEN user_id % 20 IN (7, 11) THEN user_id - 1 ELSE user_id + 1 + event_id % 2 END AS new_name
  FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 0),
step AS (SELECT old_name, arg_max(new_name, seq_no) AS nxt FROM r GROUP BY old_name),
walk AS (
  SELECT old_name, nxt AS cur, [old_name] AS path FROM step
  UNION ALL
  SELECT w.old_name, s.nxt, list_append(w.path, w.cur) FROM walk w JOIN step s ON s.old_name = w.cur
  WHERE NOT list_contains(w.path, w.cur)),
ends AS (
  SELECT s.old_name, max(CASE WHEN NOT EXISTS (SELECT 1 FROM step z WHERE z.old_name = w.cur) THEN w.cur END) AS new_name
  FROM step s JOIN walk w ON w.old_name = s.old_name GROUP BY s.old_name)"""


# --------------------------------------------------------------------------
# balances of all accounts and years
# --------------------------------------------------------------------------


def balance_all_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running balances of both accounts; every third year has an opening balance (its net so far, rounded up)."""
    flow = views.cash_flow(spark, sf_dir, with_category=False).withColumn("Conta", F.col("Descricao"))
    net = flow.where("Data is not null").groupBy("Conta", F.year("Data").alias("Year")).agg(F.sum("Valor").alias("net"))
    opening = net.where("Year % 3 = 0").select("Conta", "Year", (F.ceil("net") + F.col("Year")).cast(amt.MONEY).alias("Value"))
    out = rpt.account_balances(flow, opening)
    return out.withColumns({c: F.col(c).cast("double") for c in ("Entradas", "Saidas", "Fluxo", "Saldo")})


_BALANCE_SQL = f"""WITH {CF_SQL.strip()},
m AS (
  SELECT Descricao AS Conta, CAST(year(Data) AS INTEGER) AS Ano, month(Data) AS mm,
         sum(CASE WHEN Valor >= 0 THEN Valor ELSE 0 END) AS Entradas, sum(CASE WHEN Valor < 0 THEN Valor ELSE 0 END) AS Saidas
  FROM cf WHERE Data IS NOT NULL GROUP BY 1, 2, 3),
o AS (
  SELECT Conta, Ano, CAST(ceil(sum(Entradas + Saidas)) + Ano AS DECIMAL(18,2)) AS Value FROM m WHERE Ano % 3 = 0 GROUP BY 1, 2),
cal AS (
  SELECT Conta, CAST(y AS INTEGER) AS Ano, mm FROM (SELECT Conta, unnest(generate_series(min(Ano), max(Ano))) AS y FROM m GROUP BY 1),
         (SELECT unnest(generate_series(1, 12)) AS mm)),
d AS (
  SELECT cal.Conta, cal.Ano, cal.mm, coalesce(Entradas, 0) AS Entradas, coalesce(Saidas, 0) AS Saidas, o.Value AS opened
  FROM cal LEFT JOIN m USING (Conta, Ano, mm) LEFT JOIN o USING (Conta, Ano))
SELECT d.Conta, d.Ano, printf('%04d-%02d', d.Ano, d.mm) AS Mes, CAST(Entradas AS DOUBLE) AS Entradas, CAST(Saidas AS DOUBLE) AS Saidas,
       CAST(Entradas + Saidas AS DOUBLE) AS Fluxo, d.opened IS NOT NULL AS Saldo_Inicial_Found,
       CAST(coalesce((SELECT arg_max(o.Value, o.Ano) FROM o WHERE o.Conta = d.Conta AND o.Ano <= d.Ano), 0)
            + (SELECT sum(e.Entradas + e.Saidas) FROM d e WHERE e.Conta = d.Conta AND (e.Ano, e.mm) <= (d.Ano, d.mm)
               AND e.Ano >= coalesce((SELECT max(o.Ano) FROM o WHERE o.Conta = d.Conta AND o.Ano <= d.Ano), 0)) AS DOUBLE) AS Saldo
FROM d"""


# --------------------------------------------------------------------------
# tax brackets from dated tables
# --------------------------------------------------------------------------

#: two versions of a withholding table: the fixed one, and one with other rates and a gap
TAX_VERSIONS = [("1992-03-01", lo, hi, rate, ded) for lo, hi, rate, ded in taxo.IRRF_2025] + [
    ("1995-07-01", None, "1000.00", "0.0000", "0.00"), ("1995-07-01", "1000.00", "2500.00", "0.1000", "50.00"),
    ("1995-07-01", "3000.00", "4000.50", "0.2000", "99.50")]


def tax_table(spark: SparkSession) -> DataFrame:
    rows = [("IRRF", *map(lambda v: None if v is None else str(v), r)) for r in TAX_VERSIONS]
    text = spark.createDataFrame(rows, "table string, valid_from string, lo string, hi string, rate string, deduction string")
    return text.select("table", F.col("valid_from").cast("date").alias("valid_from"),
                       *[F.col(c).cast(t).alias(c) for c, t in (("lo", taxo.BOUND), ("hi", taxo.BOUND), ("rate", taxo.RATE),
                                                                ("deduction", taxo.BOUND))])


def tax_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket of a fiftieth of every order's price, by the table of the order's day."""
    o = views.read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.floor(F.col("o_totalprice") * 2).cast("long").alias("cents"))
    pay = o.select("o_orderkey", "day", (F.col("cents").cast("decimal(18,0)") / 100).cast(amt.MONEY).alias("amount"))
    out = taxo.lookup(pay, "amount", "day", tax_table(spark), "IRRF")
    tax = F.col("amount") * F.col("rate") - F.col("deduction")
    return out.select("o_orderkey", "bracket", F.col("amount").cast("double").alias("amount"),
                      F.col("rate").cast("double").alias("rate"), tax.cast("double").alias("tax"))


def _tax_sql() -> str:
    rows, before = [], {}
    for v, lo, hi, rate, ded in TAX_VERSIONS:
        q = lambda x: "NULL" if x is None else str(x)
        n, last = before.get(v, (0, None))
        rows.append(f"(DATE '{v}', {n + 1}, {q(lo)}, {q(last)}, {q(hi)}, {rate}, {ded})")
        before[v] = (n + 1, hi)
    return f"""WITH t AS (SELECT v, n, CAST(lo AS DECIMAL(18,2)) AS lo, CAST(below AS DECIMAL(18,2)) AS below, CAST(hi AS DECIMAL(18,2)) AS hi,
         CAST(rate AS DECIMAL(6,4)) AS rate, CAST(ded AS DECIMAL(18,2)) AS ded
  FROM (VALUES {', '.join(rows)}) x(v, n, lo, below, hi, rate, ded)),
p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice * 2) AS BIGINT) / 100.0 AS amount FROM orders),
w AS (SELECT o_orderkey, CAST(amount AS DECIMAL(18,2)) AS amount, (SELECT max(v) FROM t WHERE v <= day) AS v FROM p)
SELECT o_orderkey, t.n AS bracket, CAST(amount AS DOUBLE) AS amount, CAST(t.rate AS DOUBLE) AS rate,
       CAST(amount * t.rate - t.ded AS DOUBLE) AS tax
FROM w LEFT JOIN t ON t.v = w.v AND (t.lo IS NULL OR amount >= t.lo) AND (t.below IS NULL OR amount > t.below)
  AND (t.hi IS NULL OR amount <= t.hi)"""


# --------------------------------------------------------------------------
# recurrence by any offset
# --------------------------------------------------------------------------

OFFSET_YEAR = 2024
OFFSETS = ["D", "7B", "W", "2W-TUE", "MS", "3ME", "BMS", "BME", "SMS", "SME", "QS", "QE-JAN", "BQS-FEB", "2BQE", "YS-MAY", "YE",
           "BYS", "WOM-2TUE", "WOM-5MON", "XX", "0MS"]


def budget_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders repeated on the dates of an offset each; what no offset is stays with its reason."""
    o = views.read_table(spark, sf_dir, "orders")
    freq = F.element_at(F.array(*[F.lit(f) for f in OFFSETS]), (F.col("o_custkey") % len(OFFSETS) + 1).cast("int"))
    tpl = o.select("o_orderkey", freq.alias("Freq"))
    out = bdg.expand_annual(tpl, OFFSET_YEAR).withColumn("reason", F.lit(None).cast("string"))
    bad = bdg.expand_quarantine(tpl, OFFSET_YEAR).withColumn("Date_Due", F.lit(None).cast("date"))
    return out.unionByName(bad)


def _offsets_sql() -> str:
    """Every offset of ``OFFSETS`` as a condition on the day; written out, not derived from the operator."""
    bus = "dow BETWEEN 1 AND 5"
    first_bus = "d = (SELECT min(b.d) FROM cal b WHERE b.dow BETWEEN 1 AND 5 AND b.ym = cal.ym)"
    last_bus = "d = (SELECT max(b.d) FROM cal b WHERE b.dow BETWEEN 1 AND 5 AND b.ym = cal.ym)"
    cond = {
        "D": "TRUE", "7B": bus, "W": "dow = 0", "2W-TUE": "dow = 2", "MS": "dom = 1", "3ME": "d = last", "BMS": first_bus,
        "BME": last_bus, "SMS": "dom IN (1, 15)", "SME": "dom = 15 OR d = last", "QS": "dom = 1 AND m IN (1, 4, 7, 10)",
        "QE-JAN": "d = last AND m IN (1, 4, 7, 10)", "BQS-FEB": f"{first_bus} AND m IN (2, 5, 8, 11)",
        "2BQE": f"{last_bus} AND m IN (3, 6, 9, 12)", "YS-MAY": "dom = 1 AND m = 5", "YE": "d = last AND m = 12",
        "BYS": f"{first_bus} AND m = 1", "WOM-2TUE": "dow = 2 AND dom BETWEEN 8 AND 14"}
    every = {"7B": 7, "2W-TUE": 2, "3ME": 3, "2BQE": 2}
    hits = " UNION ALL ".join(
        f"SELECT '{f}' AS Freq, d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM cal WHERE d <= DATE '{OFFSET_YEAR + 1}-01-01' "
        f"AND ({c})) WHERE i % {every.get(f, 1)} = 0" for f, c in cond.items())
    names = ", ".join(f"'{f}'" for f in OFFSETS)
    # the calendar runs on to the end of the next January, for that month's business days
    return f"""WITH cal AS (
  SELECT CAST(t AS DATE) AS d, day(t) AS dom, month(t) AS m, dayofweek(t) AS dow, last_day(CAST(t AS DATE)) AS last, strftime(t, '%Y%m') AS ym
  FROM (SELECT unnest(generate_series(TIMESTAMP '{OFFSET_YEAR}-01-01', TIMESTAMP '{OFFSET_YEAR + 1}-01-31', INTERVAL 1 DAY)) AS t)),
hit AS ({hits}),
tpl AS (SELECT o_orderkey, [{names}][CAST(o_custkey % {len(OFFSETS)} + 1 AS INTEGER)] AS Freq FROM orders)
SELECT o_orderkey, tpl.Freq, hit.d AS Date_Due, CASE WHEN hit.d IS NULL THEN 'bad_frequency' END AS reason
FROM tpl LEFT JOIN hit ON hit.Freq = tpl.Freq"""


# --------------------------------------------------------------------------
# one category; statements found by account and year
# --------------------------------------------------------------------------

CATEGORY = "4-NOT SPECIFIED"


def cf_one_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfo.monthly_summary(views.cash_flow(spark, sf_dir), category=CATEGORY)


FOUND_YEARS = (1994, 1996)


def statement_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of one account and some years, found in a folder of two accounts and all years."""
    root = scratch_path(spark, f"discovery/{uuid.uuid4().hex}")
    o = views.read_table(spark, sf_dir, "orders")
    raw = o.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("Data"), F.col("o_orderpriority").alias("Lançamento"),
                   F.lit("").alias("Detalhes"), F.col("o_orderkey").cast("string").alias("N° documento"),
                   views.br_text(F.col("o_totalprice")).alias("Valor"), F.year("o_orderdate").alias("year"),
                   F.when(F.col("o_custkey") % 2 == 0, F.lit("CC")).otherwise(F.lit("PP")).alias("account"))
    for r in raw.select("year", "account").distinct().collect():  # a file each: two accounts, a few years
        part = raw.where((F.col("year") == r.year) & (F.col("account") == r.account)).drop("year", "account")
        part.write.option("header", True).option("encoding", "ISO-8859-1").option("quoteAll", True).option("escape", '"') \
            .csv(f"{root}/{r.year}/EXTRATO_BB_{r.account}_{r.year}_T0.csv")
    found = csvs.read_statement_tree(spark, root, "bb-cc", years=list(FOUND_YEARS), columns=stm.RAW_COLUMNS["bb-cc"],
                                     aliases=stm.LEGACY_HEADER_ALIASES)
    t1 = stm.standardize(found, "bb-cc", keep=("Conta", "Ano"))
    return t1.select("Conta", "Ano", "Data", "Documento", F.col("Valor").cast("double").alias("Valor"))


# --------------------------------------------------------------------------
# a stored record table: read, conform, store, insert, edit, read back
# --------------------------------------------------------------------------


def rec_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget from its exported file, stored by bucket, with new records and a batch of edits."""
    root = scratch_path(spark, f"record_store/{uuid.uuid4().hex}")
    wr.export_records(views.budget(spark, sf_dir), f"{root}/csv", bdg.BUDGET_DATA_COLUMNS)
    table = rec.conform(csvs.read_table_csv(spark, f"{root}/csv"), "Budget", bdg.BUDGET_DATA_COLUMNS)
    path = store.create(table, f"{root}/store", 16)
    store.insert(spark, path, registry._customer_entries(spark, sf_dir), bdg.BUDGET_DATA_COLUMNS, "Budget", ["c_custkey"],
                 registry.STAMP_AS_OF)
    store.edit(spark, path, registry._edits(spark, sf_dir), registry.STAMP_AS_OF, bdg.BUDGET_DATA_COLUMNS)
    return store.read(spark, path)


def rec_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that several line items share."""
    li = views.read_table(spark, sf_dir, "lineitem")
    return rec.duplicate_ids(li.select(F.format_string("Rec%04d", F.col("l_orderkey") + 1).alias("RecId")))


def _store_sql() -> str:
    from .oracle import REC_COLUMNS, budget_sql

    stamp = registry.STAMP_AS_OF
    cols = []
    for c in REC_COLUMNS:
        value = f"CASE WHEN t.RecTimestamp = '{stamp}' THEN t.{c} ELSE nullif(t.{c}, '') END"
        if c == "RecTimestamp":
            value = f"CASE WHEN e.id IS NOT NULL THEN '{stamp}' ELSE t.RecTimestamp END"
        elif c in ("Status", "Date_Exe"):
            value = f"CASE WHEN e.id IS NOT NULL THEN {'e.dexe' if c == 'Date_Exe' else chr(39) + 'Executed' + chr(39)} ELSE {value} END"
        cols.append(f"{value} AS {c}")
    return f"""WITH t AS (SELECT * FROM ({budget_sql()['rec_insert']})),
e AS (SELECT printf('Rec%04d', o_orderkey + 1) AS id, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS dexe
      FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT {', '.join(cols)} FROM t LEFT JOIN e ON e.id = t.RecId"""


# --------------------------------------------------------------------------
# exported rows read back; the report in long form
# --------------------------------------------------------------------------


def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an exported dataset, read back with the columns that its metadata file names."""
    root = scratch_path(spark, f"dataset_rows/{uuid.uuid4().hex}")
    data = views.cash_flow(spark, sf_dir)
    names = spark.createDataFrame([("columns", ",".join(data.columns))], "field string, value string")
    data_path, meta_path = wr.export_dataset(data, names, root, "cashflow")
    columns = csvs.read_key_values(spark, meta_path).where("field = 'columns'").first()["value"].split(",")
    back = csvs.read_table_csv(spark, data_path, schema="Data timestamp_ntz, Categoria string, Valor decimal(18,2), Descricao string",
                               columns=columns)
    return back.withColumn("Valor", F.col("Valor").cast("double"))


def report_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year's panel as rows, for any number of categories."""
    return rpt.cashflow_long(views.cash_flow(spark, sf_dir), registry.REPORT_YEAR)


QUERIES = {
    "dataset_rows": dataset_rows,
    "report_long": report_long,
    "rec_store": rec_store,
    "rec_duplicates": rec_duplicates,
    "catalog_renames": catalog_renames,
    "catalog_rename_chains": catalog_rename_chains,
    "balance_all_years": balance_all_years,
    "tax_dated": tax_dated,
    "budget_offsets": budget_offsets,
    "cf_one_category": cf_one_category,
    "statement_discovery": statement_discovery,
}


def all_sql() -> dict[str, str]:
    cf = "WITH " + CF_SQL.strip()
    years = ", ".join(map(str, FOUND_YEARS))
    return {
        "dataset_rows": cf + "\nSELECT Data, Categoria, CAST(Valor AS DOUBLE) AS Valor, Descricao FROM cf",
        "report_long": cf + "\nSELECT strftime(Data, '%Y-%m') AS Mes, CASE WHEN Valor >= 0 THEN 'In' ELSE 'Out' END AS Flow, Categoria, "
                            f"CAST(sum(Valor) AS DOUBLE) AS Valor FROM cf WHERE year(Data) = {registry.REPORT_YEAR} GROUP BY 1, 2, 3",
        "rec_store": _store_sql(),
        "rec_duplicates": "SELECT printf('Rec%04d', l_orderkey + 1) AS RecId, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
        "catalog_renames": _RENAMES_SQL + "\nSELECT old_name, new_name FROM ends",
        "catalog_rename_chains": _RENAMES_SQL + """,
keyed AS (SELECT coalesce(e.new_name, cat.name) AS name, seq, source, description, size, Date FROM cat LEFT JOIN ends e ON e.old_name = cat.name)
SELECT name, seq, source, description, size, Date
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS n FROM keyed) WHERE n = 1""",
        "balance_all_years": _BALANCE_SQL,
        "tax_dated": _tax_sql(),
        "budget_offsets": _offsets_sql(),
        "cf_one_category": monthly_sql(cf, False, CATEGORY, f"Categoria = '{CATEGORY}'") + "\n" + finish_sql("monthly", MONTHLY_COLS),
        "statement_discovery": "SELECT 'BB_CC' AS Conta, CAST(year(o_orderdate) AS INTEGER) AS Ano, CAST(o_orderdate AS DATE) AS Data, "
                               "CAST(o_orderkey AS VARCHAR) AS Documento, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS Valor "
                               f"FROM orders WHERE o_custkey % 2 = 0 AND year(o_orderdate) IN ({years})",
    }
