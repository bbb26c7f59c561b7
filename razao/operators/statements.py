"""Bank-statement dialects: raw (T0, every column text) -> canonical (T1).

A dialect is data, not a class hierarchy: header aliases, rows to drop, the
amount rule and the canonical projection.  ``standardize`` applies one
dialect as a single narrow stage (no shuffle); rows whose date or amount do
not parse go to a quarantine DataFrame with a ``reason`` instead of failing
the job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import MONEY, br_amount, cd_amount
from ..functions.dates import br_date
from ..sources.csv import read_raw_statement
from ..sources.documents import read_lines_cp1252
from .cdb import parse as parse_cdb

# Fixed values of the statement layout (same as the reference).
LEGACY_HEADER_ALIASES = {"Histórico": "Lançamento", "Número do documento": "N° documento"}
BALANCE_ROWS = ["Saldo do dia", "Saldo Anterior", "S A L D O"]
COMPANY_DROP_ENTRIES = ["BB Rende Fácil"]
COMPANY_DROP_AMOUNTS = ["0,00 C"]
CANONICAL = ["Data", "Valor", "Categoria", "Descricao", "Lancamento", "Detalhes", "Documento"]
CANONICAL_SAVINGS = ["Data", "Valor", "Categoria", "Descricao"]


@dataclass(frozen=True)
class Dialect:
    """How one account type's raw statement becomes canonical rows."""

    name: str
    bank: str
    account: str
    amount: Callable[[Column], Column]
    aliases: dict[str, str] = field(default_factory=dict)
    drop_entries: tuple[str, ...] = ()
    drop_amounts: tuple[str, ...] = ()
    category_from: str | None = None      # savings: category = history text
    projection: tuple[str, ...] = tuple(CANONICAL)


# Dialect registry (account type -> parsing rules and labels).
DIALECTS: dict[str, Dialect] = {
    "bb-cc": Dialect("bb-cc", "Banco do Brasil", "Conta Corrente PF", br_amount,
                     aliases=LEGACY_HEADER_ALIASES, drop_entries=tuple(BALANCE_ROWS)),
    # the company account keeps balance rows: its parent drop is discarded
    "bb-ccpj": Dialect("bb-ccpj", "Banco do Brasil", "Conta Corrente PJ", cd_amount,
                       aliases=LEGACY_HEADER_ALIASES, drop_entries=tuple(COMPANY_DROP_ENTRIES),
                       drop_amounts=tuple(COMPANY_DROP_AMOUNTS)),
    "bb-pp": Dialect("bb-pp", "Banco do Brasil", "Conta Poupança PF", cd_amount,
                     category_from="Histórico", projection=tuple(CANONICAL_SAVINGS)),
}

# Columns of each table dialect's raw files, by their current names.
RAW_COLUMNS = {
    "bb-cc": ["Data", "Lançamento", "Detalhes", "N° documento", "Valor"],
    "bb-ccpj": ["Data", "Lançamento", "Detalhes", "N° documento", "Valor"],
    "bb-pp": ["Data", "Histórico", "Valor"],
}


def normalize_columns(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename legacy headers when the current name is absent; the entry
    column must exist afterwards."""
    renames = {old: new for old, new in aliases.items()
               if old in df.columns and new not in df.columns}
    out = df.withColumnsRenamed(renames) if renames else df
    if aliases and "Lançamento" not in out.columns:
        raise KeyError("Expected column 'Lançamento' (or legacy 'Histórico') not found")
    return out


def drop_condition(dialect: Dialect) -> Column:
    """True for rows the dialect drops (null-safe: NULL text is kept)."""
    cond = F.lit(False)
    if dialect.drop_entries:
        cond = cond | F.coalesce(F.col("`Lançamento`").isin(*dialect.drop_entries), F.lit(False))
    if dialect.drop_amounts:
        cond = cond | F.coalesce(F.col("Valor").isin(*dialect.drop_amounts), F.lit(False))
    return cond


def _parsed(df: DataFrame, dialect: Dialect) -> DataFrame:
    df = normalize_columns(df, dialect.aliases) if dialect.aliases else df
    return df.withColumns({
        "_drop": drop_condition(dialect),
        "_date": br_date("Data"),
        "_amount": dialect.amount(F.col("Valor")),
    })


def _reason() -> Column:
    return (F.when(F.col("_drop"), F.lit("dropped"))
            .when(F.col("_date").isNull(), F.lit("bad_date"))
            .when(F.col("_amount").isNull(), F.lit("bad_amount")))


def _check_lines(df: DataFrame) -> None:
    if not {"file", "pos", "line"} <= set(df.columns):
        raise ValueError("bb-cdb statements are print-style text: read_statements gives their lines, cdb.statement_files their sections")


def standardize(df: DataFrame, dialect: Dialect | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical rows of a raw statement (good rows only); ``keep`` columns
    (e.g. the source file) are carried after the canonical ones.

    A ``bb-cdb`` statement is a line table (``file, pos, line``); its movements
    (the EXTRATO section) are canonical rows as those of a savings account, and
    ``account`` and ``file`` can be kept."""
    if dialect == "bb-cdb":
        _check_lines(df)
        rows = parse_cdb(df)["EXTRATO"].withColumn("Valor", F.col("Valor").cast(MONEY))
        return rows.select(*CANONICAL_SAVINGS, *keep)
    d = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    p = _parsed(df, d).filter(_reason().isNull())
    if d.category_from:
        cat = F.coalesce(F.col(f"`{d.category_from}`"), F.lit(""))
    else:
        cat = F.lit("")
    cols = {
        "Data": F.col("_date"),
        "Valor": F.col("_amount"),
        "Categoria": cat,
        "Descricao": F.lit(""),
        "Lancamento": F.col("`Lançamento`") if "Lançamento" in p.columns else F.lit(""),
        "Detalhes": F.coalesce(F.col("Detalhes"), F.lit("")) if "Detalhes" in p.columns else F.lit(""),
        "Documento": F.col("`N° documento`") if "N° documento" in p.columns else F.lit(""),
    }
    return p.select(*[cols[c].alias(c) for c in d.projection], *[F.col(f"`{k}`") for k in keep])


def quarantine(df: DataFrame, dialect: Dialect | str) -> DataFrame:
    """Rows that ``standardize`` leaves out, with ``reason`` (dropped by the
    dialect, bad_date, bad_amount) and the raw columns; of a ``bb-cdb`` statement
    the lines of its EXTRATO that make no record."""
    if dialect == "bb-cdb":
        _check_lines(df)
        return (parse_cdb(df)["quarantine"].where("section = 'EXTRATO'")
                .select(F.lit("bad_record").alias("reason"), "file", "account", "pos"))
    d = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    p = _parsed(df, d)
    raw = [c for c in p.columns if not c.startswith("_")]
    return p.withColumn("reason", _reason()).filter(F.col("reason").isNotNull()) \
        .select("reason", *[F.col(f"`{c}`") for c in raw])


def drop_report(df: DataFrame, dialect: Dialect | str) -> DataFrame:
    """Count of left-out rows per reason and entry text."""
    q = quarantine(df, dialect)
    entry = F.col("`Lançamento`") if "Lançamento" in q.columns else F.lit(None).cast("string")
    return q.groupBy("reason", entry.alias("Lancamento")).agg(F.count(F.lit(1)).alias("n"))


def read_statements(spark: SparkSession, path: str | list[str], account_type: str) -> DataFrame:
    """Raw statement files of any account type, ready for ``standardize`` and
    ``quarantine`` of that type."""
    if account_type == "bb-cdb":
        return read_lines_cp1252(spark, path)
    return read_raw_statement(spark, path, columns=list(RAW_COLUMNS[account_type]), aliases=DIALECTS[account_type].aliases)


def registry_table(spark) -> DataFrame:
    """The dialect registry as a small dimension table."""
    rows = [(d.name, d.bank, d.account) for d in DIALECTS.values()]
    # not a table dialect: print-style text, read line by line
    rows.append(("bb-cdb", "Banco do Brasil", "Aplicação CDB"))
    return spark.createDataFrame(rows, "account_type string, bank string, account string")
