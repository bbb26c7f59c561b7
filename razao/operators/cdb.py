"""CDB investment statements: print-style text -> four typed tables.

Input is a line table ``file, pos, line`` (one row per text line, ``pos``
orders the lines of a file).  The layout rules:

* the statement year is the start date of the ``Período: dd/mm/yyyy`` line;
* lines with ``--`` or ``==`` and blank lines are noise; no-break spaces
  become spaces;
* a line belongs to the last account header seen (``BB CDB DI``,
  ``BB CDB PROGRESSIVO``), and inside an account to the last section title
  seen (EXTRATO before the first title);
* the second line of a section is its column header and is replaced by the
  fixed names; SALDOS / DEPOSITOS / RENDIMENTOS drop their title line;
* EXTRATO drops ``Saldo anterior`` / ``capital`` / ``Saldo final`` lines, and
  when more than 3 lines remain, body lines 2k and 2k+1 form one record,
  joined without separator, with ``-`` and ``valor juros`` removed and
  ``Rendimento  mensal`` renamed ``Juros`` (an unpaired last line, and the one
  body line of a section of 3 lines, is quarantined);
* fields are whitespace-separated, dates ``dd/mm`` take the statement year.

Labels and section ranks are chunked scans (``operators.windows``), so a very
long statement is not processed by one task.  Pairing is an aggregate over (file, account, pair
index) with two rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import br_number
from ..functions.dates import br_date, day_month_in_year
from ..functions.text import clean_line, fields, is_blank
from ..session import ensure_checkpoint_dir
from ..sources.documents import read_lines_cp1252
from .windows import DEFAULT_WIDTH, chunked_forward_fill, chunked_rank

# Fixed values of the statement layout (same as the reference).
ACCOUNTS = {"BB CDB DI": "CDBDI", "BB CDB PROGRESSIVO": "CDBPG"}
SECTION_TITLES = {
    "SALDO NOS ULTIMOS 6 MESES": "SALDOS",
    "RESUMO DOS DEPOSITOS EM SER": "DEPOSITOS",
    "RENDIMENTO BRUTO NO PERIODO POR DEPOSITO": "RENDIMENTOS",
}
NOISE = ["--", "=="]
EXTRATO_SKIP = ["Saldo anterior", "capital", "Saldo final"]
HEADERS = {
    "EXTRATO": ["Data", "Historico", "Deposito", "Valor"],
    "SALDOS": ["Data", "Capital_Inicial", "Juros", "IR_Projetado", "Capital_Projetado"],
    "DEPOSITOS": ["Deposito", "Data_Aplicacao", "Capital", "Saldo", "Taxa", "Data_Vencimento"],
    "RENDIMENTOS": ["Data", "Deposito", "Rendimento_Bruto"],
}


def _first_match(line: Column, mapping: dict[str, str]) -> Column:
    # the longer marker first: "BB CDB PROGRESSIVO" before "BB CDB DI"
    out = None
    for marker in sorted(mapping, key=len, reverse=True):
        cond = line.contains(marker)
        out = F.when(cond, F.lit(mapping[marker])) if out is None else out.when(cond, F.lit(mapping[marker]))
    return out


def labelled_lines(lines: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Clean lines labelled with ``year``, ``account``, ``section``, ``rn``
    (rank inside the section, EXTRATO skip lines removed) and ``n_lines``.

    Account headers and section titles are filled forward over the line
    positions, and lines are ranked inside their section, by chunked scans
    (``operators.windows``): work is linear in the lines, nothing is gathered
    per file, and a very long statement is never one task.
    """
    year = F.nullif(F.regexp_extract("line", r"Período:\s*\d{1,2}/\d{1,2}/(\d{4})", 1), F.lit(""))
    x = lines.select("file", "pos", clean_line("line").alias("line"))
    noise = F.lit(False)
    for n in NOISE:
        noise = noise | F.col("line").contains(n)
    # the period line may itself be noise; it is looked up before filtering
    years = (x.select("file", "pos", year.alias("_y")).filter(F.col("_y").isNotNull())
             .groupBy("file").agg(F.min_by("_y", "pos").cast("int").alias("year")))
    acc = _first_match(F.col("line"), ACCOUNTS)
    sec = _first_match(F.col("line"), SECTION_TITLES)
    x = x.filter(~noise & ~is_blank("line")).withColumns({
        "_acc": acc, "_sec": F.when(acc.isNotNull(), F.lit("EXTRATO")).otherwise(sec)})
    # an account header opens its EXTRATO, a title the section after it
    x = chunked_forward_fill(x, ["file"], "pos", "_acc", "account", width)
    x = chunked_forward_fill(x.filter(F.col("account").isNotNull()), ["file"], "pos", "_sec", "section", width)
    x = x.join(years, "file", "left").drop("_acc", "_sec")
    skip = F.lit(False)
    for s in EXTRATO_SKIP:
        skip = skip | F.col("line").contains(s)
    x = x.filter(~((F.col("section") == "EXTRATO") & skip))
    # four sections read the labelled lines: cut the lineage once
    ensure_checkpoint_dir(x.sparkSession)
    x = x.checkpoint(eager=True)
    return chunked_rank(x, ["file", "account", "section"], "pos", "rn", width, total_col="n_lines")


def _records(df: DataFrame, section: str) -> DataFrame:
    """Body rows of a non-EXTRATO section: fields by position."""
    body = df.filter((F.col("section") == section) & (F.col("rn") >= 3))
    f = fields("line")
    return body.select("file", "account", "year", "pos", f.alias("_f"))


def _positional(df: DataFrame, names: list[str]) -> DataFrame:
    cols = [F.try_element_at("_f", F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return df.select("file", "account", "year", "pos", F.size("_f").alias("_n"), *cols)


def extrato_records(lab: DataFrame) -> DataFrame:
    """EXTRATO records from paired body lines (sections with more than 3
    lines); ``_f`` holds the fields, ``_unpaired`` marks a last odd line."""
    ext = lab.filter((F.col("section") == "EXTRATO") & (F.col("n_lines") > 3) & (F.col("rn") >= 3))
    ext = ext.withColumn("_k", F.floor((F.col("rn") - 3) / 2))
    pairs = ext.groupBy("file", "account", "year", "_k").agg(
        F.min("pos").alias("pos"),
        F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("_parts"),
    )
    joined = F.array_join(F.transform("_parts", lambda p: p["line"]), "")
    merged = F.replace(F.replace(F.replace(joined, F.lit("-"), F.lit("")), F.lit("valor juros"), F.lit("")),
                       F.lit("Rendimento  mensal"), F.lit("Juros"))
    return pairs.select("file", "account", "year", "pos", fields(merged).alias("_f"),
                        (F.size("_parts") < 2).alias("_unpaired"))


def parse(lines: DataFrame, width: int = DEFAULT_WIDTH) -> dict[str, DataFrame]:
    """The four sections as typed tables (plus ``quarantine``)."""
    lab = labelled_lines(lines, width)
    ext = extrato_records(lab)
    e = _positional(ext.filter(~F.col("_unpaired")), HEADERS["EXTRATO"])
    extrato = e.select(
        "file", "account", "pos",
        day_month_in_year("Data", F.col("year")).alias("Data"),
        br_number("Valor").alias("Valor"),
        F.col("Historico").alias("Categoria"),
        F.lit("").alias("Descricao"),
        (F.col("_n") == 4).alias("_ok"),
    )
    s = _positional(_records(lab, "SALDOS"), HEADERS["SALDOS"])
    saldos = s.select("file", "account", "pos", br_date("Data").alias("Data"),
                      *[br_number(c).alias(c) for c in HEADERS["SALDOS"][1:]],
                      (F.col("_n") == 5).alias("_ok"))
    d = _positional(_records(lab, "DEPOSITOS"), HEADERS["DEPOSITOS"])
    depositos = d.select("file", "account", "pos", "Deposito",
                         br_date("Data_Aplicacao").alias("Data_Aplicacao"),
                         br_number("Capital").alias("Capital"), br_number("Saldo").alias("Saldo"),
                         br_number("Taxa").alias("Taxa"),
                         br_date("Data_Vencimento").alias("Data_Vencimento"),
                         (F.col("_n") == 6).alias("_ok"))
    r = _positional(_records(lab, "RENDIMENTOS"), HEADERS["RENDIMENTOS"])
    rend = r.select("file", "account", "pos", day_month_in_year("Data", F.col("year")).alias("Data"),
                    "Deposito", br_number("Rendimento_Bruto").alias("Rendimento_Bruto"),
                    (F.col("_n") == 3).alias("_ok"))
    out = {}
    bad = []
    for name, df in (("EXTRATO", extrato), ("SALDOS", saldos), ("DEPOSITOS", depositos),
                     ("RENDIMENTOS", rend)):
        value_cols = [c for c in df.columns if c not in ("file", "account", "pos", "_ok")]
        parsed_ok = F.col("_ok")
        for c in value_cols:
            parsed_ok = parsed_ok & F.col(c).isNotNull()
        out[name] = df.filter(parsed_ok).drop("_ok")
        bad.append(df.filter(~parsed_ok).select("file", "account", "pos", F.lit(name).alias("section")))
    unpaired = ext.filter(F.col("_unpaired")).select("file", "account", "pos",
                                                     F.lit("EXTRATO").alias("section"))
    # a section of 3 lines has one body line, which makes no record
    alone = lab.filter((F.col("section") == "EXTRATO") & (F.col("n_lines") == 3) & (F.col("rn") == 3)) \
        .select("file", "account", "pos", "section")
    q = unpaired.unionByName(alone)
    for b in bad:
        q = q.unionByName(b)
    out["quarantine"] = q
    return out


def statement_lines(texts: DataFrame, text_col: str = "text", file_col: str = "file_data") -> DataFrame:
    """Whole statement texts -> line table ``file, pos, line``."""
    return texts.select(F.col(file_col).alias("file"),
                        F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))


def statement_files(spark: SparkSession, path: str | list[str], width: int = DEFAULT_WIDTH) -> dict[str, DataFrame]:
    """cp1252 statement files on disk -> the four sections and quarantine.

    Files are read line by line in splits, so a statement of any size is read
    by many tasks.
    """
    return parse(read_lines_cp1252(spark, path), width)
