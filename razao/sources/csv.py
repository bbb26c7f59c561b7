"""CSV sources of the ledger files.

* raw statements (T0): ``,`` separated, quoted, cp1252, every column text,
  empty cells stay ``''``;
* canonical and derived tables: ``;`` separated, UTF-8, header; empty cells
  are NULL;
* typed scans select only the wanted columns (the CSV parser prunes the
  rest) with an explicit schema; nothing is inferred.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ..functions.text import CP1252_GLYPHS, CP1252_UNDEFINED, LATIN1_C1, fix_latin1_c1

# A cell value that never occurs: with it as ``nullValue`` an empty cell
# reads as '' instead of NULL.
_NEVER = "\u0000"


# Line facts: an undefined cp1252 byte, and a cell that goes on in the next line.
_UNDEFINED = "[" + "".join(f"\\x{{{ord(ch):02X}}}" for ch in CP1252_UNDEFINED) + "]"


@dataclass(frozen=True)
class FileGroup:
    """Files that one scan can read: same header, same quoting and charset needs."""

    header: tuple[str, ...]
    multiline: bool
    undefined: bool
    files: tuple[str, ...]


def file_groups(spark: SparkSession, path: str | list[str], sep: str, encoding: str) -> list[FileGroup]:
    """The files of ``path`` by header line.

    One pass over the lines tells each file's header, whether a cell breaks
    over lines (a line with an odd number of quotes) and whether it holds a
    byte that cp1252 leaves undefined.  The driver gets one short row per
    file, as it does for any file listing.  The header is the first line that
    is not blank, as for Spark's own reader; a file that Spark would give
    another header raises.
    """
    text = spark.read.option("recursiveFileLookup", True)
    if encoding == "UTF-8":
        rows = text.text(path).select(F.col("value").alias("v"), "_metadata.file_path", "_metadata.file_block_start",
                                      F.monotonically_increasing_id().alias("n"))
    else:
        # one column with a separator that never occurs: lines in the given charset
        rows = (text.schema("value string").option("sep", _NEVER).option("quote", "").option("encoding", encoding)
                .option("nullValue", "\u0001").csv(path)
                .select(F.col("value").alias("v"), "_metadata.file_path", "_metadata.file_block_start",
                        F.monotonically_increasing_id().alias("n")))
    facts = _file_facts(rows).collect()
    out: dict[tuple, list[str]] = {}
    for r in sorted(facts, key=lambda r: r["file_path"]):
        cells = tuple(next(csv.reader([(r["header"] or "").lstrip("\ufeff").rstrip("\r")], delimiter=sep), []))
        # a scan of cells that break over lines takes a line of blanks for the header
        if r["header"] is not None and (not cells or r["multiline"] and r["first"] != r["header"]):
            raise ValueError(f"no header in the first lines of {r['file_path']}")
        if cells:
            out.setdefault((cells, r["multiline"], r["undefined"]), []).append(unquote(r["file_path"]))
    return [FileGroup(*k, tuple(v)) for k, v in out.items()]


def _file_facts(rows: DataFrame) -> DataFrame:
    """A row per file of lines ``v, file_path, file_block_start, n``: its header and first
    line, whether a cell breaks over lines, and whether it has an undefined byte."""
    odd = (F.length("v") - F.length(F.replace(F.col("v"), F.lit('"'), F.lit("")))) % 2 == 1
    at = F.struct("file_block_start", "n")
    # characters up to the blank are blank for Spark's reader
    some = F.regexp_like("v", F.lit(r"[^\x00-\x20]"))
    # the first aggregate's set of booleans makes Spark hash the lines by file;
    # text in the buffers alone would have it sort a task's lines first
    return rows.groupBy("file_path").agg(
        F.collect_set(odd).alias("odd"),
        F.min_by("v", F.when(some, at)).alias("header"),
        F.min_by("v", F.when(~F.col("v").isin("", "\r"), at)).alias("first"),
        F.coalesce(F.max(F.regexp_like("v", F.lit(_UNDEFINED))), F.lit(False)).alias("undefined")) \
        .withColumn("multiline", F.array_contains("odd", True)).drop("odd")


def _scan(spark: SparkSession, group: FileGroup, sep: str, encoding: str, base: str | None,
          types: dict[str, DataType] | None = None, null_value: str | None = None) -> DataFrame:
    """One scan of a group's files; a cell may hold doubled quotes and, in files
    that need it, line breaks (such a file is one split)."""
    schema = StructType([StructField(c, (types or {}).get(c, StringType())) for c in group.header])
    reader = (spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"')
              .option("escape", '"').option("encoding", encoding).option("multiLine", group.multiline))
    if base:
        reader = reader.option("basePath", base)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.csv(list(group.files))


def _base(path: str | list[str]) -> str | None:
    """The folder below which ``key=value`` folders are columns."""
    return path if isinstance(path, str) and not any(c in path for c in "*?[{") else None


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_raw_statement(spark: SparkSession, path: str | list[str], columns: list[str] | None = None,
                       aliases: dict[str, str] | None = None) -> DataFrame:
    """Raw bank statement CSV files (T0), bound by header name.

    Bytes are read as ISO-8859-1 (never fails) and cp1252 glyphs restored; a
    file with a byte that cp1252 leaves undefined stays Latin-1 as a whole.
    Empty and missing cells are ``''``; ``aliases`` renames legacy headers
    where the current name is absent; with ``columns`` those are returned, in
    that order, whatever the order in the files.  ``file`` holds the source path.
    """
    frames = []
    for group in file_groups(spark, path, ",", "ISO-8859-1"):
        df = _scan(spark, group, ",", "ISO-8859-1", _base(path), null_value=_NEVER)
        fixed = (lambda c: c) if group.undefined else fix_latin1_c1
        cells = {fix_text(c, group.undefined): F.coalesce(fixed(F.col(f"`{c}`")), F.lit("")) for c in group.header}
        for old, new in (aliases or {}).items():
            if old in cells and new not in cells:
                cells[new] = cells.pop(old)
        frames.append(df.select(*[v.alias(k) for k, v in cells.items()], F.col("_metadata.file_path").alias("file")))
    out = _union(frames)
    if out is None:
        names = [*(columns or []), "file"]
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in names]))
    wanted = columns or [c for c in out.columns if c != "file"]
    return out.select(*[(F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in out.columns else F.lit("")).alias(c)
                        for c in wanted], "file")


def read_statement_tree(spark: SparkSession, folder: str, account_type: str, years: list[int] | None = None, tier: str = "T0",
                        columns: list[str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Statements ``<folder>/<year>/EXTRATO_<BANK>_<ACCOUNT>_*_<tier>.csv`` of one account (all years, or
    some), with ``Conta`` and ``Ano`` from the path.

    Account and years are part of the path pattern, so other folders are not
    listed and other files not opened.
    """
    bank, account = account_type.upper().split("-", 1)
    within = "{" + ",".join(f"{y:04d}" for y in sorted(years)) + "}" if years else "[0-9][0-9][0-9][0-9]"
    rows = read_raw_statement(spark, f"{folder}/{within}/EXTRATO_{bank}_{account}_*_{tier}.csv", columns, aliases)
    return rows.withColumns({"Conta": F.lit(f"{bank}_{account}"),
                             "Ano": F.regexp_extract("file", r"/(\d{4})/EXTRATO_[^/]*", 1).cast("int")})


def fix_text(name: str, undefined: bool) -> str:
    """``fix_latin1_c1`` for a header cell."""
    return name if undefined else name.translate(str.maketrans(LATIN1_C1, CP1252_GLYPHS))


def read_table_csv(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None,
                   columns: list[str] | None = None, with_file: bool = False) -> DataFrame:
    """``;`` separated UTF-8 tables with header (canonical, daily, monthly,
    yearly, balances, manifest, record tables), bound by header name: files of
    different column orders and widths make one table, missing columns NULL.

    With ``schema`` the types are applied by the reader and its columns are
    returned; with ``columns`` only those are kept."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {f.name: f.dataType for f in full} if full is not None else {}
    frames = []
    for group in file_groups(spark, path, ";", "UTF-8"):
        df = _scan(spark, group, ";", "UTF-8", _base(path), types)
        if with_file:
            df = df.withColumn("file", F.col("_metadata.file_path"))
        frames.append(df)
    out = _union(frames)
    if out is None:
        out = spark.createDataFrame([], full or StructType([StructField(c, StringType()) for c in columns or ["value"]]))
    if full is not None:
        out = out.select(*[(F.col(f"`{f.name}`") if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in full], *(["file"] if with_file and "file" in out.columns else []))
    return out.select(*columns) if columns else out


def read_typed(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Typed projected scan: the float columns only, rows with any NULL
    dropped."""
    return read_table_csv(spark, path, schema=schema, columns=columns).na.drop("any")


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of ``;`` tables of different widths, matched by column name
    (missing columns NULL); all cells as text.  One scan per distinct header
    and folder, not per file."""
    return _union([read_table_csv(spark, p, with_file=True) for p in paths])


MANIFEST_SCHEMA = "folder string, file string, file_template string"
BALANCES_SCHEMA = "Year int, Value decimal(18,2)"


def read_key_values(spark: SparkSession, path: str, field: str = "field", value: str = "value") -> DataFrame:
    """``field;value`` files (object boot files, single-record files)."""
    return read_table_csv(spark, path, schema=f"`{field}` string, `{value}` string", with_file=True)
