"""Cash-flow outputs of all accounts, rewritten only where files changed.

Canonical statements lie as Parquet in ``Conta=<account>/Ano=<year>`` folders.
From them three tables are kept, ``;`` CSV by account and year: ``DIARIO`` (the
rows), ``MENSAL`` and ``ANUAL`` (summaries of the year), and a consolidated
table by account for each (``O_DIARIO``...), in chronological order.

``update`` compares the statement files (path, time, size) with those of the
last run.  Years of an account with a new, changed or removed file are computed
again, and dynamic partition overwrite replaces their partitions only; the
filter on (Conta, Ano) prunes the other years' files before they are read.
Consolidated tables are rewritten for the accounts of those years.  The list of
files is written last: a run that fails is repeated in full by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.cashflow import finish, monthly_summary, priority_order, yearly_summary
from ..session import written
from .writers import write_table_csv

#: order of the rows of each scale's consolidated table
SCALES = {"DIARIO": "Data", "MENSAL": "Mes", "ANUAL": "Ano"}
KEYS = ["Conta", "Ano"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def statement_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modificationTime, length, Conta, Ano`` of the statement files (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    part = lambda key: F.url_decode(F.regexp_extract("path", rf"/{key}=([^/]*)/", 1))
    return files.select("path", "modificationTime", "length", part("Conta").alias("Conta"), part("Ano").cast("int").alias("Ano"))


def changed_years(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(Conta, Ano)`` with a file that is new, changed or gone."""
    facts = F.struct("modificationTime", "length")
    old = before.select(F.col("path").alias("old_path"), facts.alias("old"), F.col("Conta").alias("old_conta"), F.col("Ano").alias("old_ano"))
    both = now.withColumn("new", facts).join(old, F.col("path") == F.col("old_path"), "full")
    return (both.where(~F.col("new").eqNullSafe(F.col("old")))
            .select(F.coalesce("Conta", "old_conta").alias("Conta"), F.coalesce("Ano", "old_ano").alias("Ano")).distinct())


def _last_state(spark: SparkSession, state: str, schema: StructType) -> tuple[DataFrame, int]:
    if not _exists(spark, state):
        return spark.createDataFrame([], schema), 0
    all_ = spark.read.parquet(state)
    run = all_.agg(F.max("run")).first()[0] or 0
    return all_.where(F.col("run") == run).drop("run"), run


def _read_back(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV table this module wrote: columns as written, partition columns from the folders."""
    return (spark.read.schema(schema).option("header", True).option("sep", ";").option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _drop_partitions(spark: SparkSession, root: str, gone: DataFrame, keys: list[str]) -> None:
    """Folders of partitions whose files are all gone (a few short rows)."""
    for r in gone.select(*keys).distinct().toLocalIterator():
        folder = "/".join(f"{k}={r[k]}" for k in keys)
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def update(spark: SparkSession, statements: str, outputs: str, state: str) -> DataFrame:
    """Bring the outputs up to date; returns the ``(Conta, Ano)`` written anew."""
    now = written(statement_files(spark, statements), "statement-files")
    before, run = _last_state(spark, state, now.schema)
    todo = written(changed_years(now, before), "changed-years")
    if not todo.isEmpty():
        daily = _statements(spark, statements)
        daily = priority_order(daily.join(F.broadcast(todo) if _few(todo) else todo, KEYS, "left_semi"))
        write_table_csv(daily, f"{outputs}/DIARIO", KEYS)
        # a year's summary stands by itself, so a year is a key besides the account
        monthly = written(monthly_summary(daily.withColumn("_year", F.col("Ano")), rounded=False, group_by=("Conta", "_year")),
                          "monthly")
        write_table_csv(finish(monthly.drop("_year")), f"{outputs}/MENSAL", KEYS)
        yearly = yearly_summary(monthly, cumulative_across_years=False, group_by=("Conta", "_year")).drop("_year")
        write_table_csv(yearly, f"{outputs}/ANUAL", KEYS)
        gone = todo.join(now, KEYS, "left_anti")
        schemas = {"DIARIO": daily.schema, "MENSAL": finish(monthly.drop("_year")).schema, "ANUAL": yearly.schema}
        empty = todo.select("Conta").distinct().join(now, "Conta", "left_anti")
        for scale, by in SCALES.items():
            _drop_partitions(spark, f"{outputs}/{scale}", gone, KEYS)
            _drop_partitions(spark, f"{outputs}/O_{scale}", empty, ["Conta"])
            _consolidate(spark, outputs, scale, by, schemas[scale], todo)
    now.withColumn("run", F.lit(run + 1)).write.mode("append").partitionBy("run").parquet(state)
    return todo


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical rows; an account is text whatever its folder's name looks like."""
    types = {"Conta": StringType(), "Ano": IntegerType()}
    schema = StructType([StructField(f.name, types.get(f.name, f.dataType)) for f in spark.read.parquet(folder).schema])
    return spark.read.schema(schema).parquet(folder)


def _few(todo: DataFrame, most: int = 10_000) -> bool:
    """Are there few enough changed years to send them to every task (two short values each)?"""
    return todo.limit(most + 1).count() <= most


def _consolidate(spark: SparkSession, outputs: str, scale: str, by: str, schema: StructType, todo: DataFrame) -> None:
    """All years of the changed accounts in one table each, in files of chronological order."""
    back = _read_back(spark, f"{outputs}/{scale}", schema)
    accounts = todo.select("Conta").distinct()
    rows = back.join(accounts, "Conta", "left_semi")
    others = [c for c in rows.columns if c not in ("Conta", by)]
    order = ["Conta", by, *others]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).option("sep", ";")
     .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).partitionBy("Conta").csv(f"{outputs}/O_{scale}"))


def read_output(spark: SparkSession, outputs: str, table: str, schema: str) -> DataFrame:
    """An output table with its account (and year) columns; ``schema`` lists the columns in the file's order."""
    return _read_back(spark, f"{outputs}/{table}", StructType.fromDDL(schema))
