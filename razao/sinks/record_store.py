"""A stored record table in hash buckets, changed in place bucket by bucket.

Rows lie as Parquet in ``_buckets=<n>/_bucket=<hash of RecId modulo n>``.  A batch
of edits reads and replaces the buckets of its ids only (the partition filter
is in the scan); all others keep their files.  New records are added as files
of their buckets.  What a batch will write is finished in the shared scratch
folder before anything is replaced, and dynamic partition overwrite replaces the
buckets, so a batch that fails can be applied again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import conform, edit_records, fold_edits, format_id, id_number, last_id
from ..session import written

PARTITIONS = ["_buckets", "_bucket"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("RecId"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int, mode: str) -> None:
    placed = rows.withColumns({"_buckets": F.lit(buckets), "_bucket": _bucket(buckets)})
    (placed.hint("rebalance", "_bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(path))


def create(table: DataFrame, path: str, buckets: int = 64) -> str:
    """Store a conformed record table; ``buckets`` bounds what one edit rewrites and stays as it is."""
    _write(table, path, buckets, "errorifexists")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*PARTITIONS)


def _buckets_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).select("_buckets").first()[0]


def insert(spark: SparkSession, path: str, new_rows: DataFrame, data_columns: list[str], table_name: str,
           order_cols: list[str], as_of: str | None = None) -> None:
    """Add a batch of records; ids go on after the table's highest id."""
    last = read(spark, path).agg(last_id(new_rows)).first()[0]
    keep = [c for c in new_rows.columns if c in data_columns or c in order_cols]
    rows = conform(new_rows.select(*keep), table_name, data_columns, order_cols=order_cols, as_of=as_of)
    _write(rows.withColumn("RecId", format_id(id_number("RecId") + last)), path, _buckets_of(spark, path), "append")


def edit(spark: SparkSession, path: str, edits: DataFrame, as_of: str | None = None, data_columns: list[str] | None = None,
         order_col: str | None = None) -> DataFrame:
    """Apply a batch of edits (see ``records.edit_records``); returns the edits whose id is not in the table."""
    n = _buckets_of(spark, path)
    folded = written(fold_edits(edits, order_col).withColumn("_bucket", _bucket(n)), "edits")
    touched = [r[0] for r in folded.select("_bucket").distinct().collect()]  # n at most
    table = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).drop(*PARTITIONS)
    changes = folded.drop("_bucket")
    unmatched = written(changes.join(table.select("RecId"), "RecId", "left_anti"), "unmatched")
    if touched:
        # the table's own files are not overwritten while they are read
        _write(written(edit_records(table, changes, as_of, data_columns), "edited"), path, n, "overwrite")
    return unmatched
