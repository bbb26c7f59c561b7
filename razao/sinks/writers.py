"""Writers of the ledger outputs.

Tables go out as ``;`` CSV with header (the file contract of the
reference) or Parquet; per-year outputs are partitioned by ``Ano`` with
dynamic partition overwrite, so a rerun replaces only the years it
computed.  Exports never collect rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import BASE_COLUMNS, active
from .named_files import write_named_files


def write_table_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
                    mode: str = "overwrite") -> str:
    """``;`` CSV with header (UTF-8); quotes inside a cell are doubled.

    A partitioned write is clustered by the partition columns first (AQE splits
    a large partition), so a partition has few files, not one per task.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = (df.write.mode(mode).option("header", True).option("sep", ";").option("encoding", "UTF-8")
         .option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.csv(path)
    return path


def bootfile_suffix(suffix: str) -> str:
    """Metadata file suffix: a leading ``_`` is added only when the suffix
    has none."""
    return suffix if "_" in suffix else f"_{suffix}"


def export_dataset(data: DataFrame, metadata: DataFrame, folder: str, name: str,
                   suffix: str = "bootfile") -> tuple[str, str]:
    """Dataset rows plus a ``field;value`` metadata file next to them."""
    data_path = f"{folder}/{name}"
    meta_path = f"{folder}/{name}{bootfile_suffix(suffix)}"
    write_table_csv(data, data_path)
    write_table_csv(metadata.select(F.col("field").cast("string"), F.col("value").cast("string")), meta_path)
    return data_path, meta_path


def export_records(table: DataFrame, path: str, data_columns: list[str],
                   only_active: bool = False) -> str:
    """Record table export: organised columns only (derived columns such as
    ``Sign`` are not exported), optionally only active rows."""
    t = active(table) if only_active else table
    return write_table_csv(t.select(*BASE_COLUMNS, *data_columns), path)


def export_record_fields(vertical: DataFrame, path: str) -> str:
    """Records in ``Field;Value`` form.  The batch tool writes one small file
    per record; here all requested records go to one ``RecId;Field;Value``
    table (a file per record would be millions of tiny files)."""
    return write_table_csv(vertical.select("RecId", "Field", "Value"), path)


def export_notes(notes: DataFrame, path: str, name_col: str = "name", text_col: str = "text", mode: str = "overwrite") -> str:
    """One markdown file per note, named by ``name_col``."""
    return write_named_files(notes.select(F.col(name_col).alias("name"), F.col(text_col).alias("text")), path, mode)
