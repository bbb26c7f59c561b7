"""Incremental raw -> canonical statement processing on Structured
Streaming.

The batch tool converts every raw statement (T0) that has no canonical
output (T1) yet.  Here the file source's checkpoint is the record of what
was processed: a run with ``trigger(availableNow=True)`` converts exactly
the files that arrived since the last run, then stops; rerunning with no new
files writes nothing.  The checkpoint lives in the shared checkpoint folder
(``spark.checkpoint.dir``), never on a machine-local disk, so the job
survives executor and driver restarts.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from ..operators.files import base_name, t1_name
from ..operators.statements import DIALECTS, RAW_COLUMNS, quarantine, standardize
from ..sources.csv import read_raw_statement

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the paths of statement files (their content is pruned)."""
    reader = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
              .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select("path")


def run_incremental(spark: SparkSession, t0_folder: str, t1_folder: str, checkpoint: str,
                    dialect: str = "bb-cc", quarantine_folder: str | None = None,
                    max_files_per_trigger: int | None = None) -> int:
    """Convert the raw statements not processed yet; returns the number of
    canonical rows written by this run.

    Each micro-batch hands its file names to the batch reader, which binds
    columns by header (legacy headers, any order).  Rows without a canonical
    form go to ``quarantine_folder`` with a reason.  A batch writes to its own
    ``batch=<id>`` folder, overwriting: a batch that is run again after a
    failure replaces its output.
    """
    d = DIALECTS[dialect]
    written = []

    def convert(batch: DataFrame, batch_id: int) -> None:
        files = sorted(unquote(r["path"]) for r in batch.select("path").distinct().collect())
        if not files:
            return
        raw = read_raw_statement(spark, files, columns=RAW_COLUMNS[dialect], aliases=d.aliases) \
            .withColumnRenamed("file", "t0_file")
        canon = standardize(raw, d, keep=("t0_file",)).withColumn("t1_file", base_name(t1_name("t0_file")))
        out = f"{t1_folder}/batch={batch_id}"
        canon.write.mode("overwrite").parquet(out)
        if quarantine_folder:
            quarantine(raw, d).write.mode("overwrite").parquet(f"{quarantine_folder}/batch={batch_id}")
        written.append(spark.read.schema(canon.schema).parquet(out).count())

    q = (new_files(spark, t0_folder, max_files_per_trigger).writeStream.foreachBatch(convert)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(written)
