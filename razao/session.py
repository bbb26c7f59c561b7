"""Spark session helpers.

The library never creates a cluster session on its own: jobs receive the
caller's ``SparkSession``.  ``local_session`` exists for tests, the bench and
the examples; it pins the settings the library relies on (UTC session zone,
ANSI mode, AQE with skew handling) and turns the web UI off.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on; applied by ``local_session`` and checked by
# ``ensure_conf`` for a caller-provided session.  The data are zone-less
# (TIMESTAMP_NTZ), but ``date_format`` and friends pass them through the
# session zone, where a daylight-saving gap (e.g. a Brazilian midnight in
# October) moves 00:00 to 01:00; UTC has no such gaps.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "razao") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the session-level SQL settings the operators assume."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; only set one when none is configured.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is.  Only a local test or bench session without one gets a fresh scratch
    folder under the system temp directory.
    """
    current = checkpoint_dir(spark)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster job needs a shared "
            "checkpoint folder")
    path = tempfile.mkdtemp(prefix="razao-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once
    for several readers, and re-read, not recomputed, when an executor is lost."""
    return written_in_turn([df], name)


def written_in_turn(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """All rows of ``frames`` as a Parquet table, like ``written``.  A frame is
    stored before the next one is asked for, so what it reads may go then."""
    paths = []
    for df in frames:
        paths.append(scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}"))
        df.write.option("compression", "zstd").parquet(paths[-1])
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it ends, not when the driver
    happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
