"""Scans that are repeatable: the same rows in the same order in the same task.

Spark splits the files of a scan in a fixed way, so a second scan of the same
columns under the same settings deals the rows as the first did.  Operators
that number rows in one pass and use the numbers in another rely on it, and
check it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from .tables import stored


def repeatable(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it comes straight from files, else a stored copy."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return stored(docs, "input")
