"""Key/value records: ``(id, field, value)`` rows to one wide row per id,
restricted to the expected fields; a repeated field keeps its last value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_fields(kv: DataFrame, id_col: str, field_col: str, value_col: str, order_col: str,
                 fields: list[str]) -> DataFrame:
    """One row per id with a column per expected field (NULL when absent).
    The pivot values are given, so there is no discovery pass; ``max_by``
    keeps the value with the largest ``order_col`` (dict semantics: last
    wins) and is partially aggregated before the shuffle."""
    return (kv.filter(F.col(field_col).isin(*fields))
            .groupBy(id_col).pivot(field_col, fields)
            .agg(F.max_by(value_col, order_col)))
