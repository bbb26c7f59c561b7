"""Running scans over ordered groups without one task per group.

``row_number()`` or ``last(x, ignorenulls)`` over ``PARTITION BY g ORDER BY
pos`` puts a whole group in one task; when one group (one statement file)
holds a large share of the rows, that task gets it all.  The chunked forms
below split each group into position chunks of at most ``width`` positions:

1. a bounded window inside each (group, chunk) gives the local value;
2. an aggregate per (group, chunk) summarises the chunk (row count, last
   non-null value), partially aggregated before its shuffle;
3. a running window over the chunk summaries of a group (``width`` times
   fewer rows) gives what each chunk inherits from the chunks before it;
4. the summaries are joined back on (group, chunk).

``pos`` must be an integer position, unique within a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 20


def _chunked(df: DataFrame, pos_col: str, width: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(pos_col) / F.lit(width)).cast("long"))


def chunked_rank(df: DataFrame, group_cols: list[str], pos_col: str, out_col: str,
                 width: int = DEFAULT_WIDTH, total_col: str | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY pos)``; with
    ``total_col`` also ``count(*) OVER (PARTITION BY group)``."""
    local = Window.partitionBy(*group_cols, "_chunk").orderBy(pos_col)
    x = _chunked(df, pos_col, width).withColumn("_local", F.row_number().over(local))
    # chunk sizes come from the windowed rows themselves (same exchange)
    counts = x.groupBy(*group_cols, "_chunk").agg(F.max("_local").alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    cols = [*group_cols, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total_col:
        cols.append(F.sum("_n").over(Window.partitionBy(*group_cols)).alias(total_col))
    offsets = counts.select(*cols)
    return x.join(offsets, [*group_cols, "_chunk"]) \
        .withColumn(out_col, (F.col("_off") + F.col("_local")).cast("long")) \
        .drop("_chunk", "_local", "_off")


def chunked_forward_fill(df: DataFrame, group_cols: list[str], pos_col: str, value_col: str,
                         out_col: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``last(value, ignorenulls) OVER (PARTITION BY group ORDER BY pos ROWS
    BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)``."""
    local = Window.partitionBy(*group_cols, "_chunk").orderBy(pos_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = _chunked(df, pos_col, width).withColumn("_local", F.last(value_col, ignorenulls=True).over(local))
    # what a chunk passes on: the running value at its last row
    last_in_chunk = x.groupBy(*group_cols, "_chunk").agg(F.max_by("_local", pos_col).alias("_last"))
    before = Window.partitionBy(*group_cols).orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = last_in_chunk.select(*group_cols, "_chunk",
                                   F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return x.join(carried, [*group_cols, "_chunk"]) \
        .withColumn(out_col, F.coalesce(F.col("_local"), F.col("_carry"))) \
        .drop("_chunk", "_local", "_carry")
