"""Object catalog: one row per named object with its metadata.

The catalog is rebuilt from an append log of metadata rows (``name`` plus
an append sequence): the last appended row of a name wins, the result is
sorted by name.  Remove, rename-aware refresh, size, metadata as rows,
aliases, dict-of-dicts tables and head/tail previews are transformations of
that DataFrame; keep-last is an aggregate (partial before the shuffle), so a
name with a third of all appends is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .records import keep_last


def alias_of(name: Column | str) -> Column:
    """Default alias: first + last character of the name (the name itself
    when shorter than 2 characters)."""
    n = F.col(name) if isinstance(name, str) else name
    return F.when(F.length(n) >= 2, F.concat(F.substring(n, 1, 1), F.substring(n, -1, 1))).otherwise(n)


def latest(log: DataFrame, name_col: str = "name", seq_col: str = "seq", ordered: bool = True) -> DataFrame:
    """Keep-last de-duplication by name, sorted by name (``ordered=False``: for
    further joins and aggregates, which would lose the order)."""
    rows = keep_last(log, name_col, seq_col)
    return rows.orderBy(name_col) if ordered else rows


def remove(catalog: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Catalog without the given names (anti join)."""
    return catalog.join(names.select(name_col).distinct(), name_col, "left_anti")


def missing_names(catalog: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Names asked for removal that are not in the catalog (an error in a
    single remove)."""
    return names.select(name_col).distinct().join(catalog.select(name_col), name_col, "left_anti")


def current_names(renames: DataFrame, order_col: str | None = None) -> DataFrame:
    """``old_name, new_name`` of every renamed name, chains followed to their end.

    Of several renames of a name the last by ``order_col`` holds (without it, or
    on a tie, the largest new name).  A name whose chain ends in a circle has
    ``new_name`` NULL.

    Pointer doubling: each round, what is not settled jumps to where its target
    points, so a chain of n renames takes log2(n) rounds.  A round that settles
    nothing leaves circles only.
    """
    order = F.struct(*([order_col] if order_col else []), "new_name")
    step = (renames.where("old_name is not null and new_name is not null").groupBy("old_name")
            .agg(F.max_by("new_name", order).alias("to")).where("old_name <> to"))
    step = written(step, "renames")
    renamed = step.select(F.col("old_name").alias("of"))
    state = written(step.join(renamed, F.col("to") == F.col("of"), "left")
                    .select("old_name", "to", F.col("of").isNull().alias("done")), "rename-steps")
    while True:
        left = state.where("not done")
        target = state.select(F.col("old_name").alias("of"), F.col("to").alias("further"), F.col("done").alias("ends"))
        moved = written(left.join(target, F.col("to") == F.col("of")).select(
            "old_name", F.col("further").alias("to"), F.col("ends").alias("done")), "rename-steps")
        settled = moved.agg(F.count(F.lit(1)), F.count_if("done")).first()
        if settled[1] == 0:  # none left, or circles
            break
        state = written(state.where("done").unionByName(moved), "rename-steps")
    return state.select("old_name", F.when(F.col("done"), F.col("to")).alias("new_name"))


def rename_circles(renames: DataFrame, order_col: str | None = None) -> DataFrame:
    """Names whose renames lead into a circle: they keep their name in ``refresh``."""
    return current_names(renames, order_col).where("new_name is null").select(F.col("old_name").alias("name"))


def refresh(log: DataFrame, renames: DataFrame, name_col: str = "name", seq_col: str = "seq",
            order_col: str | None = None) -> DataFrame:
    """Rebuild the catalog following renames (``old_name -> new_name``, chains
    included, see ``current_names``): entries are re-keyed by their current
    name, then keep-last and sort."""
    r = current_names(renames, order_col).withColumnRenamed("old_name", name_col)
    keyed = log.join(r, name_col, "left").withColumn(
        name_col, F.coalesce(F.col("new_name"), F.col(name_col))).drop("new_name")
    return latest(keyed.select(*log.columns), name_col, seq_col)


def size(catalog: DataFrame) -> DataFrame:
    """Number of catalog rows, as a one-row DataFrame."""
    return catalog.agg(F.count(F.lit(1)).alias("size"))


def metadata_rows(catalog: DataFrame, name_col: str = "name") -> DataFrame:
    """Catalog as ``name, field, value`` rows (every value as text)."""
    fields = [c for c in catalog.columns if c != name_col]
    txt = catalog.select(name_col, *[F.col(f"`{c}`").cast("string").alias(c) for c in fields])
    return txt.unpivot(name_col, fields, "field", "value")


def dict_table(df: DataFrame, key_col: str, map_col: str, order_col: str) -> DataFrame:
    """Dict-of-dicts to a table: one row per outer key; the columns are the
    inner keys of the *first* entry (by ``order_col``); keys missing in an
    entry are NULL.  Only that first entry's key list reaches the driver."""
    first = df.orderBy(order_col).select(F.map_keys(map_col).alias("k")).first()
    keys = list(first["k"]) if first else []
    return df.select(F.col(key_col), *[F.try_element_at(map_col, F.lit(k)).alias(k) for k in keys])


def preview(catalog: DataFrame, order_col: str = "name", n: int = 5) -> DataFrame:
    """First and last ``n`` rows by ``order_col`` (head and tail), tagged."""
    head = catalog.orderBy(F.col(order_col).asc()).limit(n).withColumn("part", F.lit("head"))
    tail = catalog.orderBy(F.col(order_col).desc()).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)
