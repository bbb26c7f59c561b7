"""Record tables: relational tables with a surrogate key (``RecId``) and
audit columns (``RecTable``, ``RecTimestamp``, ``RecStatus``).

All operations are batch transformations of DataFrames: conform incoming
rows, append, insert, keyed edits, soft delete (archive), point lookup and
the vertical (field/value) view of a record.

Scale notes:
* consecutive ids use a range partitioning of the ordering key plus one
  small per-partition count table (one row per partition, broadcast), so no
  single task ever sees all rows (``consecutive_index``);
* keep-first / keep-last de-duplication is an aggregate
  (``min``/``max`` of a struct led by the order key), which is partially
  aggregated before the shuffle, so a key holding a third of the rows is
  reduced map-side instead of sorted inside one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed values of the record-table layout (same as the reference; the stamp
# format without the reference's stray "0" after the month).
BASE_COLUMNS = ["RecId", "RecTable", "RecTimestamp", "RecStatus"]
ID_PREFIX = "Rec"
ID_DIGITS = 4
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def format_id(n: Column) -> Column:
    """``Rec`` + number zero-padded to 4 digits (never truncated)."""
    return F.format_string(f"{ID_PREFIX}%0{ID_DIGITS}d", n.cast("long"))


def id_number(col: Column | str = "RecId") -> Column:
    """Numeric part of a record id (NULL when not of the form ``Rec<digits>``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, rf"^{ID_PREFIX}(\d+)$", 1).try_cast("long")


def last_id(df: DataFrame) -> Column:
    """Highest id number as an aggregate expression (numeric, so Rec10000
    sorts after Rec9999)."""
    return F.coalesce(F.max(id_number("RecId")), F.lit(0).cast("long"))


def next_id(df: DataFrame) -> DataFrame:
    """One row: ``last`` id number and the ``next`` id text."""
    return df.agg(last_id(df).alias("last")).select(
        "last", format_id(F.col("last") + 1).alias("next"))


def consecutive_index(df: DataFrame, order_cols: list[str], start: int | Column = 1,
                      name: str = "_idx", partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start, start+1, ... following ``order_cols``.

    Distributed: rows are range-partitioned on the order key and sorted
    within each partition; ``monotonically_increasing_id`` then encodes
    (partition, position).  That tagged table is checkpointed (reliable
    storage under ``spark.checkpoint.dir``), so the per-partition row counts
    and the rows are read from one materialised partitioning: two separately
    sampled range exchanges may choose different bounds.  The counts (one row
    per partition) give each partition its offset and are broadcast.  The
    order key should be unique for reproducible ids.
    """
    n = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (df.repartitionByRange(int(n), *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    tagged = tagged.withColumns({
        "_pid": F.shiftright("_mid", 33),
        "_pos": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (start_col + F.col("_off") + F.col("_pos")).cast("long")) \
        .drop("_mid", "_pid", "_pos", "_off")


def keep_first(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per ``key``: the one with the smallest ``order_col``."""
    return _keep(df, key, order_col, F.min)


def keep_last(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per ``key``: the one with the largest ``order_col``."""
    return _keep(df, key, order_col, F.max)


def _keep(df: DataFrame, key: str, order_col: str, pick) -> DataFrame:
    others = [c for c in df.columns if c not in (key, order_col)]
    packed = F.struct(F.col(order_col).alias("_o"), *[F.col(f"`{c}`") for c in others])
    return (df.groupBy(key).agg(pick(packed).alias("_r"))
            .select(key, F.col("_r._o").alias(order_col), *[F.col(f"_r.`{c}`").alias(c) for c in others])
            .select(*df.columns))


def stamp(as_of: str | None = None) -> Column:
    """Audit stamp text ``yyyy-MM-dd HH:mm:ss`` (fixed when ``as_of`` given)."""
    ts = F.to_timestamp_ntz(F.lit(as_of)) if as_of else F.localtimestamp()
    return F.date_format(ts, STAMP_FORMAT)


def conform(df: DataFrame, table: str, data_columns: list[str], existing: DataFrame | None = None,
            order_cols: list[str] | None = None, as_of: str | None = None) -> DataFrame:
    """Schema conform incoming rows (``set_data``) and append them.

    * ``RecTable`` = table name;
    * no ``RecId`` column: ids continue after the highest existing id, in
      ``order_cols`` order; with ``RecId``: keep the first row of each id
      (``order_cols`` give "first");
    * ``RecTimestamp`` / ``RecStatus`` default to the stamp and ``On``;
    * missing data columns are ``''``, extra columns dropped, fixed order;
    * appended after ``existing`` (no duplicate-id check, see
      ``duplicate_ids``).
    """
    cols = df.columns
    out = df.withColumn("RecTable", F.lit(table))
    if "RecId" not in cols:
        if not order_cols:
            raise ValueError("order_cols are needed to assign ids")
        start = 1
        if existing is not None:
            # one scalar (the highest existing id) comes back to the driver
            start = existing.agg(last_id(existing).alias("_last")).first()["_last"] + 1
        out = consecutive_index(out, order_cols, start=start, name="_n")
        out = out.withColumn("RecId", format_id(F.col("_n"))).drop("_n")
    else:
        if order_cols:
            out = out.withColumn("_ord", F.struct(*order_cols))
            out = keep_first(out, "RecId", "_ord").drop("_ord")
        else:
            # no order given: the smallest row in column order, the same on every run
            out = out.withColumn("_ord", F.to_json(F.struct(*[c for c in cols if c != "RecId"])))
            out = keep_first(out, "RecId", "_ord").drop("_ord")
    if "RecTimestamp" not in cols:
        out = out.withColumn("RecTimestamp", stamp(as_of))
    if "RecStatus" not in cols:
        out = out.withColumn("RecStatus", F.lit("On"))
    organized = BASE_COLUMNS + list(data_columns)
    out = out.select(*[(F.col(f"`{c}`").cast("string") if c in out.columns else F.lit("")).alias(c)
                       for c in organized])
    if existing is not None:
        # record tables are text after conforming (as when read from CSV)
        out = existing.select(*[(F.col(f"`{c}`").cast("string") if c in existing.columns else F.lit(""))
                                .alias(c) for c in organized]).unionByName(out)
    return out


def insert_records(table: DataFrame, new_rows: DataFrame, data_columns: list[str],
                   table_name: str, order_cols: list[str], as_of: str | None = None) -> DataFrame:
    """Insert a batch of records: only known data columns are kept, ids
    continue after the table's highest id, status ``On``."""
    keep = [c for c in new_rows.columns if c in data_columns or c in order_cols]
    return conform(new_rows.select(*keep), table_name, data_columns, existing=table,
                   order_cols=order_cols, as_of=as_of)


def fold_edits(edits: DataFrame, order_col: str | None = None) -> DataFrame:
    """One ``changes`` map per ``RecId``: of several edits of a column the last
    in ``order_col`` wins (without one, the largest value: a fixed choice).

    The fold is per (id, column), which combines before its shuffle; the map
    of an id then has at most one entry per column.
    """
    order = F.col(order_col) if order_col else F.lit(0)
    each = edits.select("RecId", order.alias("_o"), F.explode_outer("changes").alias("_k", "_v"))
    last = each.groupBy("RecId", "_k").agg(F.max(F.struct("_o", "_v")).alias("_e"))
    entries = F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", F.col("_e._v").alias("_v"))))
    return last.groupBy("RecId").agg(F.map_from_entries(entries).alias("changes"))


def edit_records(table: DataFrame, edits: DataFrame, as_of: str | None = None,
                 data_columns: list[str] | None = None, order_col: str | None = None) -> DataFrame:
    """Apply a batch of keyed edits; several edits of one id are folded first.

    ``edits`` has ``RecId`` and ``changes MAP<STRING,STRING>``: a key present
    in the map overwrites that column (a NULL value writes NULL), absent keys
    leave the column unchanged.  Edited rows get a fresh ``RecTimestamp``.
    With ``data_columns`` only those (plus ``RecStatus``) may be edited.
    """
    allowed = set(data_columns) | {"RecStatus"} if data_columns else None
    e = fold_edits(edits, order_col).withColumnRenamed("changes", "_chg")
    joined = table.join(e, "RecId", "left")
    cols = []
    for c in table.columns:
        if c == "RecId":
            cols.append(F.col("RecId"))
        elif c == "RecTimestamp":
            cols.append(F.when(F.col("_chg").isNotNull(), stamp(as_of))
                        .otherwise(F.col("RecTimestamp")).alias(c))
        elif allowed is not None and c not in allowed:
            cols.append(F.col(f"`{c}`"))
        else:
            has = F.coalesce(F.map_contains_key("_chg", F.lit(c)), F.lit(False))
            cols.append(F.when(has, F.col("_chg")[c]).otherwise(F.col(f"`{c}`").cast("string")).alias(c))
    return joined.select(*cols)


def unmatched_edits(table: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose ``RecId`` is not in the table (an error in a point edit)."""
    return edits.join(table.select("RecId"), "RecId", "left_anti")


def archive_records(table: DataFrame, rec_ids: DataFrame, as_of: str | None = None) -> DataFrame:
    """Soft delete: ``RecStatus = 'Off'`` (and a fresh stamp) for the ids."""
    edits = rec_ids.select("RecId").distinct().select("RecId", F.create_map(F.lit("RecStatus"), F.lit("Off")).alias("changes"))
    return edit_records(table, edits, as_of=as_of)


def active(table: DataFrame) -> DataFrame:
    """Rows with ``RecStatus = 'On'``."""
    return table.filter(F.col("RecStatus") == "On")


def lookup(table: DataFrame, rec_ids: DataFrame) -> DataFrame:
    """Records for a set of ids (semi join)."""
    return table.join(rec_ids.select("RecId").distinct(), "RecId", "left_semi")


def vertical(table: DataFrame, id_col: str = "RecId") -> DataFrame:
    """Record(s) as ``RecId, Field, Value`` rows (fields in column order,
    the id itself included first), every value as text."""
    fields = table.columns
    return table.select(F.col(id_col).alias("_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in fields]) \
        .unpivot("_id", fields, "Field", "Value").withColumnRenamed("_id", id_col)


def duplicate_ids(table: DataFrame) -> DataFrame:
    """Ids present more than once (appends do not check)."""
    return table.groupBy("RecId").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
