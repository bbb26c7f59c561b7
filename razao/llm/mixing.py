"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a target number of words; whole passes over the source plus
one partial pass meet it.  The partial pass takes the documents whose keyed
hash lies under the source's threshold.  The threshold is found without a
sort: words are summed by source and hash digit, the digit in which the budget
runs out is the boundary, and only the boundary is refined by the next digit.
Thresholds of growing budgets are nested: a larger budget keeps every document
of a smaller one.

Defined results: a null text has size 0; a null source is a source of its own,
the last one; a document of size 0 is never taken; repeated rows share a hash
and are taken one by one up to the budget; with no rows there is no result.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

SEED = 11
#: a source's target stops at so many times its size
MOST_PASSES = 3
#: weights of the sources in code-point order, repeating
WEIGHTS = (1, 2, 3)
#: bits of a histogram digit: four digits of 15 bits, the last of which ends the hash
DIGIT = 15
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int) -> Column:
    """60 bits, non-negative, so that digits are plain shifts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 4)


def sized(docs: DataFrame, source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, h)``, stored: words are counted once."""
    return stored(docs.select(F.col("doc_id"), F.col(source_col).cast("string").alias("source"),
                              n_words(F.col("text")).alias("size"), _hash(seed).alias("h")), "mix-sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` by water-filling over one row a source.

    ``target = min(cap, level * weight)`` with the level that spends all words.
    In order of ``cap / weight`` the capped sources come first, so running sums
    give the level each prefix would leave to the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    choices = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = (per.withColumn("weight", F.element_at(choices, F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1))
           .withColumn("cap", F.lit(MOST_PASSES) * F.col("source_size")))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here_on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    per = (per.withColumn("total", F.sum("source_size").over(every))
           .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                       / F.sum("weight").over(here_on))
           .withColumn("place", F.row_number().over(order))
           # the first prefix whose level fits under the next cap is the right one
           .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                                             F.struct("place", "level"))).over(every)["level"]))
    return per.select("source", "source_size",
                      F.least(F.col("cap").cast("double"),
                              F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf"))))
                      .alias("target"))


def _digit(level: int) -> Column:
    """Digit ``level`` (0 is the highest) of the 60-bit hash; the last is the rest."""
    if level == DIGITS:
        return F.col("h").bitwiseAND(F.lit((1 << (60 - DIGIT * DIGITS)) - 1))
    return F.shiftright("h", 60 - DIGIT * (level + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``(source, passes, threshold, left)``: one row a source.

    Documents with ``h < threshold`` get one pass more than ``passes``;
    ``left`` words remain for those with ``h = threshold``.
    """
    budget = F.col("target") - F.col("passes") * F.col("source_size")
    state = (goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                              .otherwise(F.lit(0)).cast("long"))
             .select("source", "passes", budget.alias("left"), F.lit(0).cast("long").alias("threshold")))
    for level in range(DIGITS + 1):
        state = stored(state, "mix-state")  # one row a source: cuts the lineage of the rounds
        bits = DIGIT if level < DIGITS else 60 - DIGIT * DIGITS
        shift = 60 - DIGIT * (level + 1) if level < DIGITS else 0
        inside = sizes.where("size > 0")
        if level:
            known = state.select(F.col("source").alias("s"), F.shiftright("threshold", shift + bits).alias("p"))
            inside = inside.join(known, F.col("source").eqNullSafe(F.col("s"))
                                 & (F.shiftright("h", shift + bits) == F.col("p")))
        cells = (inside.groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("words")))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
        cells = cells.withColumn("upto", running).select(F.col("source").alias("s"), "digit", "words", "upto")
        # the boundary is the first cell that the budget doesn't cover whole
        found = (state.join(cells, F.col("source").eqNullSafe(F.col("s")), "left")
                 .groupBy("source", "passes", "left", "threshold")
                 .agg(F.min(F.when(F.col("upto") > F.col("left"),
                                   F.struct("digit", (F.col("upto") - F.col("words")).alias("spent")))).alias("b"),
                      F.max("digit").alias("top"), F.max("upto").alias("all")))
        # budget covers every cell (rounding only): the boundary lies past the last one
        digit = F.coalesce(F.col("b.digit"), F.col("top") + 1, F.lit(0))
        spent = F.coalesce(F.col("b.spent"), F.col("all"), F.lit(0))
        state = found.select("source", "passes", (F.col("left") - spent).alias("left"),
                             (F.col("threshold") + F.shiftleft(digit, shift)).alias("threshold"))
    return state


def mix(docs: DataFrame, source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, passes, taken)`` of every row.

    ``passes`` is how often the mix takes the whole document, ``taken`` the
    words that makes.  A document at the boundary is taken if that brings the
    source nearer to its target.
    """
    sizes = sized(docs, source_col, seed)
    goals = stored(targets(sizes), "mix-targets")
    edge = stored(thresholds(sizes, goals).withColumnRenamed("source", "s")
                  .join(goals.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g"))).drop("g"),
                  "mix-edge")
    rows = sizes.join(edge, F.col("source").eqNullSafe(F.col("s")))
    # rows that equal the boundary hash are copies of one row: rank them, take whole ones
    tied = F.col("h") == F.col("threshold")
    at_edge = rows.where(tied).withColumn(
        "n", F.row_number().over(Window.partitionBy("s", "h").orderBy("size")))
    fits = F.when((F.col("size") > 0) & ((F.col("n") - 0.5) * F.col("size") <= F.col("left")), 1).otherwise(0)
    extra = F.when((F.col("h") < F.col("threshold")) & (F.col("size") > 0), 1).otherwise(0)
    columns = ["doc_id", "source", "size", "source_size", "target"]
    both = (rows.where(~tied).select(*columns, (F.col("passes") + extra).alias("passes"))
            .unionByName(at_edge.select(*columns, (F.col("passes") + fits).alias("passes"))))
    return both.withColumn("passes", F.when(F.col("size") > 0, F.col("passes")).otherwise(F.lit(0)).cast("long")) \
        .withColumn("taken", F.col("passes") * F.col("size"))


def repeat_documents(docs: DataFrame, source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept.

    Passes are a function of the hash and the source's few numbers, so they
    are found in the row; only copies of the boundary row need a rank.
    """
    names = docs.columns
    sizes = sized(docs, source_col, seed)
    goals = stored(targets(sizes), "mix-targets")
    edge = stored(thresholds(sizes, goals), "mix-edge").select(
        F.col("source").alias("__s"), "passes", "left", "threshold")
    packed = docs.select(F.struct(*names).alias("__row"), F.col(source_col).cast("string").alias("__src"),
                         F.col("text").alias("__text"), _hash(seed).alias("__h"))
    rows = packed.join(edge, F.col("__src").eqNullSafe(F.col("__s"))).where(F.col("__text").rlike(WORD))
    tied = F.col("__h") == F.col("threshold")
    at_edge = rows.where(tied).withColumn("__size", n_words(F.col("__text"))).withColumn(
        "__n", F.row_number().over(Window.partitionBy("__s", "__h").orderBy("__size")))
    fits = F.when((F.col("__n") - 0.5) * F.col("__size") <= F.col("left"), 1).otherwise(0)
    extra = F.when(F.col("__h") < F.col("threshold"), 1).otherwise(0)
    both = (rows.where(~tied).select("__row", (F.col("passes") + extra).alias("__passes"))
            .unionByName(at_edge.select("__row", (F.col("passes") + fits).alias("__passes"))))
    return (both.where("__passes > 0")
            .select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__passes").cast("int"))).alias("__i"))
            .select("__row.*"))
