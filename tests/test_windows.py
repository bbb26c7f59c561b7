"""Chunked scans agree with the plain window functions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from razao.operators.windows import chunked_forward_fill, chunked_rank


def test_chunked_equals_window(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(4):
        positions = rnd.sample(range(0, 500), 120 if g else 1)
        for p in positions:
            rows.append((f"g{g}", p, rnd.choice([None, None, None, "a", "b", "c"])))
    df = spark.createDataFrame(rows, "g string, pos long, v string")
    w = Window.partitionBy("g").orderBy("pos")
    plain = df.withColumns({
        "rn": F.row_number().over(w),
        "ff": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.count(F.lit(1)).over(Window.partitionBy("g")),
    })
    expected = {(r.g, r.pos): (r.rn, r.ff, r.n) for r in plain.collect()}
    for width in (1, 5, 64, 1000):
        ranked = chunked_rank(df, ["g"], "pos", "rn", width, total_col="n")
        filled = chunked_forward_fill(ranked, ["g"], "pos", "v", "ff", width)
        got = {(r.g, r.pos): (r.rn, r.ff, r.n) for r in filled.collect()}
        assert got == expected, width
