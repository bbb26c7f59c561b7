"""Markdown notes: front matter, Head / Body / Tail sections, tags and
links, blank-line squeeze and rendering back to text.

A corpus is a DataFrame ``doc_id, text`` (one row per note, whole text).
Front matter lines are exploded and re-aggregated per (note, key): keys
keep their last assignment, list items belong to the last key opened with
an empty value.  Sections are array slices of the note's own lines; tags,
links and squeezing are regular expressions.  No Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashtags, squeeze_blank_lines, strip_ws, wiki_links

FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n"
SECTIONS = ["Head", "Body", "Tail"]


def _lines(text: Column) -> Column:
    """Lines as ``readlines`` gives them, without line ends: CR LF -> LF and
    no empty element after a final newline."""
    t = F.regexp_replace(text, "\r\n", "\n")
    return F.split(F.regexp_replace(t, "\n$", ""), "\n")


def front_matter_long(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, value ARRAY<STRING>, is_list, key_pos``: value NULL
    when empty; scalar values are one-element arrays, ``tags`` splits on
    ``-``, outer double quotes of a scalar are removed; ``key_pos`` is the
    line of the key's first appearance (the key order of the note).  Notes
    without front matter have no rows.

    The front matter of a note lives in that note's row: it is parsed with
    array functions inside the row (no shuffle).  Keys keep their last
    assignment; list items belong to the last key opened with an empty
    value."""
    has = F.col(text_col).rlike(FRONT_MATTER)
    fm = notes.filter(has).select(id_col, F.regexp_extract(text_col, FRONT_MATTER, 1).alias("_fm"))

    def parsed(line, i):
        key = strip_ws(F.substring_index(line, ":", 1))
        value = strip_ws(F.substring(line, F.instr(line, ":") + 1, 1 << 30))
        is_key = line.contains(":")
        return F.struct(
            i.alias("i"), (strip_ws(line) == "").alias("blank"), is_key.alias("is_key"),
            F.when(is_key, key).alias("key"), F.when(is_key, value).alias("value"),
            (is_key & (value == "")).alias("opens"),
            (~is_key & strip_ws(line).startswith("-")).alias("is_item"),
            strip_ws(F.substring(strip_ws(line), 2, 1 << 30)).alias("item"))

    # one parsed struct per line, materialised once (generator barrier)
    x = fm.select(id_col, F.explode(F.array(F.transform(F.split("_fm", "\n"), parsed))).alias("_L"))
    x = x.withColumn("_L", F.filter("_L", lambda r: ~r["blank"]))
    opens_at = F.transform(F.filter("_L", lambda r: r["opens"]), lambda r: r["i"])
    # owner of an item: the last list-opening key before it
    items = F.transform(F.filter("_L", lambda r: r["is_item"]), lambda r: F.struct(
        F.array_max(F.filter(opens_at, lambda j: j < r["i"])).alias("owner"), r["i"].alias("i"),
        r["item"].alias("item")))
    x = x.withColumns({"_items": items})
    keys = F.filter("_L", lambda r: r["is_key"])
    # the last assignment of each key, with the key's first position
    finals = F.filter(keys, lambda r: ~F.exists(keys, lambda o: (o["key"] == r["key"]) & (o["i"] > r["i"])))
    entries = F.transform(finals, lambda r: F.struct(
        r["key"].alias("key"), r["i"].alias("i"), r["value"].alias("value"), r["opens"].alias("opens"),
        F.array_min(F.transform(F.filter(keys, lambda o: o["key"] == r["key"]), lambda o: o["i"])).alias("key_pos"),
        F.transform(F.filter("_items", lambda it: it["owner"] == r["i"]), lambda it: it["item"]).alias("listed")))
    e = x.select(id_col, F.explode(entries).alias("e")).select(id_col, "e.*")
    tags = F.filter(F.transform(F.split("value", "-"), lambda v: strip_ws(v)), lambda v: v != "")
    v = F.col("value")
    quoted = (F.length(v) >= 1) & v.startswith('"') & v.endswith('"')
    scalar = F.array(F.when(quoted, F.expr("substr(value, 2, length(value) - 2)")).otherwise(v))
    value_arr = (F.when(F.col("opens"), F.col("listed"))
                 .when(F.col("key") == "tags", tags)
                 .otherwise(scalar))
    is_list = F.col("opens") | (F.col("key") == "tags")
    return e.select(id_col, "key", F.when(F.size(value_arr) > 0, value_arr).alias("value"),
                    is_list.alias("is_list"), "key_pos")


def front_matter(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, metadata MAP<STRING, ARRAY<STRING>>`` (one row per note
    with front matter)."""
    long = front_matter_long(notes, id_col, text_col)
    return long.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def sections(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, Head, Body, Tail`` arrays of stripped lines.

    A leading front matter (first line ``---`` up to the next line that is
    exactly ``---``) is skipped; then lines equal to ``---`` (stripped)
    split the note: none -> all Body; one -> Head | Body; two or more ->
    Head | lines between the first and last | Tail (inner separators stay
    in the Body).  A note whose first line opens a front matter that never
    closes is left out (the reference fails on it).

    The line array is materialised once per note (a one-element generator
    keeps the optimizer from re-deriving it inside the array lambdas).
    """
    x = notes.select(id_col, F.explode(F.array(_lines(F.col(text_col)))).alias("_l"))
    n_all = F.size("_l")
    opens = strip_ws(F.element_at("_l", 1)) == "---"
    close_rel = F.array_position(F.slice("_l", 2, F.greatest(n_all - 1, F.lit(1))), "---")
    close = F.when(~opens, F.lit(0)).when(close_rel > 0, close_rel + 1)
    x = x.withColumn("_close", close).filter(F.col("_close").isNotNull())
    rest = F.slice("_l", F.col("_close") + 1, F.greatest(n_all - F.col("_close"), F.lit(0)))
    x = x.select(id_col, F.explode(F.array(F.transform(rest, lambda v: strip_ws(v)))).alias("_r"))
    n = F.size("_r")
    seps = F.filter(F.transform("_r", lambda v, i: F.when(v == "---", i + 1)), lambda i: i.isNotNull())
    x = x.withColumn("_s", seps)
    first = F.element_at("_s", 1)
    last = F.element_at("_s", -1)
    k = F.size("_s")

    def sl(start, stop_excl):
        return F.slice("_r", start, F.greatest(stop_excl - start, F.lit(0)))

    empty = F.array().cast("array<string>")
    head = F.when(k == 0, empty).otherwise(sl(F.lit(1), first))
    body = (F.when(k == 0, F.col("_r"))
            .when(k == 1, sl(first + 1, n + 1))
            .otherwise(sl(first + 1, last)))
    tail = F.when(k >= 2, sl(last + 1, n + 1)).otherwise(empty)
    return x.select(id_col, head.alias("Head"), body.alias("Body"), tail.alias("Tail"))


def tags(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``#word`` tags of the whole note (NULL when none)."""
    return notes.select(id_col, hashtags(text_col).alias("tags"))


def links(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``[[...]]`` links of the whole note (NULL when none)."""
    return notes.select(id_col, wiki_links(text_col).alias("links"))


def squeeze(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return notes.select(id_col, squeeze_blank_lines(text_col).alias("text"))


def render(meta_long: DataFrame, secs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Note text from metadata (long form, key order by key) and sections:
    ``---``, ``key: value`` or ``key:`` + `` - item`` lines, ``---``, then
    each section's lines followed by a blank line, ``---`` and a blank line;
    the literal text ``None`` is blanked in metadata lines; runs of blank
    lines are squeezed."""
    item_lines = (
        F.when(F.col("value").isNull(), F.array(F.concat(F.col("key"), F.lit(": "))))
        .when(F.col("is_list"), F.concat(F.array(F.concat(F.col("key"), F.lit(":"))),
                                         F.transform("value", lambda v: F.concat(F.lit(" - "), v))))
        .otherwise(F.array(F.concat(F.col("key"), F.lit(": "), F.element_at("value", 1)))))
    m = (meta_long
         .select(id_col, "key_pos", F.transform(item_lines, lambda s: F.replace(s, F.lit("None"), F.lit("")))
                 .alias("_ml"))
         .groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("key_pos", "_ml"))),
                                                    lambda s: s["_ml"])).alias("_meta")))
    sep = F.array(F.lit(""), F.lit("---"), F.lit(""))
    data = F.concat(F.col("Head"), sep, F.col("Body"), sep, F.col("Tail"), sep)
    j = secs.join(m, id_col, "left")
    meta_block = F.concat(F.array(F.lit("---")), F.coalesce("_meta", F.array().cast("array<string>")),
                          F.array(F.lit("---")))
    text = F.concat(F.array_join(F.concat(meta_block, data), "\n"), F.lit("\n"))
    return j.select(id_col, squeeze_blank_lines(text).alias("text"))
