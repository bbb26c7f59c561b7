"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings (term, document, position) of the corpus for all
terms that the benchmark uses; a mark after the last word of each document
holds its word count.  Postings are stored once; nothing is shuffled to build
them.  A search takes, for every window of 10 consecutive item words, the
window's two rarest terms by corpus frequency and intersects their lists on
the offset-adjusted position (posting position minus position in the item).
What is left are few (document, item, alignment) rows, which are compared word
by word with the text.  DataFrame operations only.

Skew: lists are spread by document, never gathered by term, so a term that is
in every document is split like the documents themselves.

Defined results: a null or empty text has no words and nothing hit; an item
without words has no window; items that share an id count as one; repeated
documents get equal rows; a null item id stands as an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

WINDOW = 10
#: everything but digits, a-z and code points from 0x80 separates words
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the mark behind a document's last word; no word contains it
END = "\x00"
#: terms up to which the vocabulary of the benchmark is broadcast (some 30 MB)
MOST_BROADCAST_TERMS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def _small(df: DataFrame, most: int = MOST_BROADCAST_TERMS) -> DataFrame:
    """Broadcast hint if the stored table is small; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


def items(benchmark: DataFrame) -> DataFrame:
    """``(item_key, item_id, words)`` of the distinct items with words, stored."""
    return stored(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                                   words(F.col("text")).alias("words")).where(F.size("words") > 0)
                  .distinct().withColumn("item_key", F.xxhash64("item_id", "words")), "bench-items")


def vocabulary(item_table: DataFrame) -> DataFrame:
    """``(word, term)``: the terms of the benchmark and the end mark, stored."""
    terms = item_table.select(F.explode("words").alias("word")).distinct()
    end = item_table.sparkSession.createDataFrame([(END,)], "word string")
    return stored(terms.unionByName(end).withColumn("term", F.xxhash64("word")), "bench-terms")


def build_index(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Stored postings ``(term, doc_id, key, pos)`` of the terms in ``vocab``.

    ``key`` tells documents apart that share an id.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"),
                       F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
    return stored(rows.join(_small(vocab), "word").select("term", "doc_id", "key", "pos"), "postings")


def windows(item_table: DataFrame, index: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(item_key, q0, length, rare)`` of every window all of whose terms occur.

    ``rare`` holds the places in the item of the window's two rarest terms.
    """
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = (item_table.select("item_key", F.size("words").alias("size"), F.posexplode("words").alias("q", "word"))
              .join(vocab, "word").join(counts, "term", "left"))
    span = F.least(F.col("size"), F.lit(WINDOW))
    # each word belongs to the windows that start at most span-1 words before it
    first = F.greatest(F.col("q") - span + 1, F.lit(0))
    last = F.least(F.col("q"), F.col("size") - span)
    return (placed.withColumn("length", span).withColumn("q0", F.explode(F.sequence(first, last)))
            .groupBy("item_key", "q0", "length")
            .agg(F.array_sort(F.collect_list(F.struct("n", "q", "term"))).alias("terms"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
            .where("least > 0")
            .select("item_key", "q0", "length",
                    F.transform(F.slice("terms", 1, 2), lambda t: F.struct(t["q"].alias("q"), t["term"].alias("term"), t["n"].alias("n")))
                    .alias("rare")))


def alignments(index: DataFrame, windows_: DataFrame) -> DataFrame:
    """``(doc_id, key, item_key, diagonal)`` where both rare terms of a window meet.

    The diagonal is the position in the document of the item's first word.
    """
    rare = windows_.select("item_key", F.explode("rare").alias("r")).select("item_key", "r.q", "r.term").distinct()
    pairs = windows_.groupBy("item_key").agg(
        F.collect_set(F.transform("rare", lambda r: r["q"])).alias("pairs"))
    lists = index.join(_small(stored(rare, "bench-rare")), "term").select(
        "doc_id", "key", "item_key", (F.col("pos") - F.col("q")).alias("diagonal"), "q")
    met = lists.groupBy("doc_id", "key", "item_key", "diagonal").agg(F.collect_set("q").alias("qs"))
    return (met.join(_small(stored(pairs, "bench-pairs")), "item_key")
            .where(F.exists("pairs", lambda p: F.forall(p, lambda q: F.array_contains("qs", q))))
            .select("doc_id", "key", "item_key", "diagonal"))


def phrase_matches(docs: DataFrame, aligned: DataFrame, item_table: DataFrame) -> DataFrame:
    """``(key, item_id, hits)``: positions covered by windows that occur whole."""
    per_doc = stored(aligned.groupBy("key").agg(F.collect_list(F.struct("item_key", "diagonal")).alias("at")),
                     "alignments")
    texts = (docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").join(per_doc, "key")
             .select("key", words(F.col("text")).alias("w"), "at")
             .select("key", "w", F.explode("at").alias("a"))
             .select("key", "w", "a.item_key", "a.diagonal"))
    n = F.least(F.size("words"), F.lit(WINDOW))
    both = texts.join(item_table, "item_key").withColumn(
        "same", F.transform("words", lambda x, q: F.coalesce(F.get("w", F.col("diagonal") + q) == x, F.lit(False))))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - n),
                      lambda q: F.forall(F.slice("same", q + 1, n), lambda x: x))
    return (both.select("key", "item_id", "diagonal", n.alias("n"), starts.alias("starts")).where(F.size("starts") > 0)
            .select("key", "item_id", F.array_distinct(F.flatten(F.transform(
                "starts", lambda q: F.sequence(F.col("diagonal") + q, F.col("diagonal") + q + F.col("n") - 1))))
                .alias("hits")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, key, n_words, hits, item_ids)`` of every document."""
    docs = docs.select("doc_id", "text")
    item_table = items(benchmark)
    vocab = vocabulary(item_table)
    index = build_index(docs, vocab)
    found = windows(item_table, index, vocab)
    matches = phrase_matches(docs, alignments(index, found), item_table)
    per_doc = matches.groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    ends = index.where(F.col("term") == F.xxhash64(F.lit(END))).select("doc_id", "key", F.col("pos").alias("n_words"))
    return ends.join(per_doc, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 3) -> DataFrame:
    """``(doc_id, item_id, n_near)``: windows whose two rarest terms occur at most
    ``slop`` words nearer together or farther apart than in the item.

    The two lists are joined on document, window and a grid of ``slop + 1``
    words with its neighbours, so that only near postings meet.
    """
    docs = docs.select("doc_id", "text")
    item_table = items(benchmark)
    vocab = vocabulary(item_table)
    index = build_index(docs, vocab)
    found = windows(item_table, index, vocab).where(F.size("rare") == 2)
    one = found.select("item_key", "q0", F.col("rare")[0].alias("r")).select("item_key", "q0", "r.term", "r.q")
    two = found.select("item_key", "q0", F.col("rare")[1].alias("r")).select("item_key", "q0", "r.term", "r.q")

    def placed(terms: DataFrame) -> DataFrame:
        return index.join(_small(stored(terms, "bench-near")), "term").select(
            "doc_id", "key", "item_key", "q0", (F.col("pos") - F.col("q")).alias("d"))

    grid = F.floor(F.col("d") / (slop + 1))
    left = placed(one).withColumn("g", grid)
    right = placed(two).withColumn("g", F.explode(F.array(grid - 1, grid, grid + 1))).withColumnRenamed("d", "e")
    near = (left.join(right.drop("doc_id"), ["key", "item_key", "q0", "g"])
            .where(F.abs(F.col("d") - F.col("e")) <= slop)
            .select("doc_id", "key", "item_key", "q0").distinct())
    return (near.join(item_table.select("item_key", "item_id"), "item_key")
            .groupBy("doc_id", "key", "item_id").agg(F.count_distinct("q0").alias("n_near"))
            .select("doc_id", "item_id", "n_near"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, all columns kept."""
    hit = decontaminate(docs, benchmark).where(F.size("hits") > 0).select(F.col("key").alias("__key")).distinct()
    return (docs.withColumn("__own", F.xxhash64("doc_id", "text"))
            .join(stored(hit, "contaminated"), F.col("__own") == F.col("__key"), "left_anti").drop("__own"))
