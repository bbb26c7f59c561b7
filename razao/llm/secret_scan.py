"""Secret scan with corpus-wide ownership frequency.

Candidates are found per document with regular expressions; their values are
hashed and counted by distinct repositories and owners over the whole corpus.
A value that many owners share is a copied example; one that a single owner
holds looks live.  Besides the three base kinds the scan looks at any long
token of mixed letters and digits and adds it as kind ``owned`` if its value is
owner-specific.

Positions come from the pieces between the matches: ``split`` and
``regexp_extract_all`` walk the same leftmost matches, so running lengths give
start and end in code points.  DataFrame operations only.

Defined results: a null text is an empty one; a null owner or repository is one
of its own; repeated rows are scanned each on its own and count once per owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

# fixed patterns of the base kinds; group 1 or 2 holds the value
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"  # a maximal run, like [0-9a-f]+ with the length asked for
KINDS = ("assign", "access", "hex", "owned")
LEAST_ASSIGN = 6
LEAST_ACCESS = 20

#: further candidates: long tokens with a letter and a digit
TOKEN = r"([A-Za-z0-9+/_-]{20,})"
#: a value that so many owners hold is a copied example
COPIED_OWNERS = 3

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, group: int, kind: int) -> Column:
    """All matches as spans, in order."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("pos"),
                        F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)).cast(_SPAN)).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """``(row_id, doc_id, owner, repo, base, more)``: one scan of the texts, stored.

    ``value`` holds the SHA-256 of the secret; the secret itself is not kept.
    """
    t = F.col("text")
    assign = F.filter(_if(t.rlike(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
                          _matches(t, ASSIGN, 2, 0)), lambda s: F.length(s["value"]) >= LEAST_ASSIGN)
    access = F.filter(_if(t.contains("AKIA"), _matches(t, ACCESS, 1, 1)),
                      lambda s: F.length(s["value"]) >= LEAST_ACCESS)
    hexes = _if(t.rlike("[0-9a-f]{24}"), _matches(t, HEX, 1, 2))
    tokens = F.filter(_if(t.rlike("[A-Za-z0-9+/_-]{20}"), _matches(t, TOKEN, 1, 3)),
                      lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))

    def hashed(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                     s["end"].alias("end"), F.sha2(s["value"], 256).alias("value")))

    rows = (docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                        F.col(owner_col).cast("string").alias("owner"),
                        F.array(*[F.col(c).cast("string") for c in repo_cols]).alias("repo"))
            .select("doc_id", "owner", "repo",
                    F.array_sort(hashed(F.concat(assign, access, hexes))).alias("base"),
                    hashed(tokens).alias("tokens")))
    apart = F.filter("tokens", lambda g: ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))
    # the id is fixed once the table is written
    return stored(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "owner", "repo",
                              "base", apart.alias("more")), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """``(value, n_docs, n_repos, n_owners)`` by three nested counts.

    Every count combines before its shuffle, so a value copied into a third of
    the corpus costs a row per task, repository and owner.
    """
    spans = found.select("owner", "repo", F.explode(F.concat("base", "more")).alias("s")).select(
        F.col("s.value").alias("value"), "owner", "repo")
    return (spans.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
            .groupBy("value").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"),
                                  F.count(F.lit(1)).alias("n_owners")))


def scan(docs: DataFrame, owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"),
         copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``(doc_id, spans)`` of every row; a span has start, kind, end, value
    (SHA-256), n_repos, n_owners and ``live`` (held by few owners)."""
    found = candidates(docs, owner_col, repo_cols)
    owners = ownership(found).withColumnRenamed("value", "v")
    spans = found.select("row_id", F.explode(F.concat("base", "more")).alias("s")).select("row_id", "s.*")
    judged = (spans.join(owners, F.col("value") == F.col("v"))
              .withColumn("live", F.col("n_owners") < copied_owners)
              # a token counts only if one owner alone holds it; base spans stay
              .where((F.col("kind") < 3) | (F.col("n_owners") == 1))
              .groupBy("row_id")
              .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "n_repos", "n_owners", "live")))
                   .alias("spans")))
    return (found.select("row_id", "doc_id").join(judged, "row_id", "left")
            .select("doc_id", F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)).alias("spans")))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns, and how many base spans look live or copied."""
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(condition) -> Column:
        return F.size(F.filter("spans", condition)).cast("long")

    def of_kind(kind: int) -> Column:
        return count(lambda s: s["kind"] == kind)

    return scanned.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        of_kind(3).alias("n_owned"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"))
