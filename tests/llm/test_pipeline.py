"""The pipeline, stage by stage, against brute force on what the stage got."""

from collections import Counter

import corpus_pipeline as cp
from razao.llm import mixing, quality_classifier as qc
from razao.llm.tables import stored, table

from test_decontaminate import brute as brute_hits
from test_near_dedup import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "mixing", "token_output"]
    given = docs.collect()

    clean = stored(cp.quality(spark, docs, SF), "t1")
    drawn = {r["doc_id"] for r in qc.quality_classifier(docs, table(spark, SF, "labels")).where("kept").collect()}
    assert clean.columns == columns
    assert sorted(map(tuple, clean.collect())) == sorted(tuple(r) for r in given if r["doc_id"] in drawn)
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    assert not bad & drawn

    single = stored(cp.near_duplicates(spark, clean, SF), "t2")
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c in brute_classes(rows)})

    safe = stored(cp.decontamination(spark, single, SF), "t3")
    bench = [(str(r["item_id"]), r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert safe.columns == columns
    assert sorted(r["doc_id"] for r in safe.collect()) == sorted(r[0] for r in brute_hits(rows, bench) if not r[-1])

    mixed = stored(cp.mix_sources(spark, safe, SF), "t4")
    passes = {r["doc_id"]: r["passes"] for r in mixing.mix(safe).collect()}
    assert mixed.columns == columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter(passes)

    out = cp.token_shards(spark, mixed, SF).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    tokens = Counter()
    for r in out:
        tokens[r["doc_id"]] += r["n_tokens"]
    size = {r["doc_id"]: len(r["text"].encode()) + 1 for r in safe.collect()}
    assert tokens == Counter({i: n * size[i] for i, n in passes.items() if n})

    final = cp.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["seq_no"], r["ids_crc32"]) for r in final) == Counter(
        (r["doc_id"], r["seq_no"], r["ids_crc32"]) for r in out)


def test_empty(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
