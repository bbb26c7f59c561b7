"""Quality rules and quality classifier."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from razao.llm import labelled, ngrams, quality_classifier as qc, quality_rules as qr
from razao.llm.textbatch import mix, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed)


def key(r):
    return tuple((x is None, x) for x in r)


def test_base_rules(rows, docs, labels):
    got = qr.quality_rules(docs, labels).collect()
    have = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                    r["base_failed"]) for r in got), key=key)
    assert have == sorted(((i, *brute_base(t)) for i, t, _, _ in rows), key=key)
    assert not any(r["kept"] for r in got if r["base_failed"])


def tokens(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[!-/:-@\[-`{-~\x7f]+", text or "")


def test_model_counts_cover_the_corpus(rows, docs, labels):
    """The histogram holds every unigram and bigram of every document."""
    marked = docs.selectExpr("text", "doc_id < 20 AS trusted")
    got = ngrams.histogram(marked, 997).collect()
    n = sum(max(2 * len(tokens(t)) - 1, 0) for _, t, _, _ in rows)
    n_target = sum(max(2 * len(tokens(t)) - 1, 0) for i, t, _, _ in rows if i is not None and i < 20)
    assert sum(r["raw"] for r in got) == n and sum(r["target"] for r in got) == n_target


def test_scores_are_sums_of_log_ratios(rows):
    """Same grams, same sum: a text scores as the features of its parts."""
    ratio = np.log(np.arange(1, 1001, dtype=float))
    texts = [t for _, t, _, _ in rows]
    total, n = ngrams.scores(pa.array(texts, pa.string()), ratio)
    assert list(n) == [max(2 * len(tokens(t)) - 1, 0) for t in texts]
    for i, t in enumerate(texts):
        one, k = ngrams.scores(pa.array([t], pa.string()), ratio)
        assert np.isclose(one[0], total[i]) and k[0] == n[i]


def test_heldout_separation(spark):
    """Junk goes and clean documents stay on the given labels."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    kept = {r["doc_id"]: r["kept"] for r in qc.quality_classifier(docs, labels).collect()}
    rules = {r["doc_id"]: r for r in qr.quality_rules(docs, labels).collect()}
    good = [r["doc_id"] for r in labels.where("quality = 1 AND toxic = 0").collect()]
    bad = [r["doc_id"] for r in labels.where("quality = 0").collect()]
    assert np.mean([kept[i] for i in good]) > 0.99 and np.mean([kept[i] for i in bad]) < 0.02
    passed = [i for i in good if not rules[i]["base_failed"]]
    assert np.mean([rules[i]["kept"] for i in passed]) > 0.99
    assert np.mean([rules[i]["kept"] for i in bad]) < 0.02


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=3000), [1.5] * 50, rng.normal(size=20) * 1e9])
    df = spark.createDataFrame([(float(v),) for v in values], "gumbel_key double")
    ordered = np.sort(values)[::-1]
    for k in (1, 2, 17, 900, 3069):
        assert qc.kth_largest(df, k) == ordered[k - 1]
    assert qc.kth_largest(df, 0) == np.inf and qc.kth_largest(df, 5000) == -np.inf
    assert qc.kth_largest(df.limit(0), 3) == np.inf


def test_gumbel_top_k_samples_by_weight(spark, docs, labels):
    """k documents are drawn, the same ones again, by the weights' odds."""
    scored = qc.quality_classifier(docs, labels, k=10).collect()
    assert sum(r["kept"] for r in scored) >= 10
    tenth = sorted((r["gumbel_key"] for r in scored), reverse=True)[9]
    assert all(r["kept"] == (r["gumbel_key"] >= tenth) for r in scored)
    again = qc.quality_classifier(docs.repartition(3), labels, k=10).collect()
    order = lambda rows: sorted((tuple(r) for r in rows), key=key)
    assert order(again) == order(scored)
    # empirical check of the noise: P(key_a > key_b) = w_a / (w_a + w_b)
    ids = pa.array(range(40000))
    _, noise = qc._keys(ids, pa.array([""] * 40000), np.zeros(10), 3)
    a, b = noise[::2] + np.log(3.0), noise[1::2]
    assert abs((a > b).mean() - 0.75) < 0.01


def test_without_labels_or_rows(spark, docs, no_docs, labels):
    none = labels.limit(0)
    assert all(r["kept"] for r in qc.quality_classifier(docs, none).collect())
    assert qc.quality_classifier(no_docs, labels).count() == 0
    assert qr.quality_rules(no_docs, labels).count() == 0
    rules = qr.quality_rules(docs, none).collect()
    assert all(r["kept"] != r["base_failed"] for r in rules)


def test_keep_documents(docs, labels):
    kept = qc.keep_documents(docs, labels)
    assert kept.columns == docs.columns
    want = [r["doc_id"] for r in qc.quality_classifier(docs, labels).where("kept").collect()]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in kept.collect())


def test_cut_covers_all_held_out_labels(spark):
    """A small fit sample and rare bad labels: the cut still sees all of them."""
    good = [(i, " ".join(f"word{(i * k) % 17}" for k in range(60))) for i in range(1, 400)]
    bad = [(i, "%% $$ && ## zz " * 20) for i in range(400, 405)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    ratio, cut = labelled.model(docs, labels, most=8)
    held = {r["doc_id"]: r["role"] for r in labelled.roles(labels).collect()}
    total, n = ngrams.scores(pa.array([t for _, t in good + bad]), ratio)
    kept = dict(zip([i for i, _ in good + bad], total / n >= cut, strict=True))
    assert np.isfinite(cut) and not any(kept[i] for i, _ in bad)
    assert np.mean([kept[i] for i, r in held.items() if r == "good"]) > 0.9


def test_toxic_words_in_good_text(spark):
    """Held-out documents with toxic = 1 and quality 1 go, clean ones stay, whatever their length."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    clean = [(i, " ".join(rng.choice(words, rng.integers(60, 400)))) for i in range(400)]
    toxic = [(400 + i, " ".join(rng.choice(words, 300)) + " grubby " + " ".join(rng.choice(words, 80))) for i in range(80)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 400)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int")
    held = {r["doc_id"]: r["role"] for r in labelled.roles(labels).collect()}
    for got in (qc.quality_classifier(docs, labels).collect(), qr.quality_rules(docs, labels).collect()):
        kept = {r["doc_id"]: r["kept"] for r in got}
        assert not any(kept[i] for i, r in held.items() if r == "toxic")
        assert np.mean([kept[i] for i, r in held.items() if r == "good"]) > 0.95
    stay = {r["doc_id"] for r in qc.keep_documents(docs, labels).collect()}
    assert not any(i in stay for i, r in held.items() if r == "toxic")


def test_label_sample_is_bounded(spark):
    many = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    assert labelled.sample(many, 100).count() == 100
    assert mix(np.arange(3, dtype=np.uint64)).dtype == np.uint64


def test_texts_of_a_batch_come_in_small_runs():
    """A worker's hash tables grow with the longest run and are kept: no batch makes one run of several MB."""
    texts = [None, "ü" * 50_000, ""] + ["ab " * 30_000] * 40 + ["x" * 3_000_000, "end"]
    runs = list(slices(pa.array(texts)))
    assert [r.first for r in runs] == np.cumsum([0] + [r.n for r in runs])[:-1].tolist()
    got = [bytes(r.data[a:b]).decode() for r in runs for a, b in zip(r.offsets[:-1], r.offsets[1:])]
    assert got == [t or "" for t in texts]
    assert all(len(r.data) <= 1 << 20 or r.n == 1 for r in runs)
