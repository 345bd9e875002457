from collections import Counter

from conftest import ODD

import corpus_pipeline
from ledgerloom.llm import packing, simhash, substrings


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        steps[name] = now
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    ids = {k: {r["doc_id"] for r in v.collect()} for k, v in steps.items()}
    assert len(ids["language_id"]) >= 0.95 * docs.count()
    groups = {r["component_id"] for r in simhash.near_duplicates(steps["language_id"]).collect()}
    assert ids["simhash_near_dedup"] == groups and steps["simhash_near_dedup"].count() == len(groups)
    assert ids["substring_dedup"] <= ids["simhash_near_dedup"] and len(ids["substring_dedup"]) >= 0.95 * len(groups)
    assert ids["mix_sources"] <= ids["substring_dedup"] and ids["best_fit_packing"] == ids["mix_sources"]
    first = {}
    for r in sorted(steps["substring_dedup"].collect()):  # no fifty words are left twice
        w = r["text"].encode().lower().split()
        for i in range(len(w) - 49):
            assert first.setdefault(tuple(w[i : i + 50]), r["doc_id"]) == r["doc_id"]
    total = steps["best_fit_packing"].groupBy().sum("length").first()[0]
    assert steps["best_fit_packing"].select("sequence_id").distinct().count() <= -(-total // packing.CAPACITY) + 2
    whole = corpus_pipeline.run(spark, sf)
    assert Counter(tuple(r) for r in whole.drop("sequence_id", "offset").collect()) == Counter(tuple(r) for r in steps["best_fit_packing"].drop("sequence_id", "offset").collect())


def test_odd_rows(spark, docs):
    for rows in (ODD, []):
        now = docs(rows)
        for _, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, "").cache()
            if stage is corpus_pipeline.language_id:
                assert {r["text"] for r in now.collect()} <= {r["text"] for r in before.collect()}
            elif stage is corpus_pipeline.simhash_near_dedup:  # whatever is left of its texts, each is there once
                assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter({(r["doc_id"], r["text"]) for r in now.collect()})
            elif stage is corpus_pipeline.best_fit_packing:
                assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in before.collect()}
    assert substrings.remove_repeats(docs(ODD)).count() == len(ODD)


def test_null_and_shared_ids_stay_apart(spark, docs):
    texts = [f"{w} is the first word of a text that says {w} and then some more about {w} and what {w} did {w} last year" for w in ("alpha", "bravo", "delta", "gamma", "omega", "sigma", "kappa")]
    ids = [None, None, None, None, None, 7, 7]
    rows = [*zip(ids, texts, strict=True), (None, texts[0]), (7, texts[5]), (9, texts[6])]
    kept = corpus_pipeline.simhash_near_dedup(spark, docs(rows), "").collect()
    assert sorted(r["text"] for r in kept) == sorted(texts) and Counter(r["doc_id"] for r in kept) == Counter(ids)
    assert substrings.remove_repeats(docs(rows)).count() == len(rows)
