import random

import corpus_pipeline as pipeline
from gridx.llm import minhash_dedup, quality_rules, suffix_dedup


def table(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    base = [" ".join(word() for _ in range(r.randint(25, 80))) for _ in range(30)]
    shared = " ".join(word() for _ in range(15))
    rows = [(i, t if i % 4 else f"{t} {shared}", "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3], "en", "s0", 1), (101, base[5] + " x", None, None, 1), (102, None, "en", "s1", 0), (103, "", "en", "s1", 0), (None, base[7], "en", "s1", 1), (5, base[5], "en", "s2", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_one_by_one(spark):
    docs = table(spark)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, "").cache()
        if k == len(pipeline.STAGES) - 1:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.dtypes == docs.dtypes
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        after = {(r["doc_id"], r["text"]) for r in out.collect()}
        if k == 0:
            kept = {r["doc_id"] for r in quality_rules.measure(docs).collect() if r["kept"]}
            assert after == {x for x in before if x[0] in kept}
        if k == 1:
            found = minhash_dedup.near_duplicates(docs).collect()
            assert {x[0] for x in after} == {r["component_id"] for r in found}
            assert out.count() == len(after)
        if k == 2:
            texts = {r["doc_id"]: r["kept"].decode() for r in suffix_dedup.remove_repeats(docs).collect()}
            assert after == set(texts.items())
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] != dict(before)[r["doc_id"]])
        if k == 3:
            assert after <= before
        docs = out


def test_pipeline_over_the_small_tables(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 < r["length"] <= 1024 for r in rows)


def test_empty_table(spark):
    docs = table(spark).limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
