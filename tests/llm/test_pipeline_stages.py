import random

import corpus_pipeline as pipeline
from gridx.llm import minhash_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_pairs_above_four_fifths_are_near_duplicates(spark):
    w = words(100, 1)
    near = w[:40] + ["other"] + w[41:50] + ["another"] + w[51:]  # 86 of 106 shingles in common: 0.81
    far = w[:40] + ["third"] + w[41:60] + ["fourth"] + w[61:80] + ["fifth"] + w[81:]  # 81 of 111: 0.73
    docs = frame(spark, [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far))])
    assert {r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}


def test_texts_of_a_repeated_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(words(60, k)) for k in (2, 3, 4))
    docs = frame(spark, [(1, a), (5, a), (5, b), (5, b), (3, c), (3, c + " x"), (8, b + " y"), (9, None), (9, None), (9, "one two"), (None, a)])
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([(1, a), (5, b), (3, c), (9, ""), (9, "one two"), (0, a)])


def test_the_mix_is_in_order_of_finish_time(spark):
    rows = [(i, " ".join(words(5 + i % 7, i)), "en", f"s{i % 3}", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    order = mixing.mix(docs).where("2 * words >= size").orderBy("finish", "sid").collect()
    assert [r["doc_id"] for r in pipeline.mix(spark, docs, "").collect()] == [r["doc_id"] for r in order]


def test_clashing_and_extra_columns(spark):
    w = [" ".join(words(40, k)) for k in range(3)]
    names = "dropped_id, key, label, n, n_of_key, size, sid, finish, carried_0, whole_text, kept, found".split(", ")
    rows = [(i, t, "en", "s", 1, *[i] * len(names)) for i, t in [(1, w[0]), (2, w[0] + " x"), (3, w[1]), (4, None), (5, w[2])]]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} long" for n in names))
    for _, stage in pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [*"doc_id text lang source n_chars".split(), *names]
    assert {r["doc_id"] for r in docs.collect()} == {1, 3, 4, 5}
    assert pipeline.pack(spark, docs, "").count() >= 4
