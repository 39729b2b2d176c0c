import random
import tarfile

from gridx.llm import media, minhash_dedup

SCHEMA = "doc_id long, text string"


def test_media_of_an_id_with_two_texts(spark, tmp_path):
    rows = [(1, "A"), (5, "A"), (5, "B"), (None, "C"), (7, None), (8, "B"), (5, "B")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = media.media_columns(docs, f"file://{tmp_path}").collect()
    sent = sorted((r["doc_id"] or 0, r["digest"], r["payload_sha256"]) for r in got)
    digest = lambda t: media.hashlib.sha256(media.payload_of((t or "").encode())).hexdigest()
    assert sent == sorted((i or 0, digest(t), digest(t)) for i, t in rows)
    members = [m.name for p in tmp_path.glob("*.tar") for m in tarfile.open(p)]
    assert sorted(members) == sorted(f"{digest(t)}.png" for t in ("A", "B", "C", None))


def texts(n, seed):
    """n texts without a common shingle, and a near copy of each."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    found = [[word() for _ in range(80)] for _ in range(n)]
    return [" ".join(t) for t in found], [" ".join([*t[:-1], "other"]) for t in found]


def components(spark, rows):
    return {(r["doc_id"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_every_set_of_a_repeated_id_is_searched(spark):
    t, near = texts(6, 1)
    rows = [(3, x) for x in t] + [(10 + k, x) for k, x in enumerate(near)] + [(30, "one two three")]
    assert components(spark, rows) == {(3, 3), *((10 + k, 3) for k in range(6)), (30, 30)}


def test_an_id_links_its_sets(spark):
    (a, b, c), (near_a, near_b, near_c) = texts(3, 2)
    rows = [(1, a), (2, b), (5, near_a), (5, near_b), (5, near_b), (7, near_b), (8, c), (9, near_c), (4, a), (4, c)]
    assert components(spark, rows) == {(i, 1) for i in (1, 2, 4, 5, 7, 8, 9)}
