import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridx.llm import minhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, text_len int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)


def brute_repeats(rows, length=50):
    texts = [(i if i is not None else 1 << 63, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((None if i == 1 << 63 else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run_repeats(spark, rows, **more):
    got = suffix_dedup.remove_repeats(frame(spark, rows), **more).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, got.collect()), key=str)


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [text(12) for _ in range(4)]
    rows = []
    for i in range(n):
        t = text(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            t += " " + r.choice(passages)[r.randint(0, 9) :] + text(4)
        rows.append((i * 3, t))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (501, rows[4][1]), (7, None), (8, ""), (9, "x" * 300), (10, "y" + "x" * 120), (None, rows[5][1]), (2, "\u0000" * 70), (1, "ab" * 100), (4, "z" + "ab" * 40)]
    return rows


def test_repeats_match_brute_force(spark):
    rows = corpus()
    assert run_repeats(spark, rows) == brute_repeats(rows)
    assert run_repeats(spark, rows, block_bytes=300) == brute_repeats(rows)


def test_repeats_with_hot_anchors(spark):
    """A passage in many documents, in unlike surroundings, and copies; every anchor is hot in the second run."""
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ") for _ in range(130))
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 3))) + passage[r.randint(0, 20) :] + "".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(80)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(40)]
    for block_bytes in (1 << 19, 2000, 1):
        assert run_repeats(spark, rows, block_bytes=block_bytes) == brute_repeats(rows)


def test_repeats_of_empty_table(spark):
    assert run_repeats(spark, []) == []


def test_interval_expansion_groups_equal_prefixes():
    r = random.Random(5)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(3000)).encode() * 2 + b"tail", np.uint8)
    for length in (9, 20, 50):
        order, cls = suffix_dedup.common_prefix_classes(data, length)
        ring = data.tobytes() * 2
        by = {}
        for p, c in zip(order.tolist(), cls.tolist(), strict=True):
            by.setdefault(c, set()).add(ring[p : p + length])
        assert all(len(x) == 1 for x in by.values())
        assert len(by) == len({ring[p : p + length] for p in range(len(data))})


def test_kept_text_drops_only_whole_characters(spark):
    a = "é" * 40
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, [(1, a), (2, "x" + a + "è")]), with_text=True).collect()}
    assert got[1]["kept_text"] == a and got[2]["kept_text"] == "xè"


def brute_near(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), top(i)) for i in ids)


def near_corpus(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(500)]
    rows, k = [], 0
    for base in range(12):
        t = [r.choice(words) for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 14)):
            u = list(t)
            for _ in range(r.randint(0, max(1, len(u) // 60))):
                u[r.randrange(len(u))] = r.choice(words)
            rows.append((k, ("\n" if k % 3 else " ").join(u).title() if k % 4 == 0 else " ".join(u)))
            k += 1
            if r.random() < 0.3:
                t = u  # chains: similar to the neighbour, not to the first
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1005, "ÄÖ two"), (1006, "äÖ two")]


def test_near_duplicates_match_brute_force(spark):
    rows = near_corpus()
    got = minhash_dedup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_near(rows)


def test_leaves_of_large_buckets(spark, monkeypatch):
    """Buckets over BLOCK: few leaves outside the main component, and many."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 6)
    r = random.Random(3)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(60):
        u = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            u[r.randrange(len(u))] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(u)))
    got = minhash_dedup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_near(rows)


def test_near_duplicates_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "SALT", 2)
    rows = near_corpus(9)
    got = minhash_dedup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_near(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")]])
def test_near_duplicates_degenerate(spark, rows):
    got = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == r["doc_id"] for r in got)
