"""Each registered query over the smallest tables, its columns recomputed from the whole texts."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from gridx.llm import tokens
from tests.llm.test_dedup import brute_near, brute_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def run(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir).collect()


def by_id(rows):
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op1(spark, sf_dir, table):
    rows = by_id(run(spark, sf_dir, "op1_mix_sources"))
    assert rows.keys() == table.keys()
    sizes, taken, target = {}, {}, {}
    for i, r in rows.items():
        source = table[i]["source"]
        assert r["size"] == len(WORD.findall(table[i]["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    assert all(r["source_size"] == sizes[table[i]["source"]] for i, r in rows.items())
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= 256 for s in sizes)


def test_op2(spark, sf_dir, table):
    rows = run(spark, sf_dir, "op2_near_dedup")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute_near([(i, r["text"]) for i, r in table.items()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_op3(spark, sf_dir, table):
    rows = by_id(run(spark, sf_dir, "op3_media_columns"))
    for i, r in table.items():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        got = rows[i]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got["digest"] == got["payload_sha256"] and got["length"] == got["media_bytes"] and (got["width"], got["height"], got["bits"]) == (64, len(payload) // 64, 8)
    assert len(rows) == len(table)


def test_op4(spark, sf_dir, table):
    rows = by_id(run(spark, sf_dir, "op4_language_id"))
    assert rows.keys() == table.keys()
    langs = {r["lang"] for r in table.values()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in table[i]["text"] or "")
        assert (r["lang_pred"] in langs) if letters else (r["lang_pred"] == "und")
    held = [i for i, r in rows.items() if r["held_out"] and table[i]["lang"] is not None]
    assert sum(rows[i]["lang_pred"] == table[i]["lang"] for i in held) >= 0.9 * len(held)


def test_op5(spark, sf_dir, table):
    got = run(spark, sf_dir, "op5_suffix_dedup")
    assert sorted(map(tuple, got), key=str) == brute_repeats([(i, r["text"]) for i, r in table.items()])


def test_op6(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = run(spark, sf_dir, "op6_html_extract")
    assert {r["page_id"] for r in rows} == pages.keys() and len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        assert r["url"] == page["url"] and r["n_chars"] == len(r["text"])
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)
        if article:  # the same words, whatever the blocks
            assert r["text"].split() == html.unescape(re.sub(r"<(?:br|/?(?:p|h1|li|div))[^>]*>", " ", re.sub(r"</?b>", "", article[1]))).split()


def test_op7(spark, sf_dir, table):
    tokenizer = tokens.load(tokens.vocabulary_path(tokens.WORD_VOCABULARY))
    rows = by_id(run(spark, sf_dir, "op7_token_counts"))
    for i, r in table.items():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)
    assert len(rows) == len(table)


def test_op8(spark, sf_dir, table):
    rows = by_id(run(spark, sf_dir, "op8_quality_rules"))
    for i, r in table.items():
        text = r["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        seen, covered = {}, set()
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        for k, w in enumerate(windows):
            if seen[w] > 1:
                covered.update(range(k, k + 8))
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        got = rows[i]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert got["base_failed"] == failed and not (failed and got["kept"])
    assert len(rows) == len(table)


def test_op9(spark, sf_dir, table):
    rows = by_id(run(spark, sf_dir, "op9_quality_classifier"))
    assert rows.keys() == table.keys()
    for i, r in rows.items():
        assert (r["perplexity"] is None) == (not table[i]["text"])
        assert r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"])


def test_op10(spark, sf_dir, table):
    tokenizer = tokens.load(tokens.vocabulary_path(tokens.BYTE_VOCABULARY))
    pieces, sequences = {}, {}
    for r in run(spark, sf_dir, "op10_best_fit_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == table.keys()
    for i, found in pieces.items():
        ids = [*tokenizer.encode(table[i]["text"] or "", add_special_tokens=False).ids, 2]
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(-(-len(ids) // 1024)))
        at = 0
        for r in found:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 1024 for r in found[1:])
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
