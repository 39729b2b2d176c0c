"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counting. Each task counts the distinct n-grams (ORDER bytes, packed in a long) of its trusted texts; the counts are
summed by n-gram. Lower orders use continuation counts (in how many distinct longer n-grams a string occurs), again
by grouping. Three discounts an order come from the counts of counts.

Scoring. The distinct n-grams of the whole corpus are joined, shard by shard, with the counts of their contexts and
suffixes, order by order, into one log probability each, a whole number of steps of 2 ** -STEP_BITS. If that table
has at most TABLE_ROWS rows it goes to the scoring tasks as arrays (a counted bound: 12 bytes a row); beyond it,
documents' n-gram counts are joined with it. Sums of whole numbers do not depend on their order, so both ways give
the same perplexities to the last bit. A document's perplexity is exp(-mean log probability) per byte.

Thresholds. Four in five trusted documents train; the rest, which the model has not seen, give each language's own
quantile of perplexity. A language without such documents takes the quantile of all of them.

Defined results: a null or empty text has no perplexity and is not kept; a null language is a language of its own;
without trusted rows there is no model: perplexity is null and nothing is kept; repeated rows and null ids come back
as they are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridx.llm import textvec as tv
from gridx.llm.common import broadcast_within, cut

U = np.uint64
ORDER = 5
QUANTILE, MARGIN = 0.99, 1.05
TABLE_ROWS = 4_000_000
STEP_BITS = 24
FLUSH_GRAMS = 2_000_000


def grams_of(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram at every byte of every text, document): the byte and the order - 1 before it, zeros before the text."""
    size = np.diff(off)
    pad = order - 1
    place = np.arange(len(data)) + np.repeat((np.arange(len(size)) + 1) * pad, size)
    wide = np.zeros(len(data) + (len(size) + 1) * pad, U)
    wide[place] = data
    key = np.zeros(len(data), U)
    for i in range(pad, -1, -1):
        key = (key << U(8)) | wide[place - i]
    return key, np.repeat(np.arange(len(size)), size)


def _count(order: int):
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.chunks(off, 2 << 20, 1 << 20):
                g, _ = grams_of(data[off[i] : off[j]], off[i : j + 1] - off[i], order)
                g, n = np.unique(g, return_counts=True)
                both = np.concatenate((keys, g))
                order_ = np.argsort(both, kind="stable")
                both, n = both[order_], np.concatenate((counts, n))[order_]
                if len(both):
                    head = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
                    keys, counts = both[head], np.add.reduceat(n, head)
                if len(keys) > FLUSH_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], schema=schema)
                    keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], schema=schema)

    return run


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all texts, counted in the tasks before the shuffle."""
    return texts.select("text").mapInArrow(_count(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    row = counts.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [row[f"n{k}"] or 0 for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True))


def model_shards(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame, tuple[float, float, float]]]:
    """For each order from the longest: ((gram, n), (context, total, n1, n2, n3), discounts).

    Below the longest, n is the number of distinct bytes seen before the string.
    """
    out = []
    for k in range(order, 0, -1):
        counts = cut(counts)
        contexts = counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"), F.sum((F.col("n") > 2).cast("long")).alias("n3")
        )
        out.append((counts, cut(contexts), discounts(counts)))
        counts = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    return out


def log_probabilities(grams: DataFrame, shards, order: int = ORDER) -> DataFrame:
    """(gram, logp) for the given distinct n-grams, in steps: joins with the sharded counts, shortest order first."""
    rows = grams.select("gram").withColumn("p", F.lit(1.0 / 256))
    for k, (counts, contexts, (d1, d2, d3)) in zip(range(1, order + 1), reversed(shards), strict=True):
        rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)))
        rows = rows.join(counts.select(F.col("gram").alias("suffix"), "n"), "suffix", "left")
        rows = rows.withColumn("context", F.shiftright("suffix", 8)).join(contexts, "context", "left")
        n = F.coalesce("n", F.lit(0))
        off = F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        spare = d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((n - off + spare * F.col("p")) / F.col("total"))
        rows = rows.select("gram", p.alias("p"))
    return rows.select("gram", F.round(F.log("p") * float(1 << STEP_BITS)).cast("int").alias("logp"))


class _Table:
    """n-gram to log probability for whole arrays: one slot by hash, then a sorted search for the rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(12, int(2 * len(keys)).bit_length())
        self.slot_key = np.zeros(1 << self.bits, U)
        self.slot_value = np.zeros(1 << self.bits, np.int32)
        slot = self._slot(self.keys)
        self.slot_key[slot], self.slot_value[slot] = self.keys, self.values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.slot_value[slot]
        miss = np.flatnonzero(self.slot_key[slot] != keys)
        if len(miss):
            out[miss] = self.values[np.searchsorted(self.keys, keys[miss])]
        return out


def _score(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(*shared.value)
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            sums = []
            for i, j in tv.chunks(off):
                o = off[i : j + 1] - off[i]
                g, _ = grams_of(data[off[i] : off[j]], o, order)
                sums.append(np.diff(np.concatenate(([0], np.cumsum(table.look_up(g), dtype=np.int64)))[o]))
            total = np.concatenate(sums) if sums else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "lang", "role")], pa.array(np.diff(off)), pa.array(total)], names=["doc_id", "lang", "role", "n_bytes", "total"])

    return run


def _doc_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            rows = batch.column("row").to_numpy()
            for i, j in tv.chunks(off):
                g, doc = grams_of(data[off[i] : off[j]], off[i : j + 1] - off[i], order)
                by = np.lexsort((g, doc))
                g, doc = g[by], doc[by]
                if len(g):
                    head = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))))
                    n = np.diff(np.append(head, len(g)))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[i + doc[head]]), pa.array(g[head].view(np.int64)), pa.array(n)], names=["row", "gram", "n"])

    return run


def score(rows: DataFrame, table: DataFrame, order: int = ORDER, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, lang, role, n_bytes, perplexity from (gram, logp)."""
    n = table.count()
    if n <= table_rows:
        found = table.toArrow()
        keys, values = found["gram"].to_numpy().astype(np.int64).view(U), found["logp"].to_numpy().astype(np.int32)
        shared = rows.sparkSession.sparkContext.broadcast((keys, values))
        summed = rows.mapInArrow(_score(shared, order), "doc_id long, lang string, role string, n_bytes long, total long")
    else:
        named = rows.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))))
        own = named.dropDuplicates(["row"]).select("row", "text").mapInArrow(_doc_grams(order), "row long, gram long, n long")
        sums = own.join(table, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("total"))
        sized = named.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).drop("text")
        summed = sized.join(sums, "row", "left")
    mean = F.col("total") / F.col("n_bytes") / float(1 << STEP_BITS)
    return summed.select("doc_id", "lang", "role", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-mean)).alias("perplexity"))


def trains(doc_id: Column) -> Column:
    """Four in five trusted documents train the model; the others set thresholds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def classify(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept for every document; trusted_ids has a doc_id column."""
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("trusted_id")).where("trusted_id is not null").distinct()
    n_ids = ids.count()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    marked = rows.join(broadcast_within(ids, n_ids), rows["doc_id"] == F.col("trusted_id"), "left")
    role = F.when(F.col("trusted_id").isNull(), "other").when(trains(F.col("doc_id")), "train").otherwise("judge")
    rows = marked.select("doc_id", "text", "lang", role.alias("role"))
    shards = model_shards(gram_counts(rows.where("role = 'train'"), order), order)
    known = shards[0][0].limit(1).count() > 0
    if not known:
        nothing = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", nothing.alias("perplexity"), nothing.alias("threshold"), F.lit(False).alias("kept"))
    table = cut(log_probabilities(gram_counts(rows, order), shards, order))
    scored = cut(score(rows, table, order, table_rows))
    judged = scored.where("role = 'judge' and perplexity is not null")
    by_lang = judged.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("own"))
    overall = judged.agg(F.percentile_approx("perplexity", quantile, 10000).alias("p")).first()["p"]
    if overall is None:  # too few trusted documents to set any aside
        overall = scored.where("role = 'train'").agg(F.max("perplexity").alias("p")).first()["p"]
    limits = by_lang.select(F.col("lang").alias("of"), "own")
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["of"]), "left")
    threshold = F.coalesce("own", F.lit(overall)) * margin
    return joined.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
