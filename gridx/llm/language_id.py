"""Language identification with a small byte convolutional network, trained in numpy.

A text is cut into windows of fixed length that cover it whole. Filters of several widths run over a window's bytes;
a filter's response at a place is a sum of one learned number per (offset, byte), so a convolution is table look-ups
and additions. The greatest response of each filter over the window (max pooling) goes through a linear layer and a
softmax. A text's distribution is the mean of its windows', weighted by their letters.

Training takes a bounded sample of labelled rows, whole texts: at most SAMPLE_DOCS for each of the LANGUAGES languages
with most rows, those whose ids have the least hashes. Prediction covers every text whole.

Defined results: `und` with score 0 for a null text, one without letters, or if no labelled rows exist; repeated
rows and null ids come back as they are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridx.llm import textvec as tv

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_DOCS, LANGUAGES = 400, 64
EPOCHS, BATCH, RATE = 6, 64, 0.02
UNDETERMINED = "und"

# A byte stands for its lower case; digits, and white space with ASCII signs, are one symbol each.
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[65:91] += 32
_SYMBOL[48:58] = 48
_SYMBOL[:48] = 32
_SYMBOL[58:65] = 32
_SYMBOL[91:97] = 32
_SYMBOL[123:128] = 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[192:] = True  # lead bytes of characters beyond ASCII


class Network:
    """Filters as look-up tables (one per width and offset: 256 x FILTERS), a linear layer, class names."""

    def __init__(self, classes: list[str], seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.classes = classes
        self.tables = {w: (random.standard_normal((w, 256, FILTERS)) * 0.5 / np.sqrt(w)).astype(np.float32) for w in WIDTHS}
        self.out = (random.standard_normal((len(WIDTHS) * FILTERS, len(classes))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def pooled(self, windows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(windows x all filters) greatest responses, and where they were found."""
        n = len(windows)
        found = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.empty(found.shape, np.int64) if places else None
        for k, (w, table) in enumerate(self.tables.items()):
            span = WINDOW - w + 1
            response = table[0][windows[:, :span]]
            for j in range(1, w):
                response += table[j][windows[:, j : j + span]]
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            if places:
                where[:, part] = response.argmax(axis=1)
                found[:, part] = np.take_along_axis(response, where[:, None, part], axis=1)[:, 0]
            else:
                found[:, part] = response.max(axis=1)
        return found, where

    def distribution(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on the cross-entropy; the gradient of a pooled filter goes to the bytes under its greatest response."""
        random = np.random.default_rng(seed)
        weights = [self.out, self.bias, *self.tables.values()]
        first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
        step = 0
        for epoch in range(epochs):
            order = random.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                x, y = windows[rows], labels[rows]
                pooled, where = self.pooled(x, places=True)
                hidden = np.maximum(pooled, 0)
                error = self.distribution(pooled)
                error[np.arange(len(rows)), y] -= 1
                error /= len(rows)
                back = (error @ self.out.T) * (pooled > 0)
                grads = [hidden.T @ error, error.sum(axis=0)]
                for k, (w, table) in enumerate(self.tables.items()):
                    grad = np.zeros_like(table)
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    filters = np.broadcast_to(np.arange(FILTERS), (len(rows), FILTERS))
                    for j in range(w):
                        symbol = np.take_along_axis(x, where[:, part] + j, axis=1)
                        np.add.at(grad[j], (symbol, filters), back[:, part])
                    grads.append(grad)
                step += 1
                rate = RATE / (1 + epoch)
                for p, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def windows_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW symbols, document): windows side by side over each whole text, the last padded with spaces."""
    size = np.diff(off)
    per = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), per)
    start = off[doc] + (np.arange(per.sum()) - (np.cumsum(per) - per)[doc]) * WINDOW
    index = start[:, None] + np.arange(WINDOW)
    past = index >= off[1:][doc][:, None]
    symbols = _SYMBOL[data]
    out = symbols[np.minimum(index, max(0, len(data) - 1))] if len(data) else np.zeros((0, WINDOW), np.uint8)
    out[past] = 32
    return out, doc


def predict(network: Network, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(class, score) of each text."""
    n = len(off) - 1
    x, doc = windows_of(data, off)
    total = np.zeros((n, len(network.classes)))
    weight = np.zeros(n)
    for i in range(0, len(x), 512):
        part = x[i : i + 512]
        letters = _LETTER[part].sum(axis=1).astype(np.float64)
        p = network.distribution(network.pooled(part)[0])
        np.add.at(total, doc[i : i + 512], p * letters[:, None])
        np.add.at(weight, doc[i : i + 512], letters)
    best = total.argmax(axis=1) if total.shape[1] else np.zeros(n, np.int64)
    score = np.where(weight > 0, total[np.arange(n), best] / np.maximum(weight, 1), 0.0)
    raw = data.tobytes()
    names = []
    for k in range(n):
        sure = weight[k] > 0 and (raw[off[k] : off[k + 1]].isascii() or any(c.isalpha() for c in raw[off[k] : off[k + 1]].decode("utf-8", "replace")))
        names.append(network.classes[best[k]] if sure else UNDETERMINED)
        if not sure:
            score[k] = 0.0
    return names, np.clip(score, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """The documents that training never sees: CRC-32 of the id as text leaves remainder 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> Network | None:
    """A network from a bounded sample of the labelled rows that are not held out; None if there are none."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return None
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    below = F.lit(0)
    for lang, n in sorted(counts.items()):
        below = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 2 * sample_docs / n) * (1 << 30)))).otherwise(below)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    near = rows.where(h < below).withColumn("hash", F.xxhash64("doc_id", F.lit(1))).withColumn("nth", nth)
    sample = near.where(F.col("nth") <= sample_docs).select("lang", "text", "hash").orderBy("hash").select("lang", "text").toArrow()
    classes = sorted(counts)
    data, off = tv.buffers(sample["text"])
    x, doc = windows_of(data, off)
    full = _LETTER[x].sum(axis=1) >= WINDOW // 8
    labels = np.array([classes.index(v) for v in sample["lang"].to_pylist()], np.int64)[doc]
    network = Network(classes)
    if full.any():
        short = x[full].copy()  # half of the windows lose their tail, as the windows of short texts do
        cut_at = np.random.default_rng(5).integers(24, WINDOW, len(short))
        cut_at[::2] = WINDOW
        short[np.arange(WINDOW)[None, :] >= cut_at[:, None]] = 32
        network.fit(short, labels[full])
    return network


def _predict(network: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            names, scores = [], []
            for i, j in tv.chunks(off):
                if network is None:
                    found, score = [UNDETERMINED] * (j - i), np.zeros(j - i)
                else:
                    found, score = predict(network, data[off[i] : off[j]], off[i : j + 1] - off[i])
                names += found
                scores.append(score)
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score for every text."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_predict(network), "doc_id long, lang_pred string, score double")
