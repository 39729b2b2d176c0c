"""Bounded-space online best-fit packing of token pieces into sequences of fixed length.

A document is its token ids and an end id. Documents longer than a sequence are cut: the first piece takes the
remainder, every further piece fills a sequence of its own. Pieces arrive in partition order; each goes to the
fullest open sequence that still has room for it, found by a shift and a lowest-bit test in a bitset keyed by free
space. At most `open_bins` sequences are open; the fullest closes first. What is still open at the end of a
partition, a bounded number of pieces, is offered once more, over a fixed number of partitions together and in the
order of their checksums, by the same rule with the same bound on open sequences.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they occur; null
ids are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridx.llm import textvec as tv
from gridx.llm.common import cut, texts
from gridx.llm.tokens import BYTE_VOCABULARY, ByteLevel, vocabulary_path

LENGTH, END_ID, OPEN_BINS = 1024, 2, 256
#: Partitions whose open sequences are packed together.
TOGETHER = 64
COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


class BestFit:
    """Places sizes online; sequence numbers count up from `first`."""

    def __init__(self, length: int, open_bins: int, first: int) -> None:
        self.length, self.open_bins, self.next = length, open_bins, first
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = 0  # bit f is set if a sequence with f free is open
        self.n_open = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to `length` tokens."""
        room = self.bits >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes first
            sequence, free = self.next, self.length
            self.next += 1
        left = free - size
        if left:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.n_open += 1
        return sequence, self.length - free

    def still_open(self) -> set[int]:
        return {x for bins in self.by_free for x in bins}


def pieces(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a document of n tokens: the remainder first, then whole sequences."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def _rows(rows: list[tuple], open_bins: set[int]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    arrays = [pa.array(c, t) for c, t in zip(columns, _SCHEMA.types[:7], strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([r[5] in open_bins for r in rows], pa.bool_())], schema=_SCHEMA)


def _pack(path: str, length: int, end_id: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteLevel(path)
        fit = BestFit(length, open_bins, TaskContext.get().partitionId() << 36)
        held: dict[int, list[tuple]] = {}  # pieces of open sequences; bounded by the open sequences' tokens
        done: list[tuple] = []
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for i, j, ids in tokenizer.batches(batch.column("text")):
                for k in range(i, j):
                    own = np.append(ids[k - i], np.uint32(end_id))
                    raw = own.astype("<u4").tobytes()
                    for p, (start, size) in enumerate(pieces(len(own), length)):
                        sequence, offset = fit.place(size)
                        held.setdefault(sequence, []).append((ids_of[k], p, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), sequence, offset))
                if len(held) > 8 * open_bins:
                    still = fit.still_open()
                    for x in [x for x in held if x not in still]:
                        done += held.pop(x)
                    yield _rows(done, set())
                    done = []
        still = fit.still_open()
        yield _rows([r for x in held.values() for r in x], still)
        del tokenizer
        tv.tidy()

    return run


def _repack(length: int, open_bins: int):
    def run(table: pa.Table) -> pa.Table:
        size = table["length"].to_numpy()
        crc = table["ids_crc32"].to_numpy()  # any order that is fixed and mixes long and short pieces
        order = np.lexsort((table["start"].to_numpy(), size, crc))
        fit = BestFit(length, open_bins, ((1 << 26) + table["team"][0].as_py()) << 36)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for r in order:
            sequence[r], offset[r] = fit.place(int(size[r]))
        for name, values in (("sequence_id", sequence), ("offset", offset)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
        return table.drop_columns(["team"])

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = cut(texts(docs).mapInArrow(_pack(path or vocabulary_path(BYTE_VOCABULARY), length, end_id, open_bins), f"{COLUMNS}, open boolean"))
    closed = packed.where("not open").drop("open")
    team = F.shiftright("sequence_id", 36) / TOGETHER
    left = packed.where("open").drop("open").withColumn("team", F.floor(team).cast("long"))
    again = left.groupBy("team").applyInArrow(_repack(length, open_bins), COLUMNS)
    return closed.unionByName(again)
