"""FITS binary tables as DataFrames: headers are read first, rows by ranges of bytes in the tasks.

A file is a sequence of units; a unit is a header, 80-character cards up to END, and data, both padded to 2,880
bytes. A binary table's rows have a fixed width, so any range of rows is one range read, and a large file is dealt to
many tasks. Supported cells: logical, integers of 8 to 64 bits, floats, text, and fixed arrays of them; integers with
a zero point (unsigned ones) and scaled columns are converted; arrays of a fixed size become Spark arrays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

BLOCK, CARD = 2880, 80
#: Bytes of rows that one task reads at a time.
SPLIT_BYTES = 32 << 20
# Cell codes of the format with their bytes' meaning (big-endian) and Spark types.
CODES = {"L": ("S1", "boolean"), "B": ("u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}
ARROW = {"boolean": pa.bool_(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}


@dataclass(frozen=True)
class Column:
    name: str
    code: str
    count: int
    offset: int
    scale: float = 1.0
    zero: float = 0.0

    @property
    def kind(self) -> str:
        """Spark type of one cell's elements."""
        if self.code in "LA":
            return CODES[self.code][1]
        if self.scale != 1.0 or self.zero != int(self.zero):
            return "double"
        if self.zero and self.code in "BIJK":  # unsigned integers need the next wider type
            return {"B": "smallint", "I": "int", "J": "bigint", "K": "decimal(20,0)"}[self.code]
        return CODES[self.code][1]

    @property
    def width(self) -> int:
        return self.count * (1 if self.code in "LAB" else int(CODES[self.code][0][-1]))

    @property
    def is_array(self) -> bool:
        return self.code != "A" and self.count != 1


@dataclass(frozen=True)
class Table:
    columns: tuple[Column, ...]
    row_bytes: int
    rows: int
    start: int

    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` array<{c.kind}>" if c.is_array else f"`{c.name}` {c.kind}" for c in self.columns)


def _cards(read, at: int) -> tuple[dict[str, str], int]:
    """(keyword to value, place after the header)."""
    found: dict[str, str] = {}
    while True:
        block = read(at, BLOCK)
        if len(block) < BLOCK:
            raise ValueError("a header ends without END")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].rstrip()
            if key == "END":
                return found, at
            if card[8:10] == "= ":
                text = re.match(r"\s*'((?:[^']|'')*)'", card[10:])
                found[key] = text[1].replace("''", "'").rstrip() if text else card[10:].split("/")[0].strip()


def read_table(read, extension: int = 1) -> Table:
    """The layout of the given extension's binary table; read(offset, n) gives bytes of the file."""
    at = 0
    for number in range(extension + 1):
        cards, at = _cards(read, at)
        sizes = [int(cards[f"NAXIS{k}"]) for k in range(1, int(cards["NAXIS"]) + 1)]
        data = abs(int(cards["BITPIX"])) // 8 * int(cards.get("GCOUNT", 1)) * (int(cards.get("PCOUNT", 0)) + math.prod(sizes)) if sizes else 0
        if number < extension:
            at += -(-data // BLOCK) * BLOCK
    if cards.get("XTENSION") != "BINTABLE":
        raise ValueError(f"extension {extension} is no binary table")
    columns, offset = [], 0
    for k in range(1, int(cards["TFIELDS"]) + 1):
        form = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"])
        if form is None or form[2] not in CODES:
            raise ValueError(f"cells of the form {cards[f'TFORM{k}']} are not supported")
        column = Column(cards.get(f"TTYPE{k}", f"col{k}"), form[2], int(form[1] or 1), offset, float(cards.get(f"TSCAL{k}", 1)), float(cards.get(f"TZERO{k}", 0)))
        columns.append(column)
        offset += column.width
    return Table(tuple(c for c in columns if c.count), sizes[0], sizes[1], at)


def decode(column: Column, rows: np.ndarray) -> pa.Array:
    """The column's cells of rows (bytes, one row a line)."""
    raw = np.ascontiguousarray(rows[:, column.offset : column.offset + column.width])
    if column.code == "A":
        texts = raw.view(f"S{column.width}").reshape(-1)
        return pa.array([t.split(b"\0")[0].decode("latin-1").rstrip() for t in texts], pa.string())
    if column.code == "L":
        flat = pa.array(raw.reshape(-1) == ord("T"))
    else:
        values = raw.view(CODES[column.code][0]).reshape(-1)
        if column.kind == "decimal(20,0)":
            flat = pa.array([int(v) + int(column.zero) for v in values], pa.decimal128(20, 0))
        elif column.kind == "double" and column.code != "D":
            flat = pa.array(values * column.scale + column.zero, pa.float64())
        else:
            wide = ARROW[column.kind].to_pandas_dtype()
            values = values.astype(wide)
            if column.code == "D":
                values = values * column.scale + column.zero
            elif column.zero:
                values = values + wide(column.zero)
            flat = pa.array(values, ARROW[column.kind])
    if not column.is_array:
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * column.count), flat)


def _reader(path: str):
    fs, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    file = fs.open_input_file(place)
    return lambda at, n: file.read_at(n, at)


def table(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, extension: int = 1, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All rows of the files' tables, which must have one layout; only the named columns are decoded.

    The driver reads the files' headers; the rows are read by the tasks, a bounded range at a time.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files")
    layouts = {p: read_table(_reader(p), extension) for p in paths}
    first = layouts[paths[0]]
    if any((t.columns, t.row_bytes) != (first.columns, first.row_bytes) for t in layouts.values()):
        raise ValueError("the files' tables differ in their columns")
    chosen = Table(tuple(c for c in first.columns if columns is None or c.name in columns), first.row_bytes, first.rows, first.start)
    each = max(1, split_bytes // first.row_bytes)
    ranges = [(p, t.start + r * t.row_bytes, min(each, t.rows - r)) for p, t in layouts.items() for r in range(0, t.rows, each)]
    dealt = spark.createDataFrame(ranges, "path string, at long, n long").repartition(max(1, len(ranges)), "path", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = np.frombuffer(_reader(path)(at, n * chosen.row_bytes), np.uint8).reshape(n, chosen.row_bytes)
                yield pa.RecordBatch.from_arrays([decode(c, rows) for c in chosen.columns], names=[c.name for c in chosen.columns])

    return dealt.mapInArrow(read, chosen.ddl())
