"""Quantile edges, bins and grid cells as expressions.

k inner edges make k + 1 half-open bins: bin i holds e[i-1] <= v < e[i]. NULL and NaN fail every comparison
`v < e` and so belong to the last bin. Cells are numbered row-major over the bins of a group's columns.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_number(name: str, dtype: str) -> Column:
    """The column as a double; a timestamp or date counts in days since 1970, fractions included."""
    if dtype == "timestamp":
        return F.col(name).cast("double") / 86400.0
    if dtype == "timestamp_ntz":  # whatever the session's time zone
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(name)).cast("double") / 86400e6
    if dtype == "date":
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double")


def numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    types = dict(df.dtypes)
    return {c: as_number(c, types[c]) for c in columns}


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int, special: dict[str, Sequence[float]] | None = None, digits: int | None = None, accuracy: int | None = None) -> dict[str, list[float]]:
    """Inner edges of `bins` equally filled bins for each column, in one aggregate over the table.

    Exact quantiles with linear interpolation; with `accuracy` the mergeable sketch of percentile_approx, which
    is what large tables want. A special value gets a bin of its own (an edge at it, unless it is the least value,
    and one half-way to the next value, unless it is the greatest); the remaining edges split the other values.
    Edges are rounded to `digits` if given, and repeated edges are dropped.
    """
    special = special or {}
    value = numbers(df, columns)
    plain = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    facts = []
    for c in columns:
        for k, s in enumerate(sorted(special.get(c, ()))):
            facts += [F.min(F.when(plain[c] > s, plain[c])).alias(f"{c}__next{k}"), F.max(F.when(plain[c] < s, plain[c])).alias(f"{c}__prev{k}"), F.sum((plain[c] == s).cast("long")).alias(f"{c}__n{k}")]
    known = df.agg(*facts).first().asDict() if facts else {}
    own: dict[str, list[float]] = {c: [] for c in columns}
    for c in columns:
        for k, s in enumerate(sorted(special.get(c, ()))):
            if known[f"{c}__n{k}"]:
                own[c] += [float(s)] * (known[f"{c}__prev{k}"] is not None)
                if known[f"{c}__next{k}"] is not None:
                    own[c].append(s + (known[f"{c}__next{k}"] - s) / 2)
    wanted, left = [], {}
    for c in columns:
        left[c] = bins - len(own[c])
        at = [i / left[c] for i in range(1, left[c])] if left[c] > 1 else []
        if at:
            rest = F.when(~plain[c].isin([float(s) for s in special.get(c, ())]), plain[c]) if special.get(c) else plain[c]
            share = F.array(*[F.lit(p) for p in at])
            wanted.append((F.percentile_approx(rest, at, accuracy) if accuracy else F.percentile(rest, share)).alias(c))
    cut = df.agg(*wanted).first().asDict() if wanted else {}
    out = {}
    for c in columns:
        edges = own[c] + [float(x) for x in cut.get(c) or []]
        if digits is not None:
            edges = [round(x, digits) for x in edges]
        out[c] = sorted(set(edges))
    return out


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Bin number as a balanced tree of comparisons, inside whole-stage code: about log2(edges) tests a row."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(float(edges[middle])), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(edges))


def bin_number(value: float | None, edges: Sequence[float]) -> int:
    """The bin of one value, on the driver."""
    return len(edges) if value is None or math.isnan(value) else bisect_right(edges, value)


def bounds(bin_index: int, edges: Sequence[float]) -> tuple[float, float]:
    full = [-math.inf, *edges, math.inf]
    return full[bin_index], full[bin_index + 1]


def bins_for(op: str, value: float, edges: Sequence[float]) -> tuple[int, int]:
    """Bins [low, high) that can hold a v with `v op value`. A bin that starts at the value is kept for <=."""
    n = len(edges) + 1
    if op in (">", ">="):
        return bisect_right(edges, value), n
    if op == "<":
        return 0, bisect_left(edges, value) + 1
    if op == "<=":
        return 0, bisect_right(edges, value) + 1
    if op == "=":
        return bisect_right(edges, value), bisect_right(edges, value) + 1
    raise ValueError(f"unknown comparison {op}")


def cell_of(bins: Sequence[Column], shape: Sequence[int]) -> Column:
    """Row-major cell number: the last column's bin runs fastest."""
    cell = F.lit(0).cast("long")
    for b, n in zip(bins, shape, strict=True):
        cell = cell * F.lit(n).cast("long") + b.cast("long")
    return cell


def coordinates(cell: Column, shape: Sequence[int]) -> list[Column]:
    """The bins behind a cell number."""
    out, step = [], 1
    for n in reversed(shape):
        out.append(F.pmod(F.floor(cell / step), F.lit(n)).cast("int"))
        step *= n
    return out[::-1]


def quantize(df: DataFrame, edges: dict[str, Sequence[float]]) -> DataFrame:
    """Every listed column replaced by its bin, in one projection."""
    value = numbers(df, list(edges))
    return df.select(*[bin_of(value[c], edges[c]).alias(c) if c in edges else F.col(c) for c in df.columns])


def quantile_space(value: Column, edges: Sequence[float], low: float, high: float) -> Column:
    """Bin number plus the place inside the bin, clipped to [0, bins]; the outer bins end at low and high."""
    full = [low, *edges, high]
    n = len(full) - 1
    out = F.lit(float(n))
    for i in range(n - 1, -1, -1):
        inside = i + (value - full[i]) / (full[i + 1] - full[i]) if full[i + 1] > full[i] else F.lit(float(i))
        out = F.when(value <= full[i + 1], F.greatest(F.lit(0.0), inside)).otherwise(out)
    return out


def po2_near_sqrt(x: Column) -> Column:
    """2 ** floor(log2(sqrt(x))); 0 for 0, an error below 0."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.sqrt(x))))
    return F.when(x == 0, F.lit(0)).when(x > 0, power.cast("long")).otherwise(F.raise_error(F.lit("po2_near_sqrt of a negative number")).cast("long"))


def digest(text: Column, n: int = 10) -> Column:
    """The first n hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)
