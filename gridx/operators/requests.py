"""Ranges of work: merging them, dealing them out, splitting counts. Tables use windows; small lists stay on the driver."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridx.functions.binning import bin_of


#: Ranges that one piece of the start axis is sized for, and pieces at most.
PIECE_ROWS, PIECES = 1 << 20, 1024


def merge_ranges(df: DataFrame, key: str = "grp", start: str = "start", stop: str = "stop", distance: int = 1, keep: bool = False, pieces: int | None = None) -> DataFrame:
    """(key, start, stop, n): ranges of a key that overlap or lie less than `distance` apart become one.

    Distance 0 merges only ranges with a common part, 1 also ranges that touch, and so on. Empty ranges (start =
    stop) are dropped. With keep, the merged ranges come along as an array. The start axis is cut at quantiles into
    pieces, so a key with many ranges is swept by several tasks; how far a piece's predecessors reach, and how many
    merged ranges they open, is one row a key and piece.
    """
    full = df.where(F.col(start) != F.col(stop))
    pieces = pieces or min(PIECES, -(-full.count() // PIECE_ROWS)) or 1
    cuts = full.agg(F.percentile_approx(start, [i / pieces for i in range(1, pieces)], 10 * pieces)).first()[0] if pieces > 1 else []
    rows = full.withColumn("piece", bin_of(F.col(start), sorted(set(cuts or []))))
    earlier = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(key, "piece").orderBy(start, stop)

    def named(totals: DataFrame, value: Column) -> DataFrame:
        return totals.select(F.col(key).alias("of_key"), F.col("piece").alias("of_piece"), value.alias("carried"))

    def with_carried(rows: DataFrame, totals: DataFrame) -> DataFrame:
        return rows.join(totals, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("piece") == F.col("of_piece"))).drop("of_key", "of_piece")

    reaches = named(rows.groupBy(key, "piece").agg(F.max(stop).alias("most")), F.max("most").over(earlier))
    reach = F.greatest(F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    opens = F.when(reach.isNull() | (F.col(start) > reach + F.lit(distance - 1)), 1).otherwise(0)
    marked = with_carried(rows, reaches).withColumn("opens", opens).drop("carried")
    before = named(marked.groupBy(key, "piece").agg(F.sum("opens").alias("opened")), F.coalesce(F.sum("opened").over(earlier), F.lit(0)))
    here = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    island = with_carried(marked.withColumn("here", here), before).withColumn("island", F.col("carried") + F.col("here"))
    more = [F.sort_array(F.collect_list(F.struct(start, stop))).alias("ranges")] if keep else []
    merged = island.groupBy(key, "island").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n"), *more)
    return merged.drop("island")


def merge_list(ranges: Iterable[tuple[int, int]], distance: int = 1) -> list[tuple[int, int]]:
    """The same for a short list on the driver."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if a == b:
            continue
        if out and a <= out[-1][1] + distance - 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def deal(sizes: Sequence[int], queues: int, largest_first: bool = False) -> list[int]:
    """Queue of each item: always the least loaded one, the first among equals."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i]) if largest_first else range(len(sizes))
    loads, out = [(0, q) for q in range(queues)], [0] * len(sizes)
    heapq.heapify(loads)
    for i in order:
        load, q = heapq.heappop(loads)
        out[i] = q
        heapq.heappush(loads, (load + sizes[i], q))
    return out


def grouped(requests: Sequence[Sequence[int]], groups: int, whole_requests: bool = False) -> list[list[int]]:
    """Group of each list in each request: one group, one each, or greedily the least filled."""
    total = sum(map(len, requests))
    if groups < 1:
        raise ValueError("at least one group")
    if groups == total and not whole_requests:
        flat = list(range(total))
    elif whole_requests:
        own = deal([sum(r) for r in requests], groups)
        return [[g] * len(r) for g, r in zip(own, requests, strict=True)]
    else:
        flat = deal([s for r in requests for s in r], groups)
    out, at = [], 0
    for r in requests:
        out.append(flat[at : at + len(r)])
        at += len(r)
    return out


def group_count(lists: int, most: int = 128, from_lists: int = 8) -> int:
    """Groups for so many lists: one up to from_lists, then a power of two near the root, enough for `most` a group."""
    if lists <= from_lists:
        return 1
    near_root = 1 << ((lists.bit_length() - 1) // 2)
    return min(lists, max(-(-lists // most), near_root))


def split_counts(workers: int, parts: Sequence[int]) -> list[list[tuple[int, int]]]:
    """For each part its [start, stop) chunks; workers are shared in proportion, at least one for a part with work."""
    total = sum(parts)
    out = []
    for n in parts:
        chunks = max(1, round(workers * n / total)) if n else 0
        cuts = [n * i // chunks for i in range(chunks + 1)] if chunks else []
        out.append([(a, b) for a, b in zip(cuts, cuts[1:]) if b > a])
    return out
