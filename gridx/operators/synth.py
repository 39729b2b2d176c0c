"""Seeded generators: tables, cell distributions, benchmark rows, random range queries.

Row generators are DataFrame expressions whose randomness is an MD5 of (seed, row, purpose), so results do not depend
on partitioning and any SQL engine can repeat them. Distributions over one grid's cells are small arrays made on the driver and returned as tables.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridx.plans.predicates import Predicate, render

if TYPE_CHECKING:
    from gridx.index import GridIndex


#: Hexadecimal digits of the MD5 that make a random number, and how many such numbers there are.
DIGITS, NUMBERS = 13, float(1 << 52)


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends on the seed and the keys alone."""
    name = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("double") + 0.5) / NUMBERS


def chance(seed: int, *keys) -> float:
    """The same number on the driver."""
    name = "|".join(str(x) for x in (seed, *keys))
    return (int(hashlib.md5(name.encode()).hexdigest()[:DIGITS], 16) + 0.5) / NUMBERS


def column_names(n: int) -> list[str]:
    """A..Z for up to 26 columns, else AA, AB, ..."""
    letters = [chr(65 + i) for i in range(26)]
    return letters[:n] if n <= 26 else ["".join(p) for p in itertools.islice(itertools.product(letters, repeat=2), n)]


def uniform_table(spark: SparkSession, rows: int, dims: int, seed: int = 0, high: float = 100.0) -> DataFrame:
    """rid and `dims` columns, each uniform on (0, high)."""
    base = spark.range(rows).withColumnRenamed("id", "rid")
    return base.select("rid", *[(uniform(seed, "rid", F.lit(k)) * high).alias(c) for k, c in enumerate(column_names(dims))])


# ------------------------------------------------------------------------------------------------------- sampling
def gumbel_top(df: DataFrame, weight: str, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows without replacement, by weight: the greatest log weight plus Gumbel noise."""
    noise = -F.log(-F.log(uniform(seed, key)))
    return df.where(F.col(weight) > 0).orderBy((F.log(weight) + noise).desc(), key).limit(k)


def reservoir_top(df: DataFrame, weight: str, k: int | Column, key: str, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """k rows without replacement (within each `by` group, k may be a column): the greatest u ** (1 / weight)."""
    rank = F.log(uniform(seed, key, *by)) / F.col(weight)
    df = df.where(F.col(weight) > 0)
    if not by:
        return df.orderBy(rank.desc(), key).limit(k)
    w = Window.partitionBy(*by).orderBy(rank.desc(), key)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(uniform(seed, key), key)


# -------------------------------------------------------------------------------------------------- distributions
def shells(dims: int, bins: int) -> dict[int, np.ndarray]:
    """For each shell, the rounded distance of a cell from the grid's centre: its cells by their place on one axis."""
    squares = [(i - (bins - 1) / 2) ** 2 for i in range(bins)]
    rest = Counter({0.0: 1})  # squared distances over all axes but one
    for _ in range(dims - 1):
        rest = _summed(rest, squares)
    out: dict[int, np.ndarray] = {}
    for place, square in enumerate(squares):
        for d2, n in rest.items():
            out.setdefault(round(math.sqrt(d2 + square)), np.zeros(bins))[place] += n
    return out


def _summed(counts: Counter, squares: Sequence[float]) -> Counter:
    out: Counter = Counter()
    for d2, n in counts.items():
        for square in squares:
            out[d2 + square] += n
    return out


def nonnegative_solution(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray | None:
    """x >= 0 with a @ x = b, by active sets of least squares; None if there is none."""
    n = a.shape[1]
    active, x = np.zeros(n, bool), np.zeros(n)
    for _ in range(10 * n + 10):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if np.abs(a @ x - b).max() < tolerance:
            return x
        if gain.max() < tolerance:
            return None
        active[int(gain.argmax())] = True
        while active.any():
            trial = np.zeros(n)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if trial[active].min() > 0:
                x = trial
                break
            low = active & (trial <= 0)
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x = x + step * (trial - x)
            active &= x > tolerance
            x[~active] = 0
    return None


def radial_shells(dims: int, bins: int, max_shell: int | None = None) -> dict[int, float]:
    """The probability of one cell of each shell (0 beyond max_shell): alike inside a shell, uniform along every axis.

    The shells' probabilities solve one equation for each place on an axis (all axes are alike); a ValueError says
    that no probabilities do.
    """
    by = {r: n for r, n in shells(dims, bins).items() if max_shell is None or r <= max_shell}
    names = sorted(by)
    found = nonnegative_solution(np.array([by[r] for r in names]).T, np.full(bins, 1.0 / bins))
    if found is None:
        raise ValueError(f"no distribution over shells up to {max_shell} has uniform marginals")
    return dict(zip(names, found.tolist(), strict=True))


def radial_distribution(spark: SparkSession, dims: int, bins: int, max_shell: int | None = None) -> DataFrame:
    """(cell, p) of the whole grid under radial_shells; cells are made and weighed where they are."""
    p = radial_shells(dims, bins, max_shell)
    cells = spark.range(bins**dims).withColumnRenamed("id", "cell")
    offsets = [F.pmod(F.floor(F.col("cell") / bins**k), F.lit(bins)) - (bins - 1) / 2 for k in range(dims)]
    shell = F.bround(F.sqrt(sum((x * x for x in offsets), F.lit(0.0)))).cast("int")
    weights = F.create_map(*[x for r, v in p.items() for x in (F.lit(r), F.lit(v))])
    return cells.select("cell", F.coalesce(F.try_element_at(weights, shell), F.lit(0.0)).alias("p"))


def shell_prior(dims: int, bins: int, decay: float = 1.0) -> np.ndarray:
    """Weights that fall with the rounded distance of a cell from the grid's centre."""
    axes = np.indices((bins,) * dims) - (bins - 1) / 2
    return np.exp(-decay * np.round(np.sqrt((axes**2).sum(axis=0))))


def cluster_prior(dims: int, bins: int, centers: Sequence[Sequence[float]], sigma: float, crop: float = 0.0) -> np.ndarray:
    """A mixture of Gaussian bumps around centres (in bins); cells under `crop` times the greatest get 0."""
    axes = np.indices((bins,) * dims).reshape(dims, -1).T
    p = sum(np.exp(-((axes - np.asarray(c)) ** 2).sum(axis=1) / (2 * sigma**2)) for c in centers)
    p[p < crop * p.max()] = 0
    return (p / p.sum()).reshape((bins,) * dims)


def uniform_marginals(prior: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """The distribution nearest to the prior (in relative entropy) with uniform one-dimensional marginals.

    Each round scales the slices of one axis after the other to equal mass, which converges to the projection.
    """
    p = prior / prior.sum()
    for _ in range(rounds):
        worst = 0.0
        for axis in range(p.ndim):
            marginal = p.sum(axis=tuple(i for i in range(p.ndim) if i != axis))
            if (marginal == 0).any():
                raise ValueError("a slice of the prior is empty")
            worst = max(worst, float(np.abs(marginal * len(marginal) - 1).max()))
            p = p / (marginal * len(marginal)).reshape([-1 if i == axis else 1 for i in range(p.ndim)])
        if worst < tolerance:
            break
    return p


def distribution_table(spark: SparkSession, p: np.ndarray, above: float = 0.0) -> DataFrame:
    """(cell, p) of cells with more than `above`; cells are numbered row-major."""
    flat = p.reshape(-1)
    at = np.flatnonzero(flat > above)
    return spark.createDataFrame([(int(i), float(flat[i])) for i in at], "cell long, p double")


def conditioned(distribution: DataFrame, inside: Column) -> DataFrame:
    """(cell, p, mass): the distribution inside a region, scaled to 1; mass is what the region had."""
    own = distribution.where(inside).withColumn("p", F.nanvl("p", F.lit(0.0)))
    total = F.sum("p").over(Window.partitionBy())
    return own.select("cell", (F.col("p") / total).alias("p"), total.alias("mass"))


def cumulative(distribution: DataFrame) -> DataFrame:
    """(cell, low, high): the cells' places on [0, 1), in cell order."""
    w = Window.orderBy("cell")
    high = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = distribution.select("cell", "p", high.alias("high"))
    return found.select("cell", F.coalesce(F.lag("high").over(w), F.lit(0.0)).alias("low"), "high").where("high > low")


#: Steps of the draw by which rows and cells meet, and cells up to which their table is broadcast.
STEPS, MOST_CELLS = 1024, 200_000


def sample_cells(rows: DataFrame, distribution: DataFrame, key: str, name: str, seed: int) -> DataFrame:
    """rows with a random cell each: the inverse of the cumulative distribution.

    A cell stands in every step of [0, 1) that its place touches, so rows find theirs by an equality of steps, among
    the few cells of one step; the cells are broadcast up to a counted number.
    """
    cdf = cumulative(distribution)
    facts = cdf.agg(F.max("high").alias("top"), F.count("*").alias("n")).first()
    top = facts["top"]
    step = lambda x: F.floor(x / top * STEPS)
    places = cdf.select(F.col("cell").alias(name), "low", F.when(F.col("high") == top, 2.0 * top).otherwise(F.col("high")).alias("high"))
    spread = places.withColumn("step", F.explode(F.sequence(step(F.col("low")), step(F.least("high", F.lit(top))))))
    drawn = rows.withColumn("draw", uniform(seed, key, F.lit(name)) * top).withColumn("step", step(F.col("draw")))
    spread = F.broadcast(spread) if facts["n"] <= MOST_CELLS else spread
    return drawn.join(spread, "step").where((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high"))).drop("draw", "low", "high", "step")


# ----------------------------------------------------------------------------------------------------- benchmarks
def subset_sizes(weights: Sequence[float], draws: int = 10_000, seed: int = 0) -> np.ndarray:
    """Probabilities of subset sizes 1..n-1 under which weighted subsets include each grid in proportion to its weight.

    How often each grid is in a weighted subset of each size is estimated by drawing; the sizes' probabilities are
    the least squares fit within [0, 1], by projected gradient steps, scaled to 1. One grid has the one size 1.
    """
    n = len(weights)
    if n == 1:
        return np.ones(1)
    target = np.asarray(weights, float) / np.sum(weights)
    rng = np.random.default_rng(seed)
    included = np.zeros((n, n - 1))
    for k in range(1, n):
        chosen = np.argsort(-(np.log(target) + rng.gumbel(size=(draws, n))), axis=1)[:, :k]
        included[:, k - 1] = np.bincount(chosen.reshape(-1), minlength=n) / draws
    q = np.full(n - 1, 1.0 / (n - 1))
    step = 1.0 / max(1e-9, np.linalg.norm(included, 2) ** 2)
    for _ in range(4000):
        q = np.clip(q - step * included.T @ (included @ q - target), 0, 1)
    return q / q.sum()


def permuted(row: Column, rows: int, seed: int = 0) -> Column:
    """A permutation of 0..rows-1, as an expression: no row moves to get its place."""
    if rows < 2:
        return row
    factor = 1 + int(chance(seed, "factor") * (min(rows, 1 << 31) - 1))
    while math.gcd(factor, rows) != 1:
        factor += 1
    return F.pmod(row * factor + int(chance(seed, "start") * rows), F.lit(rows)).cast("long")


def benchmark_rows(spark: SparkSession, grids: dict[str, DataFrame], masses: dict[str, float], rows: int, share: float, seed: int = 0, sampler: Callable | None = None, start: int = 0, shuffle: bool = True) -> DataFrame:
    """rid (from `start`) and a cell for each grid: ceil(T * rows) rows lie in every grid's region, the others in some.

    T is `share` times the least mass. The others ("drag") have one grid at least and not all, among the grids of
    more than the least volume T, chosen by what each still needs; a grid that is not chosen leaves its cell NULL. If
    no grid needs more, they are in none.
    With `shuffle` the two kinds are mixed by a permutation of the ids. `sampler` may replace the weighted choice.
    """
    if not 0 <= share <= 1:
        raise ValueError("the share of the largest intersection lies between 0 and 1")
    names = list(grids)
    t = share * min(masses.values())
    core = math.ceil(t * rows)
    base = spark.range(rows).withColumnRenamed("id", "rid")
    place = (permuted(F.col("rid"), rows, seed) if shuffle else F.col("rid")) + start
    whole = base.where(F.col("rid") < core)
    for g in names:
        whole = sample_cells(whole, grids[g], "rid", g, seed)
    need = {g: masses[g] - t for g in names if masses[g] - t > 1e-12}
    out = whole.select(place.alias("rid"), *names)
    drag = base.where(F.col("rid") >= core)
    if core >= rows:
        return out
    if not need:  # no grid has volume left
        return out.unionByName(drag.select(place.alias("rid"), *[F.lit(None).cast("long").alias(g) for g in names]))
    q = subset_sizes(list(need.values()), seed=seed)
    steps = np.cumsum(q)
    size = F.lit(len(q))
    for k in range(len(q) - 2, -1, -1):
        size = F.when(uniform(seed, "rid", F.lit("size")) < float(steps[k]), F.lit(k + 1)).otherwise(size)
    choice = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.lit(w).alias("weight")) for g, w in need.items()])).alias("c")
    options = drag.select("rid", size.alias("k"), choice).select("rid", "k", "c.grid", "c.weight")
    chosen = (sampler or (lambda d: reservoir_top(d, "weight", F.col("k"), "grid", seed, by=["rid"])))(options)
    flags = chosen.groupBy("rid").agg(*[F.max(F.col("grid") == g).alias(f"in_{g}") for g in names])
    drag = drag.join(flags, "rid", "left")
    for g in names:
        drag = sample_cells(drag, grids[g], "rid", g, seed + 1).withColumn(g, F.when(F.coalesce(F.col(f"in_{g}"), F.lit(False)), F.col(g)))
    return out.unionByName(drag.select(place.alias("rid"), *names))


def benchmark_sweep(spark: SparkSession, grids, masses, rows: int, shares: Sequence[float], seed: int = 0, path: str | None = None, shape: dict[str, int] | None = None) -> dict[float, DataFrame | GridIndex]:
    """One benchmark table for each share of rows in the intersection; with a path, an index stored over each instead.

    Such an index has a group and a cell axis for each grid, of shape[grid] cells, and leaves out its NULL rows.
    """
    tables = {s: benchmark_rows(spark, grids, masses, rows, s, seed) for s in shares}
    if path is None:
        return tables
    from gridx.index import GridIndex

    edges = {g: [float(c) for c in range(1, shape[g])] for g in grids}
    return {s: GridIndex.create(df, f"{path}/share={s}", [(g,) for g in grids], edges=edges, absent=list(grids), overwrite=True) for s, df in tables.items()}


# -------------------------------------------------------------------------------------------------------- queries
def shifts(boxes: dict[str, tuple[int, int]], bins: dict[str, int], seed: int, number: int = 0) -> dict[str, int]:
    """By how much each column's bins [low, high) move to a random place inside the grid."""
    outside = [c for c, (low, high) in boxes.items() if low < 0 or high > bins[c]]
    if outside:
        raise ValueError(f"boxes leave the grid in {outside}")
    return {c: math.floor(chance(seed, number, c) * (bins[c] - high + low + 1)) - low for c, (low, high) in boxes.items()}


def moved(boxes: dict[str, tuple[int, int]], shift: dict[str, int]) -> dict[str, tuple[int, int]]:
    return {c: (low + shift[c], high + shift[c]) for c, (low, high) in boxes.items()}


def random_partitions(spark: SparkSession, columns: Sequence[str], sizes: Sequence[int], n: int, seed: int = 0, trials: int = 1000) -> DataFrame:
    """(number, groups): n different partitions of the columns into groups of the given sizes.

    A trial ranks the columns by a hash and cuts the ranking at the sizes; groups and their members are put in
    order, so that equal partitions are equal arrays, and the first n different ones are numbered.
    """
    if sum(sizes) != len(columns):
        raise ValueError("sizes must add up to the number of columns")
    ends = list(itertools.accumulate(sizes))
    every = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.array(*[F.lit(c) for c in columns])).alias("name"))
    rank = F.row_number().over(Window.partitionBy("trial").orderBy(uniform(seed, "trial", "name"), "name"))
    group = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        group = F.when(F.col("rank") <= ends[k], k).otherwise(group)
    members = every.withColumn("rank", rank).groupBy("trial", group.alias("grp")).agg(F.concat_ws("-", F.sort_array(F.collect_list("name"))).alias("members"), F.count("*").alias("n"))
    whole = members.groupBy("trial").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "members"))), lambda x: x["members"]).alias("groups"))
    found = whole.groupBy("groups").agg(F.min("trial").alias("trial")).orderBy("trial").limit(n)
    if found.count() < n:
        raise ValueError(f"{trials} trials give fewer than {n} different partitions")
    return found.select((F.row_number().over(Window.orderBy("trial")) - 1).alias("number"), "groups")


def random_boxes(edges: dict[str, Sequence[float]], selectivity: float | dict[str, float], seed: int, number: int = 0) -> dict[str, tuple[int, int]]:
    """floor(selectivity * bins), at least one, consecutive bins of each column, at a random place."""
    bins = {c: len(e) + 1 for c, e in edges.items()}
    share = selectivity if isinstance(selectivity, dict) else dict.fromkeys(edges, selectivity)
    boxes = {c: (0, max(1, math.floor(share[c] * n))) for c, n in bins.items() if c in share}
    return moved(boxes, shifts(boxes, bins, seed, number))


def random_queries(edges: dict[str, Sequence[float]], selectivity: float | dict[str, float], n: int, seed: int = 0) -> list[str]:
    """Query texts whose bounds are bin edges."""
    out = []
    for number in range(n):
        terms = []
        for c, (low, high) in random_boxes(edges, selectivity, seed, number).items():
            full = [None, *edges[c], None]
            terms += [Predicate(c, op, float(full[b])) for op, b in ((">=", low), ("<", high)) if full[b] is not None]
        out.append(render(terms))
    return out


def grid_neighbours(spark: SparkSession, shape: Sequence[int], diagonal: bool = False) -> DataFrame:
    """(cell, other): cells one step apart, along axes or also diagonally; made by steps, not by comparing cells."""
    total = math.prod(shape)
    cells = spark.range(total).withColumnRenamed("id", "cell")
    strides = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(shape)) if any(s) and (diagonal or sum(map(abs, s)) == 1)]
    coordinates = [F.pmod(F.floor(F.col("cell") / st), F.lit(n)) for st, n in zip(strides, shape, strict=True)]
    options = []
    for s in steps:
        ok = F.lit(True)
        for c, d, n in zip(coordinates, s, shape, strict=True):
            ok = ok & (c + d >= 0) & (c + d < n)
        options.append(F.when(ok, F.col("cell") + sum(d * st for d, st in zip(s, strides, strict=True))))
    return cells.select("cell", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("other"))
