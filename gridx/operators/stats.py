"""Statistics of an index, of queries on it, and of measured runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridx.functions.binning import bin_of, numbers
from gridx.plans.catalog import IndexSpec
from gridx.plans.planner import inside
from gridx.plans.predicates import exact, parse, rectangle


def group_selectivity(stats: DataFrame, spec: IndexSpec, query: str) -> DataFrame:
    """(grp, selected, cells, rows, share) of each group, by ascending selected rows; sums over the statistics alone."""
    predicates = parse(query)
    parts = []
    for g in spec.names:
        box = rectangle(predicates, spec.columns_of(g), spec.edges)
        hit = inside(box, [F.get("coords", F.lit(i)) for i in range(len(box))])
        own = stats.where(F.col("grp") == g)
        parts.append(own.agg(F.coalesce(F.sum(F.when(hit, F.col("cardinality"))), F.lit(0)).alias("selected"), F.count_if(hit).alias("cells"), F.sum("cardinality").alias("rows")).withColumn("grp", F.lit(g)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("grp", "selected", "cells", "rows", (F.col("selected") / F.col("rows")).alias("share"))


def selectivity_report(df: DataFrame, spec: IndexSpec, query: str) -> DataFrame:
    """One row: rows, exact rows, index rows, and the false-positive rate (index - exact) / index; one pass over df."""
    predicates = parse(query)
    value = numbers(df, list(dict.fromkeys(c for g in spec.groups for c in g)))
    hit = F.lit(True)
    for g in spec.names:
        columns = spec.columns_of(g)
        hit = hit & inside(rectangle(predicates, columns, spec.edges), [bin_of(value[c], spec.edges[c]) for c in columns])
    keep = exact(predicates, numbers(df, [p.column for p in predicates]))
    found = df.agg(F.count("*").alias("n_rows"), F.count_if(keep).alias("exact_rows"), F.count_if(hit).alias("index_rows"))
    rate = F.when(F.col("index_rows") > 0, (F.col("index_rows") - F.col("exact_rows")) / F.col("index_rows")).otherwise(F.lit(0.0))
    return found.withColumn("false_positive_rate", rate)


def cell_entropy(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Base-2 entropy of how often each cardinality occurs, and the share of empty cells."""
    counts = histogram.groupBy(*by, "cardinality").agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by)
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(total))
    return p.groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.coalesce(F.sum(F.when(F.col("cardinality") == 0, F.col("p"))), F.lit(0.0)).alias("empty_share"))


def index_statistics(stats: DataFrame, spec: IndexSpec) -> DataFrame:
    """(grp, shape, cells, filled, rows, greatest and mean cardinality) of each group."""
    found = stats.groupBy("grp").agg(F.count("*").alias("filled"), F.sum("cardinality").alias("rows"), F.max("cardinality").alias("max_cardinality"), F.avg("cardinality").alias("mean_cardinality"))
    cells = F.create_map(*[x for g in spec.names for x in (F.lit(g), F.lit(reduce(lambda a, b: a * b, spec.shape(g), 1)))])
    shape = F.create_map(*[x for g in spec.names for x in (F.lit(g), F.lit("x".join(map(str, spec.shape(g)))))])
    return found.withColumn("cells", F.element_at(cells, F.col("grp")).cast("long")).withColumn("shape", F.element_at(shape, F.col("grp")))


#: Bytes of an id in a plain list, and of a page.
ID_BYTES, PAGE_BYTES = 4, 4096


def volumes(stats: DataFrame, spec: IndexSpec, query: str = "") -> DataFrame:
    """(grp, cells, ids, id_bytes, page_bytes, padding, density): what the query's cells, all without one, take as
    plain lists of ids, each rounded up to pages; the share of padding in that; and filled cells of the rectangle's."""
    predicates = parse(query)
    parts = []
    for g in spec.names:
        box = rectangle(predicates, spec.columns_of(g), spec.edges)
        hit = inside(box, [F.get("coords", F.lit(i)) for i in range(len(box))])
        size = F.col("cardinality") * ID_BYTES
        paged = F.ceil(size / PAGE_BYTES) * PAGE_BYTES
        all_cells = reduce(lambda a, b: a * b, [max(0, high - low) for low, high in box], 1)
        sums = stats.where((F.col("grp") == g) & hit).agg(F.count("*").alias("cells"), F.coalesce(F.sum("cardinality"), F.lit(0)).alias("ids"), F.coalesce(F.sum(size), F.lit(0)).alias("id_bytes"), F.coalesce(F.sum(paged), F.lit(0)).alias("page_bytes"))
        parts.append(sums.select(F.lit(g).alias("grp"), "*", F.try_divide(F.col("page_bytes") - F.col("id_bytes"), "page_bytes").alias("padding"), (F.col("cells") / F.lit(all_cells)).alias("density")))
    return reduce(DataFrame.unionByName, parts)


def index_sizes(spark: SparkSession, path: str, stats: DataFrame, spec: IndexSpec) -> DataFrame:
    """(grp, files, bytes, id_bytes, page_bytes, saved): the stored postings beside plain lists; saved is the share
    of the lists' pages that the stored form does not need."""
    found = stored_bytes(spark, path).join(volumes(stats, spec).select("grp", "ids", "id_bytes", "page_bytes"), "grp")
    return found.withColumn("saved", 1 - F.try_divide("bytes", "page_bytes"))


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(grp, files, bytes) of an index's posting files, from file listings."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/postings").select("path", "length")
    group = F.regexp_extract("path", r"/postings/([^/]+)/", 1)
    return listed.groupBy(group.alias("grp")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def usage(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def shell_counts(spark: SparkSession, dims: int, bins: int) -> DataFrame:
    """(shell, n): grid cells by rounded (half to even) distance from the grid's centre."""
    squares = Counter(((i - (bins - 1) / 2) ** 2) for i in range(bins))
    axis = F.array(*[F.struct(F.lit(d).alias("d2"), F.lit(n).cast("long").alias("n2")) for d, n in sorted(squares.items())])
    rows = spark.range(1).select(F.lit(0.0).alias("d"), F.lit(1).cast("long").alias("n"))
    for _ in range(dims):  # distances add up axis by axis, so equal sums are counted together
        steps = rows.select("d", "n", F.explode(axis).alias("s"))
        rows = steps.groupBy((F.col("d") + F.col("s.d2")).alias("d")).agg(F.sum(F.col("n") * F.col("s.n2")).alias("n"))
    return rows.groupBy(F.bround(F.sqrt("d")).cast("long").alias("shell")).agg(F.sum("n").cast("long").alias("n"))


def group_mean(df: DataFrame, by: Sequence[str], values: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])
    return out.orderBy(*order) if order else out


def mean_std(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation side by side, in one aggregate; a NULL key is a group."""
    return df.groupBy(*by).agg(*[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))])


def aggregate(df: DataFrame, by: Sequence[str], value: str, how: str) -> DataFrame:
    """One of min, max, mean, median, sum, count, std of a value by keys; NULL keys are kept."""
    functions = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count, "std": F.stddev_samp}
    return df.groupBy(*by).agg(functions[how](value).alias(value))


def pivot_tasks(tasks: DataFrame, types: Sequence[str], row: str = "worker_id", column: str = "type", value: Column | None = None) -> DataFrame:
    """One row a worker and one column a task type: counts, or sums of a value; 0 where there are none."""
    value = F.lit(1) if value is None else value
    return tasks.groupBy(row).agg(*[F.coalesce(F.sum(F.when(F.col(column) == t, value)), F.lit(0)).alias(t) for t in types])


def utilisation(tasks: DataFrame) -> DataFrame:
    """One row: workers, busy and wall time, utilisation, and the type of the longest task."""
    ns = F.col("stop_ns") - F.col("start_ns")
    wall = F.max("stop_ns") - F.min("start_ns")
    return tasks.agg(F.count_distinct("worker_id").alias("workers"), F.sum(ns).alias("busy_ns"), wall.alias("wall_ns"), F.max_by("type", ns).alias("longest_type")).withColumn("utilisation", F.col("busy_ns") / (F.col("workers") * F.col("wall_ns")))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(name, n_distinct, constant): NULLs do not count as a value."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in names])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_distinct")) for c in names])).alias("x")
    return counts.select(rows).select("x.name", "x.n_distinct", (F.col("x.n_distinct") <= 1).alias("constant"))


def without_constant_columns(df: DataFrame) -> DataFrame:
    constant = {r["name"] for r in constant_columns(df).collect() if r["constant"]}  # one row a column
    return df.select(*[c for c in df.columns if c not in constant])


def summed(maps: DataFrame, column: str) -> DataFrame:
    """(key, value): a map column summed by key over all rows."""
    return maps.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))


def deltas(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The value's difference to the row before (the first keeps its value)."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undeltas(df: DataFrame, delta: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Running sums: the inverse of deltas."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum(delta).over(w))
