"""Building an index: one posting table per group, one table of cell cardinalities for all.

A posting is (b0, ..., cell, rid). Tables are range-partitioned by (cell, rid), so a cell that holds a large part of
all rows spreads over several tasks, and sorted the same way, so Parquet's row-group statistics prune by bin, cell
and rid, and ids compress as differences.

Under an index's folder lie postings/<group>/batch=<n>, stats/<group>/batch=<n> and config. The configuration is
published last and names the groups that are complete; anything else found under the folder is written again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridx.functions.binning import bin_of, cell_of, coordinates, numbers
from gridx.plans.catalog import COMPRESSIONS, IndexSpec


def postings(df: DataFrame, spec: IndexSpec, group: str) -> DataFrame:
    """(b0.., cell, rid): every row of df once, or every row without a NULL or NaN if the group leaves those out. Only
    the group's columns and the id are read."""
    columns = spec.columns_of(group)
    if group in spec.absent:
        df = without_absent(df, columns)
    value = numbers(df, columns)
    bins = df.select(*[bin_of(value[c], spec.edges[c]).alias(f"b{i}") for i, c in enumerate(columns)], F.col(spec.rid).cast("long").alias("rid"))
    names = [F.col(f"b{i}") for i in range(len(columns))]
    return bins.select(*names, cell_of(names, spec.shape(group)).alias("cell"), "rid")


def all_postings(df: DataFrame, spec: IndexSpec) -> dict[str, DataFrame]:
    return {g: postings(df, spec, g) for g in spec.names}


def cell_stats(posts: dict[str, DataFrame]) -> DataFrame:
    """(grp, cell, coords, cardinality, least and greatest rid) of all non-empty cells of all groups."""
    parts = []
    for g, p in posts.items():
        bins = [c for c in p.columns if c.startswith("b")]
        found = p.groupBy("cell", *bins).agg(F.count("*").alias("cardinality"), F.min("rid").alias("min_rid"), F.max("rid").alias("max_rid"))
        parts.append(found.select(F.lit(g).alias("grp"), "cell", F.array(*bins).alias("coords"), "cardinality", "min_rid", "max_rid"))
    return reduce(DataFrame.unionByName, parts)


def histogram(df: DataFrame, spec: IndexSpec, group: str) -> DataFrame:
    """(b0.., cell, cardinality) of the whole grid, empty cells included."""
    spark = df.sparkSession
    shape = spec.shape(group)
    total = reduce(lambda a, b: a * b, shape, 1)
    counts = postings(df, spec, group).groupBy("cell").agg(F.count("*").alias("cardinality"))
    grid = spark.range(total).withColumnRenamed("id", "cell")
    bins = [c.alias(f"b{i}") for i, c in enumerate(coordinates(F.col("cell"), shape))]
    return grid.join(counts, "cell", "left").select(*bins, "cell", F.coalesce("cardinality", F.lit(0)).cast("long").alias("cardinality"))


#: Ids that one row of a posting list may span.
LIST_SPAN = 1 << 20


def posting_lists(posts: DataFrame) -> DataFrame:
    """(cell, part, cardinality, rids): the sorted ids of each cell. A row holds ids of one span of LIST_SPAN, so a cell
    with very many ids is a list of rows, in order of part."""
    part = F.floor(F.col("rid") / LIST_SPAN).alias("part")
    return posts.groupBy("cell", part).agg(F.count("*").alias("cardinality"), F.sort_array(F.collect_list("rid")).alias("rids"))


def without_absent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of the columns is NULL or NaN: grids may leave rows out."""
    return df.dropna(subset=list(columns))


def laid_out(posts: DataFrame) -> DataFrame:
    return posts.repartitionByRange("cell", "rid").sortWithinPartitions("cell", "rid")


#: The batch of the rows that an index is made with; later ones count from 0.
FIRST = -1


def write_batch(df: DataFrame, spec: IndexSpec, path: str, batch: int, groups: Sequence[str] | None = None) -> None:
    """Postings and statistics of df's rows as one batch; the same batch again replaces what it wrote before."""
    spark = df.sparkSession
    for g in groups if groups is not None else spec.names:
        place = f"{path}/postings/{g}/batch={batch}"
        laid_out(postings(df, spec, g)).write.mode("overwrite").options(**COMPRESSIONS[spec.compression]).parquet(place)
        stats = cell_stats({g: spark.read.parquet(place)})
        stats.repartition(1).write.mode("overwrite").parquet(f"{path}/stats/{g}/batch={batch}")


def write(df: DataFrame, spec: IndexSpec, path: str, overwrite: bool = False) -> IndexSpec:
    """Posting tables, cell statistics and, last, the configuration under path.

    Groups that the stored configuration names stay, unless overwritten; that configuration must agree with the new
    one on the row id and on the edges of common columns. Complete groups must hold the same number of rows.
    """
    spark = df.sparkSession
    stored = None if overwrite else stored_spec(spark, path)
    if stored is not None:
        unlike = stored.agrees(spec)
        if unlike:
            raise ValueError(f"{path} holds an index with another configuration: {unlike}")
        if any(b != FIRST for b in batches(spark, path, stored)):
            raise ValueError(f"{path} has grown by batches; a new group would lack their rows")
        spec = stored.joined(spec)
    else:
        remove(spark, path)
    write_batch(df, spec, path, FIRST, [g for g in spec.names if stored is None or g not in stored.names])
    counts = {r["grp"]: r["n"] for r in read_stats(spark, path, spec).groupBy("grp").agg(F.sum("cardinality").alias("n")).collect()}  # one row a group
    complete = {g: counts.get(g, 0) for g in spec.names if g not in spec.absent}
    if len(set(complete.values())) > 1:
        raise ValueError(f"groups hold different numbers of rows: {complete}")
    rows = next(iter(complete.values())) if complete else df.count()
    full = IndexSpec(**{**spec.__dict__, "rows": rows})
    text = spark.createDataFrame([(full.to_json(),)], T.StructType([T.StructField("value", T.StringType())]))
    text.coalesce(1).write.mode("overwrite").text(f"{path}/config")
    return full


def append(df: DataFrame, spec: IndexSpec, path: str, batch: int = 0) -> None:
    """More rows for every group, with the index's edges, as batch number `batch`: batches come in any order, and one
    that is written again replaces itself."""
    write_batch(df, spec, path, batch)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def stored_spec(spark: SparkSession, path: str) -> IndexSpec | None:
    """The published configuration, None if there is none."""
    fs, place = _file_system(spark, f"{path}/config/_SUCCESS")
    return read_spec(spark, path) if fs.exists(place) else None


def batches(spark: SparkSession, path: str, spec: IndexSpec) -> set[int]:
    """Numbers of the batches of the first group: a listing of its folder."""
    fs, place = _file_system(spark, f"{path}/stats/{spec.names[0]}")
    return {int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(place) if "=" in x.getPath().getName()}


def read_spec(spark: SparkSession, path: str) -> IndexSpec:
    return IndexSpec.from_json(spark.read.text(f"{path}/config").first()["value"])


def read_postings(spark: SparkSession, path: str, group: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings/{group}").drop("batch")


def read_stats(spark: SparkSession, path: str, spec: IndexSpec) -> DataFrame:
    """Cell statistics, summed over the batches."""
    every = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/stats/{g}").drop("batch") for g in spec.names])
    return every.groupBy("grp", "cell", "coords").agg(F.sum("cardinality").alias("cardinality"), F.min("min_rid").alias("min_rid"), F.max("max_rid").alias("max_rid"))


def verify(spark: SparkSession, path: str) -> IndexSpec:
    """The configuration, if what lies under path is whole: every group has postings with its columns and statistics
    whose cells lie in its grid, and all complete groups hold the same rows. Else a ValueError says what is amiss."""
    spec = stored_spec(spark, path)
    if spec is None:
        raise ValueError(f"no index under {path}")
    for g in spec.names:
        wanted = [f"b{i}" for i in range(len(spec.columns_of(g)))] + ["cell", "rid"]
        for kind, names in (("postings", wanted), ("stats", ["cell", "cardinality"])):
            fs, place = _file_system(spark, f"{path}/{kind}/{g}")
            if not fs.exists(place):
                raise ValueError(f"{kind} of group {g} are missing")
            have = spark.read.parquet(f"{path}/{kind}/{g}").columns
            if not set(names) <= set(have):
                raise ValueError(f"{kind} of group {g} lack columns {sorted(set(names) - set(have))}")
    sums = read_stats(spark, path, spec).groupBy("grp").agg(F.sum("cardinality").alias("n"), F.max("cell").alias("last"))
    found = {r["grp"]: r for r in sums.collect()}  # one row a group
    for g, r in found.items():
        if r["last"] >= reduce(lambda a, b: a * b, spec.shape(g), 1):
            raise ValueError(f"group {g} has cells outside its grid")
    rows = {found[g]["n"] if g in found else 0 for g in spec.names if g not in spec.absent}
    if len(rows) > 1 or (rows and min(rows) < (spec.rows or 0)):
        raise ValueError(f"groups hold different numbers of rows: { {g: r['n'] for g, r in found.items()} }")
    return spec


def cluster(df: DataFrame, spec: IndexSpec, path: str, block_bytes: int = 4 << 20) -> None:
    """The table itself in the order of the first group's cells under path/rows, in small row groups, so that the
    exact predicate, pushed to the scan, skips what lies in other cells."""
    columns = spec.columns_of(spec.names[0])
    value = numbers(df, columns)
    cell = cell_of([bin_of(value[c], spec.edges[c]) for c in columns], spec.shape(spec.names[0]))
    placed = df.withColumn("_cell", cell).repartitionByRange("_cell", spec.rid).sortWithinPartitions("_cell", *columns).drop("_cell")
    placed.write.mode("overwrite").option("parquet.block.size", block_bytes).options(**COMPRESSIONS[spec.compression]).parquet(f"{path}/rows")
