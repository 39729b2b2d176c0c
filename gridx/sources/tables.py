"""Reading: projected tables, row ids, many files, flattened vectors, aligned schemas, result files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Files whose offsets are small enough to be broadcast.
MOST_FILES = 100_000


def table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def with_row_id(spark: SparkSession, paths: str | Sequence[str], name: str = "rid", columns: Sequence[str] | None = None) -> DataFrame:
    """Physical row numbers over one or many files, in the order of their names.

    The number is the row's place in its file plus the rows of the files before; the offsets, one row a file, come
    from file metadata and are joined by path. Up to MOST_FILES files, which Spark's file listing counts, the offsets
    are broadcast, so the table is neither sorted nor shuffled; beyond, it is shuffled by path.
    """
    paths = [paths] if isinstance(paths, str) else sorted(paths)
    raw = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    per_file = raw.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_file.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    chosen = list(columns) if columns else [c for c in raw.columns if not c.startswith("_")]
    return raw.join(F.broadcast(offsets) if len(raw.inputFiles()) <= MOST_FILES else offsets, "_file").select((F.col("_before") + F.col("_row")).cast("long").alias(name), *chosen)


def appended(frames: Sequence[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """All rows of tables with unlike columns: missing ones are NULL; no tables give an empty one."""
    if not frames:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def aligned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly the named columns with their types; missing ones are NULL."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


BANDS = ("u", "g", "r", "i", "z")


def flattened(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Array columns of fixed size as columns: five elements by band (_u _g _r _i _z), others by number; arrays of
    arrays are flattened first."""
    out = []
    for f in df.schema.fields:
        if f.name not in sizes:
            out.append(F.col(f.name))
            continue
        value, kind = F.col(f.name), f.dataType
        while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            value, kind = F.flatten(value), kind.elementType
        names = BANDS if sizes[f.name] == len(BANDS) else range(sizes[f.name])
        out += [F.get(value, F.lit(k)).alias(f"{f.name}_{n}") for k, n in enumerate(names)]
    return df.select(*out)


def run_results(spark: SparkSession, path: str, pattern: str = r"([^/]+)-(\d{8}T\d{6})\.json$") -> DataFrame:
    """JSON result files with the name and timestamp that their file names carry."""
    df = spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return df.withColumn("run", F.regexp_extract("file", pattern, 1)).withColumn("stamp", F.regexp_extract("file", pattern, 2))


def matched_results(results: DataFrame, statistics: DataFrame) -> DataFrame:
    """Results with the statistics of the same run and timestamp."""
    return results.join(statistics, ["run", "stamp"], "left")
