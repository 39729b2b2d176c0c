"""Session helpers of the document operators: lineage cuts, sizing, tolerant column access."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of a bucketed exchange is sized for.
BUCKET_BYTES = 8 << 20
LAST_ID = (1 << 63) - 1
#: Rows of one key up to which a task may take them all; keys beyond one in FEW of all rows are fewer than FEW.
HOT, FEW = 256, 100_000
#: Rows up to which a narrow table is broadcast.
FEW_ROWS = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir, as a URI of the file system that Spark takes it for.

    Where that is unset, a local session, as in tests, gets a temporary folder; on a cluster that is an error, since
    driver and executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gridx-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return (f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this library's own, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and return it without its lineage.

    Shuffle files behind the cut are released once nothing refers to them.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of DataFrames that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string and the named columns; other columns, whatever their names, are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c] for c in more])


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts (0 if there are none): one aggregate over the text column."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def n_groups(n_bytes: int, each: int = BUCKET_BYTES, least: int = 64) -> int:
    """Number of hash groups for so many bytes, in proportion to the data."""
    return max(least, -(-n_bytes // each))


def broadcast_within(df: DataFrame, rows: int, most: int = FEW_ROWS) -> DataFrame:
    """A broadcast hint if df has at most `most` (counted) rows; beyond that Spark's shuffled join is used."""
    return F.broadcast(df) if rows <= most else df


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", n: int | None = None, most: int = FEW_ROWS) -> DataFrame:
    """rows joined with a table of one row a key; no key, however frequent in rows, gathers its rows in one task.

    A table of at most `most` rows (n, counted if not given) is broadcast. Beyond that, keys with more than HOT rows and
    more than one in FEW of all rows, of which there are at most FEW, meet their table rows by broadcast, the others
    by a shuffled join; rows is then read three times and should be a cut.
    """
    if (table.count() if n is None else n) <= most:
        return rows.join(F.broadcast(table), key, how)
    total = rows.count()
    hot = cut(rows.groupBy(key).agg(F.count("*").alias("n_of_key")).where(F.col("n_of_key") > max(HOT, total / FEW)).select(key))
    if not hot.limit(1).count():
        return rows.join(table, key, how)
    found = table.join(F.broadcast(hot), key, "left_semi")
    often = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    first = often.where("is_hot").drop("is_hot").join(F.broadcast(found), key, how)
    return first.unionByName(often.where("is_hot is null").drop("is_hot").join(table, key, how))
