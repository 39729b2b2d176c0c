"""Writing: tables in bounded files, plans and statistics as text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gridx.plans.planner import ProbePlan


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, in a local session without one,
    a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/gridx-{name}-{uuid.uuid4().hex}"


def parquet(df: DataFrame, path: str, rows_per_file: int = 0, compression: str = "snappy", mode: str = "error") -> None:
    """A Parquet table; with rows_per_file no file has more rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", compression).parquet(path)


def plans(spark: SparkSession, found: Sequence[ProbePlan], path: str) -> None:
    """Plans as lines of JSON, to be run elsewhere."""
    spark.createDataFrame([(p.to_json(),) for p in found], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_plans(spark: SparkSession, path: str) -> list[ProbePlan]:
    return [ProbePlan.from_json(r["value"]) for r in spark.read.text(path).collect()]  # as many as were written


def report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small report as JSON lines or CSV with a header, in one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def plan_text(df: DataFrame) -> str:
    """Spark's formatted plan of a DataFrame."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
