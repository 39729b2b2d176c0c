"""Growing an index by micro-batches.

Each batch's rows are binned with the index's edges and appended; counts per cell are sums over the batches'
statistics, so batches may come in any order. A batch that Spark delivers again is recognised by its number, which is
part of the folder it is written to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridx.index import GridIndex
from gridx.operators.build import read_postings, read_stats, write_batch
from gridx.plans.catalog import IndexSpec


def append_stream(stream: DataFrame, spec: IndexSpec, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that appends every micro-batch under path."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        write_batch(batch, spec, path, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def open_stream_index(spark: SparkSession, spec: IndexSpec, path: str) -> GridIndex:
    """The index as of the batches written so far."""
    posts = {g: read_postings(spark, path, g) for g in spec.names}
    return GridIndex(spec, posts, read_stats(spark, path, spec))


def windowed_cells(events: DataFrame, spec: IndexSpec, group: str, time: str, window: str, late: str) -> DataFrame:
    """(window, cell, n): rows per cell and tumbling window of a stream, with late rows up to the watermark."""
    from gridx.functions.binning import bin_of, cell_of, numbers

    columns = spec.columns_of(group)
    value = numbers(events, columns)
    cell = cell_of([bin_of(value[c], spec.edges[c]) for c in columns], spec.shape(group))
    return events.withWatermark(time, late).groupBy(F.window(time, window), cell.alias("cell")).agg(F.count("*").alias("n"))
