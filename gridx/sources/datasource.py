"""A stored index as a Spark data source: `spark.read.format("gridx").option("path", ...)`.

The source has the postings of one group: the row id, the cell, and one column of bin numbers for each of the group's
columns, named after it. Comparisons of bins with numbers are pushed to the files, whose row-group statistics skip
cells that cannot match, and are left to Spark as well. The option `query` takes a range query on the table's values
and keeps the cells that can hold matching rows, a superset that the caller rechecks on the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, eq, ge, gt, le, lt

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridx.plans.catalog import IndexSpec
from gridx.plans.predicates import parse, rectangle

_TESTS = {EqualTo: eq, GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le}


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    """Options: path, group, spec (JSON), query (optional)."""

    def __init__(self, options: dict) -> None:
        self.spec = IndexSpec.from_json(options["spec"])
        self.group = options["group"]
        self.path = options["path"]
        self.query = options.get("query", "")
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        columns = ["rid", "cell", *self.spec.columns_of(self.group)]
        names = ["rid", "cell", *(f"b{i}" for i in range(len(columns) - 2))]
        for f in filters:
            test = _TESTS.get(type(f))
            if test and len(f.attribute) == 1 and f.attribute[0] in columns and isinstance(f.value, int):
                self.tests.append((names[columns.index(f.attribute[0])], test, f.value))
            yield f  # Spark evaluates every filter, too

    def partitions(self):
        return [_File(f) for f in sorted(ds.dataset(f"{self.path}/postings/{self.group}", format="parquet").files)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        columns = self.spec.columns_of(self.group)
        bins = [f"b{i}" for i in range(len(columns))]
        test = None
        if self.query:
            box = rectangle(parse(self.query), columns, self.spec.edges)
            test = reduce(and_, [(pc.field(b) >= low) & (pc.field(b) < high) for b, (low, high) in zip(bins, box, strict=True)])
        for name, compare, value in self.tests:
            one = compare(pc.field(name), value)
            test = one if test is None else test & one
        for batch in ds.dataset(partition.path, format="parquet").to_batches(columns=["rid", "cell", *bins], filter=test):
            yield batch.rename_columns(["rid", "cell", *columns])


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridx"

    def schema(self) -> str:
        spec = IndexSpec.from_json(self.options["spec"])
        return ", ".join(["rid long", "cell long", *[f"`{c}` int" for c in spec.columns_of(self.options["group"])]])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
