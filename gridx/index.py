"""The index as one object: build it, open it, plan a query, get ids, rows or counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridx.functions.binning import numbers, quantile_edges
from gridx.operators import build, probe
from gridx.plans import planner
from gridx.plans.catalog import IndexSpec
from gridx.plans.predicates import Unsupported, exact, parse


class GridIndex:
    """Posting tables by group, cell statistics and the configuration, stored or in memory."""

    def __init__(self, spec: IndexSpec, posts: dict[str, DataFrame], stats: DataFrame, table: DataFrame | None = None) -> None:
        self.spec, self.posts, self.stats, self.table = spec, posts, stats, table

    @classmethod
    def over(cls, df: DataFrame, groups: Sequence[Sequence[str]], bins: int = 5, rid: str = "rid", edges: dict | None = None, special: dict | None = None, accuracy: int | None = None, absent: Sequence[str] = ()) -> GridIndex:
        """An index that is computed from df whenever it is used; persist() keeps it in memory."""
        columns = list(dict.fromkeys(c for g in groups for c in g))
        edges = edges or quantile_edges(df, columns, bins, special, accuracy=accuracy)
        rows = df.count() if absent else None
        spec = IndexSpec(tuple(map(tuple, groups)), {c: list(map(float, edges[c])) for c in columns}, rid, special or {}, rows=rows, absent=tuple(absent))
        posts = build.all_postings(df, spec)
        return cls(spec, posts, build.cell_stats(posts))

    @classmethod
    def create(cls, df: DataFrame, path: str, groups: Sequence[Sequence[str]], bins: int = 5, rid: str = "rid", edges: dict | None = None, special: dict | None = None, compression: str = "zstd", overwrite: bool = False, accuracy: int | None = None, absent: Sequence[str] = (), clustered: bool = False) -> GridIndex:
        """An index stored under path; with clustered the table is stored too, in the order of the first group's cells."""
        columns = list(dict.fromkeys(c for g in groups for c in g))
        edges = edges or quantile_edges(df, columns, bins, special, accuracy=accuracy)
        spec = IndexSpec(tuple(map(tuple, groups)), {c: list(map(float, edges[c])) for c in columns}, rid, special or {}, compression=compression, absent=tuple(absent))
        full = build.write(df, spec, path, overwrite)
        if clustered:
            build.cluster(df, full, path)
        return cls.open(df.sparkSession, path, clustered)

    @classmethod
    def open(cls, spark: SparkSession, path: str, clustered: bool = False) -> GridIndex:
        """The index under path, once it is found whole."""
        spec = build.verify(spark, path)
        posts = {g: build.read_postings(spark, path, g) for g in spec.names}
        return cls(spec, posts, build.read_stats(spark, path, spec), spark.read.parquet(f"{path}/rows") if clustered else None)

    def persist(self) -> GridIndex:
        self.posts = {g: p.persist() for g, p in self.posts.items()}
        self.stats = self.stats.persist()
        return self

    def plan(self, query: str, **options) -> planner.ProbePlan:
        return planner.plan(self.spec, self.stats, query, **options)

    def ids(self, query: str | planner.ProbePlan, **options) -> DataFrame:
        """Ids of the selected cells, a superset of the query's."""
        return probe.ids(self.posts, self.spec, self._planned(query, options))

    def sorted_ids(self, query: str | planner.ProbePlan, **options) -> DataFrame:
        return self.ids(query, **options).orderBy("rid")

    def count(self, query: str | planner.ProbePlan, **options) -> DataFrame:
        return probe.count(self.posts, self.spec, self._planned(query, options))

    def rows(self, base: DataFrame | None, query: str | planner.ProbePlan, **options) -> DataFrame:
        """Exactly the rows of base that satisfy the query; any other filter text is evaluated by a scan.

        A clustered table is read instead of base: its order makes the pushed filter as selective as the cells, and no
        statistics need to be asked. Else the planner takes the scan where it expects more than a share of SCAN_ABOVE.
        """
        table = base if self.table is None else self.table
        try:
            if self.table is not None:
                predicates = query.predicates if isinstance(query, planner.ProbePlan) else parse(query)
                return table.where(exact(predicates, numbers(table, [p.column for p in predicates])))
            planned = self._planned(query, {"scan_above": planner.SCAN_ABOVE} | options)
        except Unsupported:
            return table.where(F.expr(query))
        return probe.refine(table, self.spec, self.posts, planned)

    def lists(self, group: str, bins: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        """(cell, cardinality, rids) of a group's cells, all or those in a rectangle."""
        p = self.posts[group]
        if bins is not None:
            p = p.where(planner.inside(bins, [F.col(f"b{i}") for i in range(len(bins))]))
        return build.posting_lists(p)

    def _planned(self, query, options) -> planner.ProbePlan:
        return query if isinstance(query, planner.ProbePlan) else self.plan(query, **options)
