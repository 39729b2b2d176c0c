"""Evaluating a plan over posting tables. All strategies return the same ids.

A group's lists are disjoint (each row is in one cell), so the union inside a group is a filter on its bins, which
reaches the Parquet scan. Between groups, ids are intersected, and complements subtracted:

semijoin  left-semi joins from the smallest group on, left-anti joins for complements
count     one aggregate over all included groups: an id qualifies if it occurs once in each
bitmap    ids become bitmaps of 32,768 in one row a bucket, which are ANDed; only full sets of groups count
expand    each group's cells may be dealt into parts; every combination of parts is intersected by itself, and the
          results, which are disjoint, are united; parts of a complement are subtracted one after the other
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridx.functions.binning import numbers
from gridx.plans.catalog import IndexSpec
from gridx.plans.planner import GroupPlan, ProbePlan, inside
from gridx.plans.predicates import exact

BUCKET = 32768
#: Ids that are broadcast at most: 8 bytes each, some 50 in the tasks' tables.
MOST_IDS = 1_000_000
#: Combinations of parts that one plan may hold.
MOST_TERMS = 256


def selected(posts: DataFrame, group: GroupPlan, complement: bool = False) -> DataFrame:
    """Ids of the group's selected cells, or of the others."""
    names = [F.col(f"b{i}") for i in range(len(group.bins))]
    box = inside(group.bins, names)
    return posts.where(~box if complement else box).select("rid")


def _within(ids: DataFrame, bound: int) -> DataFrame:
    """A broadcast hint for ids that are at most MOST_IDS, by the statistics' count of the cells they come from."""
    return F.broadcast(ids) if bound <= MOST_IDS else ids


def _subtract(ids: DataFrame, posts: dict[str, DataFrame], plan: ProbePlan) -> DataFrame:
    for g in plan.groups:
        if g.exclude:
            for own in _parts(posts, g, True):
                ids = ids.join(own, "rid", "left_anti")
    return ids


def _parts(posts: dict[str, DataFrame], group: GroupPlan, complement: bool = False) -> list[DataFrame]:
    """Ids of the group's selected cells (or of the others), dealt into its parts by cell."""
    if group.parts == 1:
        return [selected(posts[group.name], group, complement)]
    box = inside(group.bins, [F.col(f"b{i}") for i in range(len(group.bins))])
    rows = posts[group.name].where(~box if complement else box)
    return [rows.where(F.pmod("cell", F.lit(group.parts)) == k).select("rid") for k in range(group.parts)]


def _semijoin(posts: dict[str, DataFrame], plan: ProbePlan, included: list[GroupPlan]) -> DataFrame:
    return reduce(lambda ids, g: ids.join(_within(selected(posts[g.name], g), g.selected), "rid", "left_semi"), included[1:], selected(posts[included[0].name], included[0]))


def _count(posts, plan, included) -> DataFrame:
    every = reduce(DataFrame.unionAll, [selected(posts[g.name], g) for g in included])
    return every.groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") == len(included)).select("rid")


def bitmaps(ids: DataFrame) -> DataFrame:
    """(bucket, bitmap): ids, from 0, as one bitmap for each bucket."""
    shifted = ids.select((F.col("rid") + 1).alias("one"))
    return shifted.groupBy(F.bitmap_bucket_number("one").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("one")).alias("bitmap"))


def ids_of(buckets: DataFrame) -> DataFrame:
    """The ids in bitmaps: bytes that are set, then their bits."""
    byte = buckets.select("bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1))).alias("at"))
    value = F.conv(F.hex(F.expr("substring(bitmap, at + 1, 1)")), 16, 10).cast("int")
    full = byte.select("bucket", "at", value.alias("value")).where("value > 0")
    bit = full.select("bucket", "at", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("shiftright(value, bit) & 1 = 1")
    return bit.select(((F.col("bucket") - 1) * BUCKET + F.col("at") * 8 + F.col("bit")).cast("long").alias("rid"))


def _bitmap_buckets(posts, plan, included) -> DataFrame:
    every = reduce(DataFrame.unionAll, [bitmaps(selected(posts[g.name], g)) for g in included])
    found = every.groupBy("bucket").agg(F.count("*").alias("n"), F.expr("bitmap_and_agg(bitmap)").alias("bitmap"))
    return found.where(F.col("n") == len(included)).select("bucket", "bitmap")


def _expand(posts, plan, included) -> DataFrame:
    n = reduce(lambda a, g: a * g.parts, included, 1)
    if n > MOST_TERMS:
        raise ValueError(f"{n} combinations of parts; at most {MOST_TERMS} can be planned")
    terms = product(*[_parts(posts, g) for g in included])
    return reduce(DataFrame.unionAll, [reduce(lambda x, y: x.join(y, "rid", "left_semi"), t[1:], t[0]) for t in terms])


def ids(posts: dict[str, DataFrame], spec: IndexSpec, plan: ProbePlan) -> DataFrame:
    """The ids of the plan's cells: a superset of the query's rows, equal to them if bounds are bin edges."""
    complete = [g for g in spec.names if g not in spec.absent]
    if complete:
        any_posts = posts[complete[0]].select("rid")
    else:  # the rows that some group holds
        any_posts = reduce(DataFrame.unionAll, [p.select("rid") for p in posts.values()]).distinct()
    if plan.kind == "none":
        return any_posts.limit(0)
    if plan.kind == "all" or not plan.groups:
        return any_posts
    included = [g for g in plan.groups if not g.exclude]
    if plan.strategy == "bitmap":
        found = ids_of(_bitmap_buckets(posts, plan, included))
    else:
        found = {"semijoin": _semijoin, "count": _count, "expand": _expand}[plan.strategy](posts, plan, included)
    return _subtract(found, posts, plan)


def count(posts: dict[str, DataFrame], spec: IndexSpec, plan: ProbePlan) -> DataFrame:
    """One row: how many ids the plan selects, without building them where bitmaps can be counted."""
    if plan.kind == "probe" and plan.strategy == "bitmap" and not any(g.exclude for g in plan.groups):
        return _bitmap_buckets(posts, plan, list(plan.groups)).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("n"))
    return ids(posts, spec, plan).agg(F.count("*").alias("n"))


def read_only(posts: dict[str, DataFrame], plan: ProbePlan) -> DataFrame:
    """(grp, postings): what a probe would read from each group, complements for excluded ones."""
    parts = [selected(posts[g.name], g, g.exclude).agg(F.count("*").alias("postings")).select(F.lit(g.name).alias("grp"), "postings") for g in plan.groups]
    return reduce(DataFrame.unionAll, parts)


def refine(base: DataFrame, spec: IndexSpec, posts: dict[str, DataFrame], plan: ProbePlan) -> DataFrame:
    """The query's rows: index ids joined to the table, then the exact predicate; or the filter alone for a scan."""
    value = numbers(base, [p.column for p in plan.predicates])
    keep = exact(plan.predicates, value)
    if plan.kind in ("scan", "all"):
        return base.where(keep)
    rows = base.withColumn("rid", F.col(spec.rid).cast("long")) if spec.rid != "rid" else base
    bound = min((g.selected for g in plan.groups if not g.exclude), default=plan.rows)
    found = rows.join(_within(ids(posts, spec, plan), bound), "rid", "left_semi").where(keep)
    return found if spec.rid == "rid" else found.drop("rid")
