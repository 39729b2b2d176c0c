"""From a query to a plan: which groups to read, in which order, as what, with which strategy.

The planner asks the cell statistics one question, in one aggregate for all groups: how many rows does the query's
rectangle select in each grid. No grid is brought to the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridx.operators.requests import group_count
from gridx.plans.catalog import IndexSpec
from gridx.plans.predicates import Predicate, parse, rectangle

#: Above this selected share a group is read as its complement and subtracted.
EXCLUDE_ABOVE = 0.55
#: Above this estimated share of the table a scan is cheaper than reading postings.
SCAN_ABOVE = 0.3
STRATEGIES = ("semijoin", "count", "bitmap", "expand")


@dataclass(frozen=True)
class GroupPlan:
    name: str
    bins: tuple[tuple[int, int], ...]  # [low, high) of each column
    selected: int
    cells: int
    exclude: bool = False
    parts: int = 1  # parts into which the expand strategy deals the cells


@dataclass(frozen=True)
class ProbePlan:
    """What to do: `none` and `all` need no postings, `scan` filters the table, else the strategy over the groups."""

    predicates: tuple[Predicate, ...]
    groups: tuple[GroupPlan, ...]
    rows: int
    kind: str = "probe"
    strategy: str = "semijoin"
    options: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ProbePlan:
        raw = json.loads(text)
        raw["predicates"] = tuple(Predicate(**p) for p in raw["predicates"])
        raw["groups"] = tuple(GroupPlan(**g | {"bins": tuple(map(tuple, g["bins"]))}) for g in raw["groups"])
        return cls(**raw)


def inside(bins, names: list[Column]) -> Column:
    """Rows in the rectangle."""
    return reduce(lambda a, b: a & b, [n.between(low, high - 1) for n, (low, high) in zip(names, bins, strict=True)], F.lit(True))


def selected_rows(stats: DataFrame, spec: IndexSpec, predicates) -> dict[str, dict]:
    """For each group its rectangle, the rows and non-empty cells in it, and all its rows."""
    boxes = {g: rectangle(predicates, spec.columns_of(g), spec.edges) for g in spec.names}
    wanted = []
    for k, (g, box) in enumerate(boxes.items()):
        own = F.col("grp") == g
        hit = own & inside(box, [F.get("coords", F.lit(i)) for i in range(len(box))])
        wanted += [F.sum(F.when(hit, F.col("cardinality")).otherwise(0)).alias(f"s{k}"), F.count_if(hit).alias(f"c{k}"), F.sum(F.when(own, F.col("cardinality")).otherwise(0)).alias(f"n{k}")]
    row = stats.agg(*wanted).first()
    return {g: {"bins": tuple(box), "selected": row[f"s{k}"] or 0, "cells": row[f"c{k}"] or 0, "rows": row[f"n{k}"] or 0} for k, (g, box) in enumerate(boxes.items())}


def plan(spec: IndexSpec, stats: DataFrame, query: str, strategy: str = "semijoin", exclude_above: float = EXCLUDE_ABOVE, scan_above: float | None = None, exclude: tuple[str, ...] = (), parts: int | dict[str, int] | None = 1) -> ProbePlan:
    """Unselective groups are dropped, the others go by ascending selected rows; the first is always included.

    A contradiction selects nothing; a query that no group narrows selects all rows. `scan_above` turns on the
    comparison with a scan; `exclude` names groups to read as complements whatever their share. `parts` is for the
    expand strategy: of the first group, or by group; None chooses by the number of cells. A group that leaves rows
    out narrows a query on its columns even if all its cells are selected.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    predicates = tuple(parse(query))
    found = selected_rows(stats, spec, predicates)
    rows = max([x["rows"] for x in found.values()] + [spec.rows or 0])
    asked = {p.column for p in predicates}
    concerned = {g: bool(asked & set(spec.columns_of(g))) for g in found}
    if any(low >= high for x in found.values() for low, high in x["bins"]) or (rows and any(x["selected"] == 0 and concerned[g] for g, x in found.items())):
        return ProbePlan(predicates, (), rows, "none", strategy)
    narrow = sorted(((g, x) for g, x in found.items() if x["selected"] < (rows if concerned[g] else x["rows"])), key=lambda gx: (gx[1]["selected"], gx[0]))
    if not narrow:
        return ProbePlan(predicates, (), rows, "all", strategy)
    share = reduce(lambda a, b: a * b, [x["selected"] / rows for _, x in narrow], 1.0)
    out = []
    for k, (g, x) in enumerate(narrow):
        complete = x["rows"] == rows  # a complement may only be subtracted if the grid holds every row
        far = k > 0 and complete and (x["selected"] / x["rows"] > exclude_above or g in exclude)
        dealt = group_count(x["cells"]) if parts is None else parts.get(g, 1) if isinstance(parts, dict) else parts if k == 0 else 1
        out.append(GroupPlan(g, x["bins"], x["selected"], x["cells"], far, max(1, min(dealt, x["cells"]))))
    kind = "scan" if scan_above is not None and share > scan_above else "probe"
    return ProbePlan(predicates, tuple(sorted(out, key=lambda g: g.exclude)), rows, kind, strategy, {"estimated_share": share})
