import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridx.functions import binning


def test_edges_belong_to_the_bin_above(spark):
    edges = [1.0, 2.0, 5.0]
    values = [-math.inf, 0.0, math.nextafter(1.0, 0), 1.0, math.nextafter(1.0, 2), 2.0, 4.9, 5.0, math.inf, math.nan, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in rows.select("i", binning.bin_of(F.col("v"), edges).alias("b")).orderBy("i").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3, 3]
    assert got == [binning.bin_number(v, edges) for v in values]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_tree_of_any_size(spark, n):
    edges = [float(i) for i in range(n)]
    rows = spark.range(-2, n + 2).select(F.col("id").cast("double").alias("v"))
    assert all(r["b"] == binning.bin_number(r["v"], edges) for r in rows.select("v", binning.bin_of(F.col("v"), edges).alias("b")).collect())


def test_quantile_edges_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(size=500)
    df = spark.createDataFrame([(float(v), 3.0 if i % 2 else None) for i, v in enumerate(x)] + [(math.nan, 3.0)], "x double, c double")
    edges = binning.quantile_edges(df, ["x", "c"], 8)
    assert np.allclose(edges["x"], np.quantile(x, np.linspace(0, 1, 9)[1:-1]))
    assert edges["c"] == [3.0]


def test_special_values_get_bins(spark):
    values = [-999.0] * 50 + [0.0] * 40 + [float(v) for v in range(1, 101)] + [-5.0, -4.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    edges = binning.quantile_edges(df, ["x"], 6, {"x": [-999.0, 0.0]})["x"]
    own = {s: {binning.bin_number(v, edges) for v in values if v != s} for s in (-999.0, 0.0)}
    for s, others in own.items():
        assert binning.bin_number(s, edges) not in others
    assert -999 + (-5 + 999) / 2 in edges and 0.5 in edges


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "="])
def test_bins_for_is_tight_and_complete(op):
    edges = [1.0, 2.0, 3.0]
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}[op]
    grid = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5]
    for v in grid:
        low, high = binning.bins_for(op, v, edges)
        hit = {binning.bin_number(x, edges) for x in grid + [0.0, 4.0] if compare(x, v)}
        assert hit <= set(range(low, high))


def test_cells_and_coordinates(spark):
    shape = [3, 4, 2]
    df = spark.range(24).select(F.col("id").alias("cell"), *[c.alias(f"b{i}") for i, c in enumerate(binning.coordinates(F.col("id"), shape))])
    for r in df.withColumn("again", binning.cell_of([F.col("b0"), F.col("b1"), F.col("b2")], shape)).collect():
        assert (r["b0"], r["b1"], r["b2"]) == tuple(int(x) for x in np.unravel_index(r["cell"], shape))
        assert r["again"] == r["cell"]


def test_po2_near_sqrt(spark):
    got = [r[0] for r in spark.range(0, 70).select(binning.po2_near_sqrt(F.col("id"))).collect()]
    assert got == [0] + [2 ** math.floor(math.log2(math.sqrt(x))) for x in range(1, 70)]
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(binning.po2_near_sqrt(F.lit(-1))).collect()
