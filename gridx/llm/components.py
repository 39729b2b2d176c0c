"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridx.llm.common import FEW_ROWS, cut, looked_up, release


def components(edges: DataFrame, src: str = "a", dst: str = "b", most_rounds: int = 64) -> DataFrame:
    """(v, label): for each vertex of an edge the smallest vertex that it is connected with.

    Each round takes the least label among a vertex's neighbours, then replaces a label by its label's label, so
    a star is done after one round and a path after about the logarithm of its length. A vertex with very many edges
    and a label with very many vertices are looked up by a bounded broadcast; aggregates are combined before they
    shuffle. Rounds end when no label changes; an edge table without rows gives an empty result.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("w")).where("u is not null and w is not null")
    both = cut(both.unionByName(both.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("w")).alias("label")).withColumnRenamed("u", "v"))
    n = labels.count()
    for _ in range(most_rounds):
        seen = looked_up(both, labels.withColumnRenamed("v", "w"), "w", n=n).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels["v"] == seen["u"], "left").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("v").alias("label"), F.col("label").alias("of_root"))
        lower = lower if n <= FEW_ROWS else cut(lower)
        step = looked_up(lower, root, "label", "left", n=n).select("v", F.least("label", "of_root").alias("label"), (F.least("label", "of_root") != F.col("old")).alias("moved"))
        step = cut(step)
        changed = step.where("moved").limit(1).count()
        labels = step.select("v", "label")
        release(labels.sparkSession)
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
