"""Connected components of an edge table, by smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (null-free). Returns node, component for every node that has an edge.

    Each round hooks every root on its smallest neighbour, if that is smaller, follows the hooks to their ends
    by doubling, and contracts the edges to those between roots. A root that is not hooked has a neighbour that
    is; if that one went elsewhere, its new root is smaller, and the next round hooks this one. So two rounds at
    least halve the roots of every component that is not done, whatever its shape, and hooks k long take about
    log2(k) joins. A node of many edges is only ever aggregated, with partial sums before the shuffle. Every
    step is a written table, so lineage does not grow; one row a step comes to the driver.
    """
    links = written(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct(), "edges")
    labels = links.select(F.col("high").alias("node"), F.col("low").alias("component")).limit(0)
    old = []
    while not links.isEmpty():
        hooks = written(links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("up"), F.col("component").alias("higher"))
            at_up = hooks["component"] == up["up"]
            if hooks.join(up, at_up, "left_semi").isEmpty():
                break
            further = written(hooks.join(up, at_up, "left").select("node", F.coalesce("higher", "component").alias("component")), "hooks")
            discard(hooks)
            hooks = further
        ends = links.join(up.withColumnRenamed("up", "high"), "high").select("low", F.col("higher").alias("x"))
        ends = ends.join(up.withColumnRenamed("up", "low").withColumnRenamed("higher", "lower"), "low", "left").select("x", F.coalesce("lower", "low").alias("y"))
        left = written(ends.where("x <> y").select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct(), "edges")
        moved = labels.join(up, labels["component"] == up["up"], "left").select("node", F.coalesce("higher", "component").alias("component"))
        labels = written(moved.union(hooks), "labels")
        discard(links, hooks, *old)
        links, old = left, [labels]
    discard(links)
    return labels.union(labels.select("component", "component").distinct())
