"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import materialise, outlive, steps


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """links(u, v) -> (node, root): root is the smallest node of node's component.

    Each round takes the least root among a node's neighbours, then the root's own root, so the
    rounds grow with the logarithm of the longest path. All sums are partial minima; each round
    is written to the shared folder, which cuts the lineage and lets skewed joins be split, and the
    round before it is deleted. `rows` is a bound on the links, where one is known. Null ends and loops are left out; an empty table gives an empty table.
    """
    both = links.filter("u is not null and v is not null and u <> v").select("u", "v")
    with steps():
        edges = materialise(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", None if rows is None else 2 * rows)
        n = edges.count()
        labels = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels", n)
        while True:
            with steps():
                heard = edges.join(labels, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "root")
                least = materialise(labels.union(heard).groupBy("node").agg(F.min("root").alias("root")), "labels", n)
                up = least.select(F.col("node").alias("root"), F.col("root").alias("above"))
                new = outlive(least.join(up, "root").select("node", F.least("root", "above").alias("root")), "labels", n)
                moved = new.join(labels.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
            labels = new
            if not moved:
                return outlive(labels, "roots", n)
