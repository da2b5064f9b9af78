"""Connected components of a link table, by rounds of pointing to the least neighbour, doubling pointers, contracting.

No list of neighbours is ever gathered: minima are combined before the shuffle, and hot nodes meet their label in joins
that AQE splits. Every round is a written table, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anvilgrid.session import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of each node of links (a, b: longs); root is the least node of its component."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = work.save(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    labels = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        point = work.save(both(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"point{turn}")
        step = 0
        while True:
            step += 1
            up = point.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = work.save(point.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), f"point{turn}_{step}")
            done = moved.where("moved").isEmpty()
            point = moved.drop("moved")
            if done:
                break
        old = f"labels{turn - 1}"
        if labels is None:
            labels = work.save(point, f"labels{turn}")
        else:
            to = point.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = work.save(labels.join(to, "root", "left").select("node", F.coalesce("above", "root").alias("root")), f"labels{turn}")
            work.drop(old)
        of = lambda c: point.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        edges = work.save(edges.join(of("a"), "a").join(of("b"), "b").where("a_root != b_root").select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct(), f"edges{turn}")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
