"""Connected components of links between numbers, by contraction; all of it in joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import store


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); nodes of one component share a root.

    Each round gives every node the smallest of its own and its neighbours' numbers, and replaces the links
    by links between these numbers. A component of any size is only met through minima and joins, both
    of which Spark splits. Every round is written, so a lost executor repeats nothing before it.
    """
    links = store.written(links.where("a <> b").distinct())
    roots = store.written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root")))
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        near = store.written(near)
        moved = roots.join(near.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        left = near.select("a", F.col("to").alias("x"))
        right = near.select(F.col("a").alias("b"), F.col("to").alias("y"))
        again = links.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
        roots, links = store.written(moved), store.written(again)
    return roots
