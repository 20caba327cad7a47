"""Connected components by hooking and pointer jumping, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import kept


def components(edges: DataFrame, what: str = "cc") -> DataFrame:
    """(node, root): the least node that each node of ``edges(a, b)`` reaches.

    Each round every root takes its least neighbouring root as parent, paths are shortened twice,
    and edges inside a component go.  In each component that still has an edge at least one root goes,
    and in all but its local least ones every root does; a star whose centre has the largest id takes two
    rounds.  The loop runs until no edge is left.  Each round is written to the shared folder; only
    whether edges are left reaches the driver.  Every table here grows with the input and packs well as
    Parquet, so file sizes mislead Spark and no join may broadcast one.  Empty edges give an empty table;
    loops and nulls are dropped.
    """
    edges = kept(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), what)
    labels = kept(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), what)
    live = edges
    while not live.isEmpty():
        hook = live.select("a", "b").union(live.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        up = hook.select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        for _ in range(2):
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            up = up.join(over.hint("merge"), "up", "left").select("node", F.coalesce("over", "up").alias("up"))
        up = kept(up.where("up <> node"), what)
        moved = up.select(F.col("node").alias("root"), "up")
        labels = kept(labels.join(moved.hint("merge"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), what)
        ends = live
        for side in ("a", "b"):
            ends = ends.join(up.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up")).hint("merge"), side, "left").withColumn(side, F.coalesce(f"{side}_up", side)).drop(f"{side}_up")
        live = kept(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), what)
    return labels
