"""Join forms that Spark has no single operator for, each as a composition of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Left rows of a leaf that meet the leaf's right rows in one group.
GROUP_ROWS = 4096


def first_match(left: DataFrame, right: DataFrame, on: list[str], priority: list[Column]) -> DataFrame:
    """The one right row of best priority for each left key; left rows without one drop out."""
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(*priority))
    return left.join(right.withColumn("_nth", nth).where("_nth = 1").drop("_nth"), on)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """Each left row with the right row of the same ``by`` that is latest at or before it, by one sort of both."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    for c in take:
        both = both.withColumn(c, F.last(F.when(F.col("_side") == 0, F.col(c)), ignorenulls=True).over(upto))
    return both.where("_side = 1").drop("_side")


def pair_levels(base: DataFrame, head: DataFrame, levels: list[list[str]], order: list[str]) -> DataFrame:
    """(base_id, head_id, level): the k-th base row of a key pairs with the k-th head row, level by level over what is left."""
    out = None
    for level, keys in enumerate(levels):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        a = base.withColumn("_nth", nth).select(*keys, "_nth", F.col("id").alias("base_id"))
        b = head.withColumn("_nth", nth).select(*keys, "_nth", F.col("id").alias("head_id"))
        met = a.join(b, [*keys, "_nth"]).select("base_id", "head_id", F.lit(level).alias("level"))
        out = met if out is None else out.unionByName(met)
        base = base.join(met.select(F.col("base_id").alias("id")), "id", "left_anti")
        head = head.join(met.select(F.col("head_id").alias("id")), "id", "left_anti")
    return out


def nearest_match(left: DataFrame, right: DataFrame, tree: DataFrame) -> DataFrame:
    """(left_id, right_id, depth): all right rows of a left id's own leaf (depth 1) or, if it has none, of its branch (depth 0).

    ``left`` is (left_id, leaf), ``right`` (right_id, leaf) and ``tree`` (leaf, branch); repeated rows count
    each time and rows of one left id are ranked together.  The depth is settled on leaves, before any right
    row is met, so only the result's own pairs are made.  A crowded leaf is dealt out in groups of left rows.
    """
    taken = right.select("leaf").distinct()
    pairs = tree.select(F.col("leaf").alias("own"), "branch").join(tree.join(taken, "leaf", "left_semi"), "branch")
    pairs = pairs.select("own", "leaf", (F.col("own") == F.col("leaf")).cast("int").alias("depth"))
    deepest = pairs.groupBy("own").agg(F.max("depth").alias("depth"))
    ranked = left.withColumnRenamed("leaf", "own").join(deepest, "own").withColumn("best", F.max("depth").over(Window.partitionBy("left_id")))
    chosen = ranked.where("depth = best").select("left_id", "own", "depth").join(pairs, ["own", "depth"]).select("left_id", "leaf", "depth")
    crowd = chosen.groupBy("leaf").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("groups"))
    near = chosen.join(crowd, "leaf").withColumn("group", F.pmod(F.xxhash64("left_id"), F.col("groups")).cast("int")).drop("groups")
    far = right.join(crowd, "leaf").select("right_id", "leaf", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the rows that go in are few beside those that come out
    met = near.repartition(width, "leaf", "group").join(far.repartition(width, "leaf", "group").hint("merge"), ["leaf", "group"])
    return met.select("left_id", "right_id", "depth")
