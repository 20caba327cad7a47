"""Longest-processing-time sharding: groups of equal texts stay together, sizes come out near equal."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import kept


def lpt(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each (weight, number of groups), heaviest first: the groups each shard takes.

    The heap holds (load, shard).  The least-loaded shard takes groups until another is less loaded;
    once loads lie within one weight, whole rounds over all shards are dealt at once.  The result is
    that of handing out group by group.
    """
    heap = [(0, s) for s in range(shards)]
    plan = []
    for weight, count in sorted(classes, reverse=True):
        taken = [0] * shards
        while count:
            if count >= shards and max(heap)[0] - heap[0][0] <= weight:
                rounds = count // shards
                heap = [(load + rounds * weight, s) for load, s in heap]
                taken = [t + rounds for t in taken]
                count -= rounds * shards
                heapq.heapify(heap)
                continue
            load, s = heapq.heappop(heap)
            gap = heap[0][0] - load if heap else 0
            n = min(count, max(1, -(-gap // weight))) if heap else count
            heapq.heappush(heap, (load + n * weight, s))
            taken[s] += n
            count -= n
        plan.append((weight, taken))
    return plan


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cells: int = 64, buckets: int = 1024) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row gets a shard and a gapless place in it.

    A group is all rows of one text; its weight is the rows' UTF-8 bytes plus one each.  Only the
    number of groups of each distinct weight goes to the driver; N distinct weights take N * N / 2
    bytes of text at least, so 100 TB has 15 million at most.  Groups of one weight are
    interchangeable: they are numbered within ``cells`` hash cells a weight, so no weight is one task.

    A null text counts as no bytes and goes with empty texts.  Null ids are ordinary rows.  Repeated
    rows each take a slot.  Slots follow (hash bucket, id, text hash).  An empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = kept(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("weight")).withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int"))
    groups = kept(groups, "shard-groups")
    by_cell = groups.groupBy("weight", "cell").agg(F.count("*").alias("n"))
    by_cell = by_cell.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("weight").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    classes = [(r["weight"], r["n"]) for r in groups.groupBy("weight").agg(F.count("*").alias("n")).toLocalIterator()]
    ends = []
    for weight, taken in lpt(classes, shards):
        total = 0
        ends.append((weight, [total := total + t for t in taken]))
    plan = spark.createDataFrame(pd.DataFrame(ends, columns=["weight", "ends"]), "weight long, ends array<long>") if ends else spark.createDataFrame([], "weight long, ends array<long>")
    place = by_cell.join(plan, "weight").select("weight", "cell", "before", "ends")
    nth = F.row_number().over(Window.partitionBy("weight", "cell").orderBy("digest"))
    ranked = groups.withColumn("nth", nth).join(place, ["weight", "cell"])
    homes = ranked.select("digest", F.size(F.filter("ends", lambda e: e < F.col("nth") + F.col("before"))).alias("shard"))
    placed = rows.join(homes, "digest").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int"))
    placed = kept(placed, "shard-homes")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    local = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")) - 1)
    return local.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"))
