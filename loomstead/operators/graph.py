"""Fixpoints over edge tables: semi-naive iteration with visited sets, on DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longs of a row whose bits stand for starts, and blocks of starts whose names may be broadcast (8 bytes a start).
WORDS, MOST_BLOCKS = 8, 4096


def hold(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint where a checkpoint folder is set; else keep the rows."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() is not None else df.persist()


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int | None = None) -> DataFrame:
    """Rows reached from ``start`` by repeated ``step`` (which adds ``level``), each key at its first level.

    Only new rows are joined again.  Checkpoints cut the lineage each round where a checkpoint folder is set.
    """
    seen = hold(start.dropDuplicates(keys).withColumn("level", F.lit(0)))
    frontier, level = seen, 0
    while rounds is None or level < rounds:
        level += 1
        fresh = step(frontier).select(*keys).distinct().join(seen.select(*keys), keys, "left_anti").withColumn("level", F.lit(level))
        frontier = hold(fresh)
        if frontier.isEmpty():
            break
        seen = hold(seen.unionByName(frontier))
    return seen


def reach(edges: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """(start, node, level): nodes each start reaches over ``edges(src, dst)``, with the fewest hops."""
    first = starts.select(F.col("node").alias("start"), "node")
    hop = lambda f: f.join(edges, f["node"] == edges["src"]).select("start", F.col("dst").alias("node"))
    return fixpoint(first, hop, ["start", "node"], rounds)


def reverse_reach(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node, level): nodes from which a sink can be reached."""
    hop = lambda f: f.join(edges, f["node"] == edges["dst"]).select(F.col("src").alias("node"))
    return fixpoint(sinks.select("node"), hop, ["node"])


class Packed:
    """Rows of many starts as one row: a block of numbered starts, and a bit for each of them.

    What many starts share is then joined and compared once a block and not once a start.
    """

    words = [f"_w{i}" for i in range(WORDS)]

    def __init__(self, starts: DataFrame):
        """``starts`` has one column, of any type; equal values are one start."""
        (column,) = starts.columns
        dealt = hold(starts.select(F.col(column).alias("start")).distinct().repartitionByRange("start").withColumn("_id", F.monotonically_increasing_id()))
        part = F.shiftright("_id", 33)
        before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).withColumn("_begin", F.coalesce(before, F.lit(0))).drop("_rows")
        n = F.col("_begin") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
        placed = dealt.withColumn("_part", part).join(F.broadcast(counts), "_part").select("start", n.alias("_n"))
        self.numbers = hold(placed.select("start", F.floor(F.col("_n") / (64 * WORDS)).alias("_block"), (F.col("_n") % (64 * WORDS)).cast("int").alias("_at")))
        listed = F.transform(F.sort_array(F.collect_list(F.struct("_at", "start"))), lambda x: x["start"])
        names = hold(self.numbers.groupBy("_block").agg(listed.alias("_names")))
        self.names = F.broadcast(names) if names.count() <= MOST_BLOCKS else names.hint("merge")

    def gather(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy("_block", *keys).agg(*[F.bit_or(w).alias(w) for w in self.words])

    def pack(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of (start, keys)."""
        bit = F.expr("shiftleft(1L, _at % 64)")
        words = [F.when(F.floor(F.col("_at") / 64) == i, bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(self.words)]
        met = rows.withColumnRenamed("start", "_start").join(self.numbers, F.col("_start").eqNullSafe(F.col("start")))
        return self.gather(met.select("_block", *keys, *words), keys)

    def unpack(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """(start, keys) of packed rows."""
        by_word = rows.select("_block", *keys, F.posexplode(F.array(*self.words)).alias("_word", "_bits")).where("_bits <> 0")
        named = by_word.join(self.names, "_block").select(*keys, "_bits", F.posexplode(F.slice("_names", F.col("_word") * 64 + 1, 64)).alias("_bit", "start"))
        return named.where("shiftright(_bits, _bit) & 1 = 1").select("start", *keys)


def fixpoint_of_starts(packed: Packed, first: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int | None = None) -> DataFrame:
    """(start, keys, level): as ``fixpoint`` over (start, keys), for a ``step`` that does not look at the start.

    ``step`` gets packed rows and keeps their block and words.
    """
    columns = ["_block", *keys, *packed.words]
    frontier = hold(packed.pack(first, keys).withColumn("level", F.lit(0)))
    seen, layers, level = frontier.select(*columns), [frontier], 0
    while rounds is None or level < rounds:
        level += 1
        old = seen.select("_block", *keys, *[F.col(w).alias(f"{w}_old") for w in packed.words])
        made = packed.gather(step(frontier).select(*columns), keys).join(old.hint("merge"), ["_block", *keys], "left")
        new = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"{w}_old", F.lit(0).cast("long")))).alias(w) for w in packed.words]
        frontier = hold(made.select("_block", *keys, *new).where(" or ".join(f"{w} <> 0" for w in packed.words)).withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        layers.append(frontier)
        seen = hold(packed.gather(seen.unionByName(frontier.select(*columns)), keys))
    found = layers[0]
    for layer in layers[1:]:
        found = found.unionByName(layer)
    return packed.unpack(found, [*keys, "level"])


def reach_of_starts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, level): as ``reach``, for many starts that reach the same nodes."""
    packed = Packed(starts.select("node"))
    hop = lambda f: f.join(edges, f["node"] == edges["src"]).select("_block", F.col("dst").alias("node"), *packed.words)
    return fixpoint_of_starts(packed, starts.select(F.col("node").alias("start"), "node").distinct(), hop, ["node"])
