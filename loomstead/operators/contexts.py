"""Reachability that respects calls and returns.

Edges are ``(src, dst, kind, site)``: ``kind`` is 'plain', 'call' or 'return', ``site`` names the call
that a call edge enters by and a return edge goes back to.  Rows of a null end never match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators import graph as G


def _usable(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Edges that leave a start or the end of an edge; no walk from the starts takes another."""
    ends = edges.select("dst").distinct()
    ends = ends if starts is None else ends.union(starts.select("node")).distinct()
    return G.hold(edges.join(ends.withColumnRenamed("dst", "_end"), F.col("src") == F.col("_end"), "left_semi"))


def context_reach(edges: DataFrame, starts: DataFrame, depth: int = 4, rounds: int | None = None) -> DataFrame:
    """(start, node, stack, level): each state first reached, with the innermost ``depth`` call sites.

    A call pushes its site; what lies deeper than ``depth`` is forgotten.  A return pops the innermost
    site and goes only to it; with nothing on the stack, the caller is unknown and any return may go.
    """
    edges, packed = _usable(edges, starts), G.Packed(starts.select("node"))
    first = starts.select(F.col("node").alias("start"), "node", F.array().cast("array<long>").alias("stack"))
    top = F.element_at("stack", -1)

    def hop(f: DataFrame) -> DataFrame:
        met = f.join(edges, f["node"] == edges["src"])
        open_ = F.size("stack") == 0
        met = met.where((F.col("kind") != "return") | open_ | (F.when(~open_, top) == F.col("site")))
        pushed = F.concat("stack", F.array(F.col("site").cast("long")))
        pushed = F.slice(pushed, F.greatest(F.lit(1), F.size(pushed) - depth + 1), F.lit(depth))
        popped = F.slice("stack", F.lit(1), F.greatest(F.lit(0), F.size("stack") - 1))
        stack = F.when(F.col("kind") == "call", pushed).when(F.col("kind") == "return", popped).otherwise(F.col("stack"))
        return met.select("_block", F.col("dst").alias("node"), stack.alias("stack"), *packed.words)

    return G.fixpoint_of_starts(packed, first, hop, ["node", "stack"], rounds).select("start", "node", "stack", "level")


def summaries(edges: DataFrame) -> DataFrame:
    """(src, dst): plain edges, and one edge over every call whose matched return can be reached.

    Bodies are walked from the targets of calls only, over edges that leave the end of an edge.  Each round
    may find calls in bodies that need another call's summary; it ends when a round finds none.  Calls
    elsewhere cannot change what a body reaches and are summed up once, when that is known.
    """
    columns = [F.col("src").alias("caller"), F.col("dst").alias("start"), "site"]
    back = edges.where("kind = 'return'").select(F.col("src").alias("node"), F.col("dst").alias("resume"), "site").distinct()
    bodies, entries = _usable(edges), edges.where("kind = 'call'").select(F.col("dst").alias("node")).distinct()
    inner, steps = bodies.where("kind = 'call'").select(*columns), bodies.where("kind = 'plain'").select("src", "dst").distinct()
    back = G.hold(back.join(bodies.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
    entries = G.hold(entries)
    while True:
        inside = G.reach_of_starts(steps, entries).select("start", "node")
        over = G.hold(inside.join(back, "node").select("start", "site", "resume").distinct())
        fresh = G.hold(_over(inner, over).join(steps, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return edges.where("kind = 'plain'").select("src", "dst").unionByName(_over(edges.where("kind = 'call'").select(*columns), over)).distinct()
        steps = G.hold(steps.unionByName(fresh))


def _over(calls: DataFrame, over: DataFrame) -> DataFrame:
    """(src, dst): callers with where their calls resume, joined by blocks of callers."""
    packed = G.Packed(calls.select("caller"))
    by_call = packed.pack(calls.select(F.col("caller").alias("start"), F.col("start").alias("callee"), "site"), ["callee", "site"])
    met = by_call.join(over.withColumnRenamed("start", "callee"), ["callee", "site"])
    return packed.unpack(packed.gather(met.select("_block", "resume", *packed.words), ["resume"]), ["resume"]).select(F.col("start").alias("src"), F.col("resume").alias("dst"))


def summary_reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, level): nodes reached without going back over a return whose call was not taken."""
    edges = _usable(edges, starts)
    ahead = summaries(edges).unionByName(edges.where("kind = 'call'").select("src", "dst")).distinct()
    return G.reach_of_starts(G.hold(ahead), starts).select("start", "node", "level")
