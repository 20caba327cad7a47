"""Exact Hamming top-k by incremental multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import kept

#: Codes of one segment value that one salt holds.
HOT = 10_000


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): one bit for each of the first 64 dimensions, set where the value is above 0.

    Null vectors give no row; null elements and missing dimensions give 0 bits.
    """
    bit = lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(F.slice(vector_col, 1, 64), lambda v, i: bit(v, i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, segments: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest codes of each query, ties by id; a query's own row is left out.

    Codes are cut into segments of near equal widths, each with its index; unless given, there are so many
    that a segment has about log2 of the number of codes as its bits, so a bucket holds few codes at any
    size.  Radius by radius, the segments' values at just that distance are probed.  After radius r every
    code within ``segments * (r + 1) - 1`` is known, so a query ends once its kth verified distance is
    covered.  Until then its kth distance so far bounds what the join lets through.

    Probes and index meet by a shuffle on (segment, value), never by a broadcast; the codes of a hot value
    are dealt over salts and its probes are repeated for each, so no value is one task.

    Equal codes are one entry with its k + 1 least ids (a top-k can name no more) and equal query codes
    are searched once.  Fewer than k other rows give all of them.  Null ids or codes are left out; a
    repeated id counts once a code.
    """
    clean = codes.where("id is not null and code is not null").select("id", "code").distinct()
    held = kept(_least_ids(clean, k + 1), "codes")
    segments = segments or max(1, min(bits, math.ceil(bits / max(1.0, math.log2(max(2, held.count()))))))
    cuts = [bits * s // segments for s in range(segments + 1)]
    widths = [hi - lo for lo, hi in zip(cuts[:-1], cuts[1:])]
    cut = lambda c, s: F.shiftrightunsigned(c, cuts[s]).bitwiseAND(F.lit((1 << widths[s]) - 1 if widths[s] < 64 else -1))
    parts = F.array(*[F.struct(F.lit(s).alias("segment"), cut(F.col("code"), s).alias("value")) for s in range(segments)])
    index = held.select("code", F.explode(parts).alias("p")).select("code", "p.segment", "p.value")
    sizes = index.groupBy("segment", "value").agg(F.count("*").alias("n"))
    hot = kept(sizes.where(F.col("n") > HOT).select("segment", "value", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "code-hot")
    index = index.join(hot, ["segment", "value"], "left").withColumn("salt", F.pmod(F.xxhash64("code"), F.coalesce("salts", F.lit(1))).cast("int"))
    index = kept(index.select("code", "segment", "value", "salt"), "code-index")
    wanted = kept(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct(), "code-queries")
    open_ = wanted.select("query").distinct().withColumn("bound", F.lit(bits))
    entries = held.select("code", F.size("ids").alias("n"))
    best = None
    for radius in range(max(widths) + 1):
        near = F.concat(*[_probes(s, cut(F.col("query"), s), widths[s], radius) for s in range(segments)])
        probes = open_.select("query", "bound", F.explode(near).alias("p")).select("query", "bound", "p.segment", "p.value")
        probes = probes.join(hot, ["segment", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        distance = F.bit_count(F.col("code").bitwiseXOR(F.col("query")))
        met = probes.hint("shuffle_hash").join(index, ["segment", "value", "salt"]).where(distance <= F.col("bound")).select("query", "code", distance.cast("int").alias("distance"))
        if best is not None:
            met = met.unionByName(best)
        met = met.distinct().join(entries.hint("merge"), "code")
        # Keep what a top k can still name: codes before which fewer than k + 1 rows lie.  A query's rows are
        # counted by distance first, so a query with very many candidates is no large window.
        met = kept(met, "codes-met")
        order = Window.partitionBy("query").orderBy("distance")
        counts = met.groupBy("query", "distance").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order))
        limits = counts.where(F.col("upto") - F.col("n") < k + 1).groupBy("query").agg(F.max("distance").alias("most"), F.min(F.when(F.col("upto") >= k + 1, F.col("distance"))).alias("kth"))
        limits = kept(limits, "codes-limits")
        best = met.join(limits.hint("merge"), "query").where("distance <= most").select("query", "code", "distance")
        kth = limits.where("kth is not null").select("query", "kth")
        sure = segments * (radius + 1) - 1
        open_ = kept(open_.join(kth, "query", "left").select("query", F.coalesce("kth", F.lit(bits)).alias("bound")).where(F.col("bound") > sure), "codes-open")
        if open_.isEmpty():
            break
    near = best.join(held.hint("merge"), "code").select("query", "distance", F.explode("ids").alias("id"))
    # A query's code is searched once for all rows that have it; each drops itself from the k + 1.
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("nth") <= k + 1)
    found = wanted.join(near, "query").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _probes(segment: int, value: Column, width: int, radius: int) -> Column:
    """An array of (segment, value): all values at just this distance.  The constants are kept short in the plan as text that is split."""
    flips = [sum(1 << b for b in c) for c in combinations(range(width), radius)]
    numbers = F.filter(F.split(F.lit(",".join(map(str, flips))), ","), lambda x: x != "")
    return F.transform(numbers, lambda x: F.struct(F.lit(segment).alias("segment"), x.cast("long").bitwiseXOR(value).alias("value")))


def _least_ids(codes: DataFrame, n: int) -> DataFrame:
    """(code, ids): the n least ids of each code; ids are thinned in hash cells first, so no code is one task."""
    cell = F.pmod(F.xxhash64("id"), F.lit(64))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    thin = codes.withColumn("cell", cell).withColumn("nth", nth("code", "cell")).where(F.col("nth") <= n)
    thin = thin.withColumn("nth", nth("code")).where(F.col("nth") <= n)
    return thin.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
