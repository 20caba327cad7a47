"""MinHash near-duplicate groups with tensored banding and exact verification.

Two collections of m elements are made, each element joining two minhashes.  The m * m table keys
pair an element of the first collection with one of the second, so a key rests on four minhashes
while only 4 * m are computed instead of 4 * m * m.  A pair at the threshold J is missed if it agrees
on no element of one collection: at most 2 * (1 - J**2) ** m, and m is chosen from a bound on that.

Documents with equal shingle sets are one node.  Nodes that share a key belong to one candidate
family (components over node-to-least-node links, never all pairs).  Links inside a family are then
verified on the full sets: a small family in one task, a large one block by block, where only a few
members and those that they leave over meet every block.  Tasks emit spanning links only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm.common import by_size, kept, tidy, tidy_group
from loomstead.llm.graph import components
from loomstead.llm.shingles import shingle_sets

_FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType()),
    T.StructField("one", T.ArrayType(T.LongType())), T.StructField("two", T.ArrayType(T.LongType())),
])
#: Shingles and members in one block of a family, about.
BLOCK_SHINGLES, BLOCK_MEMBERS = 400_000, 500
#: Blocks of a large family whose least members ask first, and bytes of text whose sets are made at once.
FIRST_BLOCKS, TEXT_BYTES = 8, 1 << 20


def elements_for(threshold: float, miss: float = 1e-4) -> int:
    """Elements a collection needs so that a pair at the threshold is missed with at most this chance."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - threshold**2)))


def _minhash(h: np.ndarray, begins: np.ndarray, seed: int) -> np.ndarray:
    a = np.uint64(((seed * 2 + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF | 1)
    x = (h ^ np.uint64((seed * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)) * a
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return np.minimum.reduceat(x, begins)


def features(docs: DataFrame, m: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, set signature and the two element collections of each document (null where the set is empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows_ in by_size([len(t) + 256 for t in b["t"]], TEXT_BYTES):
                part = b.iloc[rows_]
                h, counts = shingle_sets(list(part["t"]), size)
                ends = np.cumsum(counts)
                full = counts > 0
                begins = (ends - counts)[full]
                sig: list = [None] * len(part)
                sets: list[list] = [[None] * len(part), [None] * len(part)]
                if len(begins):
                    raw = h.tobytes()
                    for i, e, c in zip(np.flatnonzero(full), ends[full], counts[full]):
                        sig[i] = hashlib.blake2b(raw[8 * (e - c) : 8 * e], digest_size=16).digest()
                    with np.errstate(over="ignore"):
                        for side in range(2):
                            cols = [(_minhash(h, begins, 4 * j + 2 * side) * np.uint64(0x9FB21C651E98DF25) ^ _minhash(h, begins, 4 * j + 2 * side + 1)).view(np.int64) for j in range(m)]
                            for i, row in zip(np.flatnonzero(full), np.stack(cols, axis=1)):
                                sets[side][i] = row
                yield pd.DataFrame({"doc_id": part["k"].astype("Int64"), "n_shingles": counts.astype(np.int64), "sig": sig, "one": sets[0], "two": sets[1]})

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return rows.mapInPandas(tidy(run), _FEATURES)


def families(nodes: DataFrame) -> DataFrame:
    """(node, family): nodes that share a table key with another node, by candidate family."""
    paired = nodes.select("node", F.posexplode("one").alias("i", "e"), "two").select("node", "i", "e", F.posexplode("two").alias("j", "f"))
    keyed = paired.select("node", F.xxhash64("i", "j", "e", "f").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    links = keyed.join(least.hint("merge"), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return components(links, "families").select("node", F.col("root").alias("family"))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def linked(sets: list[np.ndarray], percent: int, askers: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among sets: exact intersections through postings.

    Each of the ``askers`` meets all sets.  Without them the first sets ask, and then only sets outside the
    largest component; that covers each pair of different components.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(code))])
    at = np.concatenate([[0], np.cumsum(size)])
    groups, found = _Union(n), []

    def ask(x: int) -> None:
        c = code[at[x] : at[x + 1]]
        lo, width = begin[c], begin[c + 1] - begin[c]
        spots = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
        common = np.bincount(posting[spots], minlength=n)
        ok = 100 * common >= percent * (size[x] + size - common)
        ok[x] = False
        for y in np.flatnonzero(ok):
            if groups.join(x, int(y)):
                found.append((x, int(y)))

    if askers is not None:
        for x in askers.tolist():
            ask(x)
        return found
    first = min(n, 8)
    for x in range(first):
        ask(x)
    roots = np.array([groups.find(x) for x in range(n)])
    largest = np.bincount(roots).argmax()
    for x in range(first, n):
        if roots[x] != largest:
            ask(x)
    return found


def verified_links(docs: DataFrame, family: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): spanning links of each family, confirmed on the full shingle sets of whole texts.

    A small family is one task.  A large one is cut into blocks: some members first meet all blocks; then
    the members outside the family's largest component so far meet all blocks.  Two members that neither
    step compares are in one component already, so no link between components is lost, and members of a
    large group of near copies meet a few others only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    # The family table grows with the input, so it is never broadcast.
    rows = rows.join(family.hint("merge"), "node")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows_ in by_size([len(t) + 256 for t in b["t"]], TEXT_BYTES):
                part = b.iloc[rows_]
                h, counts = shingle_sets(list(part["t"]), size)
                ends, raw = 8 * np.cumsum(counts), h.tobytes()
                yield pd.DataFrame({"node": part["node"], "family": part["family"], "n": counts.astype(np.int64), "hashes": [raw[e - 8 * c : e] for e, c in zip(ends, counts)]})

    # A document read twice (a repeated key) gives the same node; the first of them stands for it.
    held = kept(rows.mapInPandas(tidy(sets), "node long, family long, n long, hashes binary"), "shingles")
    weight = held.groupBy("family").agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
    weight = weight.select("family", F.ceil(F.greatest(F.col("weight") / BLOCK_SHINGLES, F.col("members") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    weight = kept(weight, "family-blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = held.join(weight.hint("merge"), "family").select("node", "family", "n", "hashes", "blocks", block.alias("block"))

    def links(members: DataFrame, askers: DataFrame | None) -> DataFrame:
        """Links in each block: among its members, or of the askers that were sent there (by group) to them."""
        sent = askers is not None

        def verify(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(["node", "asks"], kind="stable").drop_duplicates("node", keep="last")
            sets_ = [np.frombuffer(x, np.uint64) for x in b["hashes"]]
            nodes = b["node"].to_numpy(np.int64)
            who = np.flatnonzero(b["asks"]) if sent else None
            pairs = linked(sets_, percent, who) if len(sets_) > 1 else []
            return pd.DataFrame({"a": [nodes[x] for x, _ in pairs], "b": [nodes[y] for _, y in pairs]}, dtype="int64")

        told = members.select("family", "block", F.lit(0).alias("group"), "node", "hashes", F.lit(False).alias("asks"))
        if askers is not None:
            groups = askers.groupBy("family", "block").agg(F.max("group").alias("last"))
            told = members.join(groups.hint("merge"), ["family", "block"]).select("family", "block", F.explode(F.sequence(F.lit(0), "last")).alias("group"), "node", "hashes", F.lit(False).alias("asks"))
            told = told.union(askers.select("family", "block", "group", "node", "hashes", F.lit(True)))
        return told.groupBy("family", "block", "group").applyInPandas(tidy_group(verify), "a long, b long")

    def to_all_blocks(rows: DataFrame, group) -> DataFrame:
        return rows.withColumn("group", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    small = links(spread.where("blocks = 1"), None)
    large = kept(spread.where("blocks > 1"), "large-families")
    if large.isEmpty():
        return small
    least = large.where(F.col("block") < FIRST_BLOCKS).groupBy("family", "block").agg(F.min("node").alias("node")).select("family", "node")
    first = large.join(least.hint("merge"), ["family", "node"], "left_semi")
    star = kept(links(large, to_all_blocks(first, F.lit(0))), "first-links")
    roots = components(star, "first-groups")
    placed = large.select("node", "family").distinct().join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    largest = placed.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    rest = kept(placed.join(largest.hint("merge"), ["family", "root"], "left_anti").select("node", "family"), "rest-nodes")
    crowd = rest.groupBy("family").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("groups"))
    asking = large.join(rest.hint("merge"), ["node", "family"]).join(crowd.hint("merge"), "family")
    later = links(large, to_all_blocks(asking, F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")))
    return small.union(star).union(later)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    ``component_id`` is the least id linked through pairs of Jaccard similarity of ``percent`` or more.
    Null, empty and blank texts have an empty set and stand alone.  Rows of a null id are kept and stand
    alone.  Repeated rows of one id share that id's component (their sets are equal nodes or linked
    through it).  Extra columns are ignored.  An empty table gives an empty result.  Sets are made for about
    1 MB of texts at once, longer texts in blocks; a task holds a few times its longest set beside that.
    """
    m = elements_for(percent / 100, miss)
    found = kept(features(docs, m, size, id_col, text_col), "minhash")
    nodes = found.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("node"), F.min_by("one", "doc_id").alias("one"), F.min_by("two", "doc_id").alias("two"))
    nodes = kept(nodes, "nodes")
    family = families(nodes)
    roots = components(verified_links(docs, family, size, percent, id_col, text_col), "groups")
    grouped = nodes.join(roots.hint("merge"), "node", "left").select("sig", F.coalesce("root", "node").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "sig").join(grouped.hint("merge"), "sig", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
