"""Exact removal of long repeated byte strings across documents.

Every byte that lies in a string of ``width`` bytes which also starts in a document of smaller id goes;
strings are judged on the input and never cross documents.  Repeats are found by external induced sorting;
steps 0 to 2 are a prefilter that keeps out of the sort what cannot repeat or is settled whole, and that
brings equal windows to one shard.

0. Texts are written once, bucketed by chunk; each later pass reads them from there without a shuffle.
   Of documents with equal texts all but that of the least id go whole and take no further part.
1. Each window of ``width`` bytes has an anchor: the least hash among its 24-byte strings.  Equal windows
   have equal anchors.  Chunks of documents send their anchors' hashes to hash buckets, packed; a bucket
   answers each chunk with a bit for every hash that some other document also has.  Windows whose anchor
   is in one document only cannot repeat.
2. Stretches of windows with one repeated anchor are segments.  In a second round of questions chunks
   send digests of their segments.  Where an anchor has one segment everywhere, its documents learn the
   least id that has it.  Of the others each segment's text is sent once.
3. Those segments stream by anchor into shards, each a text file of its task, and external induced sorting
   brings equal windows together: neighbours whose common prefix has the width.  Each window gets the
   least id that has it.  Only an anchor with more text than a shard should hold (a passage that very many
   documents share) is not given to one task: its windows meet by their own digests, in a grouping that
   Spark spills and combines.
4. Windows go back to the documents that hold them and are joined to removed spans.

Only counts reach the driver.  Each step's result is written to the shared folder, so a lost executor
repeats one step at most.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import induced
from loomstead.llm.common import fresh_path, kept, shuffle_width, tidy, tidy_group

WIDTH, GRAM = 50, 24
#: Windows in a segment at most, and bytes of text in a chunk, behind a bucket of questions and in a sorting shard (about).
LONGEST, CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES = 64, 1 << 19, 8 << 20, 2 << 20
_BASE = np.uint64(0x100000001B3)


def _grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes at each position."""
    with np.errstate(over="ignore"):

        def wider(h: np.ndarray, tail: np.ndarray, size: int, shift: int) -> np.ndarray:
            out = h * np.uint64(pow(int(_BASE), size, 1 << 64))
            out[: max(0, len(h) - shift)] += tail[shift:]
            return out

        h = buf.astype(np.uint64) + np.uint64(1)
        for k in (1, 2, 4):
            h = wider(h, h, k, k)
        h8 = h
        h16 = wider(h8, h8, 8, 8)
        h = wider(h16, h8, 8, 16)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def stretches(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor) of each run of windows with one anchor."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n_windows = np.maximum(size - width + 1, 0)
    total = int(n_windows.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    least = _grams(buf)
    reach, span = 1, width - GRAM + 1
    while reach * 2 <= span:
        least = np.minimum(least, np.concatenate([least[reach:], least[-1:].repeat(min(reach, len(least)))])[: len(least)])
        reach *= 2
    rest = span - reach
    if rest:
        least = np.minimum(least, np.concatenate([least[rest:], least[-1:].repeat(min(rest, len(least)))])[: len(least)])
    owner = np.repeat(np.arange(len(texts)), n_windows)
    offset = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    anchor = least[begin[owner] + offset]
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, total))
    # Very long runs (periodic text) are cut, so a segment stays short.
    pieces = -(-run // LONGEST)
    cut = np.repeat(first, pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
    m = np.minimum(np.repeat(first + run, pieces) - cut, LONGEST)
    return owner[cut], offset[cut], m, anchor[cut]


def _chunk_anchors(ids: np.ndarray, owner: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct anchors of a chunk in order, whether two of its documents have it)."""
    order = np.lexsort((ids[owner], anchor))
    a, o = anchor[order], ids[owner][order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    other = np.zeros(len(a), bool)
    other[1:] = ~new[1:] & (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    return a[first], np.maximum.reduceat(other, first) if len(first) else other


def settled(batches: Iterator[pd.DataFrame], width: int = WIDTH, limit: int = induced.LIMIT) -> Iterator[pd.DataFrame]:
    """From segments (shard, h, s, segment, k) in order of shard: runs of windows (h, s, lo, n, least) with the least id that has them.

    A shard's text and tables go to local files past ``limit``, so a shard may be far larger than memory.
    """
    shard, texts, rows = None, induced.Sequence(limit), induced.Sequence(limit)
    for b in batches:
        for number, part in b.groupby("shard", sort=True):
            if shard is not None and number != shard:
                yield from _settle(texts, rows, width, limit)
                texts, rows = induced.Sequence(limit), induced.Sequence(limit)
            shard = number
            bodies = list(part["segment"])
            size = np.fromiter(map(len, bodies), np.int64, len(bodies))
            codes = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
            codes[np.cumsum(size + 1) - 1] = 1
            texts.append(codes)
            rows.append(part["h"].to_numpy(np.int64), part["s"].to_numpy(np.int64), part["k"].to_numpy(np.int64), size)
    if shard is not None:
        yield from _settle(texts, rows, width, limit)


def _settle(texts: induced.Sequence, rows: induced.Sequence, width: int, limit: int) -> Iterator[pd.DataFrame]:
    n, count = sum(len(c[0]) for c in texts) + 1, sum(len(c[0]) for c in rows)
    chars, least, at = induced.space(n, np.uint16, limit), induced.space(n, np.int64, limit), 0
    for (codes,) in texts:
        chars[at : at + len(codes)] = codes
        at += len(codes)
    h, s, k, begin, size = (induced.space(count, np.int64, limit) for _ in range(5))
    at = place = 0
    for hs, ss, ks, sizes in rows:
        here = slice(at, at + len(hs))
        h[here], s[here], k[here], size[here] = hs, ss, ks, sizes
        begin[here] = place + np.cumsum(sizes + 1) - sizes - 1
        least[place : place + int((sizes + 1).sum())] = np.repeat(ks, sizes + 1)
        at, place = at + len(hs), place + int((sizes + 1).sum())
    for spot, new in induced.equal_windows(chars, width, limit):
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(spot)))
        spot, run = spot[np.repeat(run > 1, run)], run[run > 1]
        if len(spot):
            ids = k[np.searchsorted(begin, spot, side="right") - 1]
            least[spot] = np.repeat(np.minimum.reduceat(ids, np.cumsum(run) - run), run)
    for lo in range(0, count, 20_000):
        here = slice(lo, lo + 20_000)
        m = size[here] - (width - 1)
        owner = np.repeat(np.arange(len(m)), m)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
        low = least[np.asarray(begin[here])[owner] + offset]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        x = np.flatnonzero(new)
        yield pd.DataFrame({"h": np.asarray(h[here])[owner[x]], "s": np.asarray(s[here])[owner[x]], "lo": offset[x].astype(np.int32), "n": np.diff(np.append(x, len(low))).astype(np.int32), "least": low[x]})


class _Chunks:
    """All rows as (k, keyed, t, body, c) in a table bucketed by chunk, written once and read in each pass.

    The table leaves the catalogue at once; its files stay as long as the shared folder.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        spark = docs.sparkSession
        body = F.col(text_col).cast("binary")
        key = F.col(id_col).cast("long")
        rows = docs.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNotNull().alias("keyed"), F.xxhash64(body).alias("t"), F.coalesce(body, F.lit(b"")).alias("body"))
        self.parts = shuffle_width(spark)
        self.total = rows.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n")).first()["n"]
        self.chunks = max(self.parts, -(-self.total // CHUNK_BYTES))
        self.spark, name = spark, f"loomstead_chunks_{uuid.uuid4().hex}"
        rows = rows.withColumn("c", self.of("k", "t")).repartition(self.parts, "c")
        rows.write.bucketBy(self.parts, "c").option("path", fresh_path(spark, "repeat-chunks")).saveAsTable(name)
        self.rows = spark.table(name)
        spark.sql(f"drop table {name}")
        del rows
        _release(spark)

    def of(self, k: str, t: str):
        return F.pmod(F.xxhash64(k, t), F.lit(self.chunks)).cast("int")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(k, t, a, b): byte spans to remove, as (id, hash of the text), overlapping and in any order.

    Rows without id take no part.  Rows of one id never remove each other's bytes.
    """
    return _spans(_Chunks(docs, id_col, text_col), width)


def _spans(chunked: _Chunks, width: int) -> DataFrame:
    spark, parts = chunked.spark, chunked.parts
    rows = chunked.rows.where((F.length("body") >= width) & F.col("keyed")).drop("keyed")
    buckets = max(parts, -(-chunked.total // BUCKET_BYTES))

    digests = kept(rows.select("k", "t", "c", F.length("body").alias("size"), F.unhex(F.sha2("body", 256)).alias("digest")), "repeat-digests")
    firsts = digests.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copies = kept(digests.join(firsts.hint("merge"), "digest").where("k > first").select("k", "t", "c", "size"), "repeat-copies")

    def sort(part: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["k", "t"], kind="stable").drop_duplicates(["k", "t"])
        gone = set(zip(whole["k"].tolist(), whole["t"].tolist()))
        return part[[x not in gone for x in zip(part["k"].tolist(), part["t"].tolist())]] if gone else part

    def dealt(h: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Buckets that ascending anchors fall into, and where each bucket begins."""
        cuts = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        return [b for b in range(buckets) if cuts[b] < cuts[b + 1]], cuts

    def send(key, part: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        part = sort(part, whole)
        if not len(part):
            return pd.DataFrame(columns=["bucket", "c", "hashes", "twice"])
        owner, _, _, anchor = stretches(list(part["body"]), width)
        a, twice = _chunk_anchors(part["k"].to_numpy(np.int64), owner, anchor)
        some, cuts = dealt(a)
        return pd.DataFrame({"bucket": some, "c": part["c"].iloc[0], "hashes": [a[cuts[b] : cuts[b + 1]].tobytes() for b in some], "twice": [np.packbits(twice[cuts[b] : cuts[b + 1]]).tobytes() for b in some]})

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(h, np.uint64) for h in part["hashes"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(h)) for t, h in zip(part["twice"], lists)]).astype(bool)
        _, code, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        again = count > 1
        again[code[twice]] = True
        flags = again[code]
        ends = np.cumsum([len(h) for h in lists])
        return pd.DataFrame({"c": part["c"], "bucket": part["bucket"], "flags": [np.packbits(flags[e - len(h) : e]).tobytes() for h, e in zip(lists, ends)], "n": [len(h) for h in lists]})

    whole = copies.select("c", F.lit(-1).alias("bucket"), F.lit(b"").alias("flags"), F.lit(0).alias("n"), "k", "t")
    none = [F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("t")]
    sent = rows.groupBy("c").cogroup(copies.groupBy("c")).applyInPandas(tidy_group(send), "bucket int, c int, hashes binary, twice binary")
    answers = kept(sent.groupBy("bucket").applyInPandas(tidy_group(answer), "c int, bucket int, flags binary, n int"), "repeat-answers")
    _release(spark)

    def marked(texts: list[bytes], owner, offset, m) -> tuple[list[bytes], np.ndarray]:
        pieces = [texts[o][a : a + n + width - 1] for o, a, n in zip(owner.tolist(), offset.tolist(), m.tolist())]
        return pieces, np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=8).digest() for p in pieces]), np.int64)

    def send_segments(key, part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The chunk's repeated anchors with a digest of each segment and the least id that has it here."""
        columns = ["bucket", "c", "h", "s", "k"]
        part, flags = sort(part, found[found["bucket"] < 0]), found[found["bucket"] >= 0].sort_values("bucket")
        if not len(part) or not len(flags):
            return pd.DataFrame(columns=columns)
        texts, ids = list(part["body"]), part["k"].to_numpy(np.int64)
        owner, offset, m, anchor = stretches(texts, width)
        again = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(flags["flags"], flags["n"])]).astype(bool)
        hit = again[np.searchsorted(_chunk_anchors(ids, owner, anchor)[0], anchor)]
        owner, offset, m, anchor = owner[hit], offset[hit], m[hit], anchor[hit]
        mark = marked(texts, owner, offset, m)[1]
        order = np.lexsort((ids[owner], mark, anchor))
        h, s, k = anchor[order], mark[order], ids[owner][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s, k = h[new], s[new], k[new]
        some, cuts = dealt(h)
        cut_ = lambda x, b: x[cuts[b] : cuts[b + 1]].tobytes()
        return pd.DataFrame({"bucket": some, "c": part["c"].iloc[0], "h": [cut_(h, b) for b in some], "s": [cut_(s, b) for b in some], "k": [cut_(k, b) for b in some]})

    def answer_segments(part: pd.DataFrame) -> pd.DataFrame:
        """For each segment sent: the least id; whether its anchor has others; whether this chunk is to send the text."""
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in part["h"]])
        s, k = (np.concatenate([np.frombuffer(x, np.int64) for x in part[c]]) for c in ("s", "k"))
        size = np.array([len(x) // 8 for x in part["h"]])
        order = np.lexsort((k, s, h))
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[order][1:] != h[order][:-1]
        new = new_h.copy()
        new[1:] |= s[order][1:] != s[order][:-1]
        seg, anchor = np.cumsum(new) - 1, np.cumsum(new_h) - 1
        many = np.bincount(anchor[new])[anchor] > 1
        code, least = np.zeros(len(h), np.uint8), np.empty(len(h), np.int64)
        code[order] = np.where(many, 1 + new, 0)
        least[order] = k[order][new][seg]
        ends = np.cumsum(size)
        with np.errstate(over="ignore"):
            both = h * _BASE + s.view(np.uint64)
        return pd.DataFrame({"c": part["c"], "bucket": part["bucket"], "h": part["h"], "both": [both[e - n : e].tobytes() for n, e in zip(size, ends)], "least": [least[e - n : e].tobytes() for n, e in zip(size, ends)], "code": [code[e - n : e].tobytes() for n, e in zip(size, ends)]})

    flagged = answers.select("c", "bucket", "flags", "n", *none).union(whole)
    sent = rows.groupBy("c").cogroup(flagged.groupBy("c")).applyInPandas(tidy_group(send_segments), "bucket int, c int, h binary, s binary, k binary")
    answers = kept(sent.groupBy("bucket").applyInPandas(tidy_group(answer_segments), "c int, bucket int, h binary, both binary, least binary, code binary"), "repeat-segment-answers")
    _release(spark)

    def cut(key, part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """Spans that are settled (kind 2); else the segments' places (kind 0) and, from one chunk each, their texts (kind 1)."""
        columns = ["kind", "h", "s", "segment", "k", "t", "a", "b"]
        part, told = sort(part, found[found["bucket"] < 0]), found[found["bucket"] >= 0]
        if not len(part) or not len(told):
            return pd.DataFrame(columns=columns)
        texts = list(part["body"])
        ids, marks = part["k"].to_numpy(np.int64), part["t"].to_numpy(np.int64)
        owner, offset, m, anchor = stretches(texts, width)
        asked = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in told["h"]]))
        hit = asked[np.minimum(np.searchsorted(asked, anchor), len(asked) - 1)] == anchor
        owner, offset, m, anchor = owner[hit], offset[hit], m[hit], anchor[hit]
        both = np.concatenate([np.frombuffer(x, np.uint64) for x in told["both"]])
        least = np.concatenate([np.frombuffer(x, np.int64) for x in told["least"]])
        code = np.concatenate([np.frombuffer(x, np.uint8) for x in told["code"]])
        order = np.argsort(both)
        both, least, code = both[order], least[order], code[order]
        pieces, mark = marked(texts, owner, offset, m)
        with np.errstate(over="ignore"):
            mine = anchor * _BASE + mark.view(np.uint64)
        at = np.minimum(np.searchsorted(both, mine), len(both) - 1)
        hit = both[at] == mine
        single = hit & (code[at] == 0) & (least[at] < ids[owner])
        first = single.copy()
        first[1:] &= ~(single[:-1] & (owner[1:] == owner[:-1]))
        first |= single & np.concatenate([[True], offset[1:] != offset[:-1] + m[:-1]])
        x = np.flatnonzero(first)
        last = np.flatnonzero(single & np.concatenate([~single[1:] | first[1:], [True]]))
        spans = pd.DataFrame({"kind": 2, "h": 0, "s": 0, "segment": None, "k": ids[owner[x]], "t": marks[owner[x]], "a": offset[x], "b": offset[last] + m[last] - 1 + width})
        x = np.flatnonzero(hit & (code[at] > 0))
        spots = pd.DataFrame({"kind": 0, "h": anchor[x].view(np.int64), "s": mark[x], "segment": None, "k": ids[owner[x]], "t": marks[owner[x]], "a": offset[x], "b": 0})
        x = np.flatnonzero(hit & (code[at] == 2))
        x = x[np.unique(mine[x], return_index=True)[1]]
        bodies = pd.DataFrame({"kind": 1, "h": anchor[x].view(np.int64), "s": mark[x], "segment": [pieces[i] for i in x], "k": least[at[x]], "t": 0, "a": m[x] + width - 1, "b": 0})
        return pd.concat([spans, spots, bodies], ignore_index=True)[columns]

    told = answers.select("c", "bucket", "h", "both", "least", "code", *none).union(whole.select("c", "bucket", *["flags"] * 4, "k", "t"))
    spots = rows.groupBy("c").cogroup(told.groupBy("c")).applyInPandas(tidy_group(cut), "kind int, h long, s long, segment binary, k long, t long, a int, b int")
    spots = kept(spots, "repeat-segments")
    _release(spark)
    segments = spots.where("kind = 1").select("h", "s", "segment", "k")
    amount = spots.where("kind = 1").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-amount // SHARD_BYTES))
    segments = segments.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    # Anchors of more text than a shard: looked for in overfull shards only, so at most one anchor for each SHARD_BYTES.
    sizes = spots.where("kind = 1").select("h", "a", F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    full = sizes.groupBy("shard").agg(F.sum("a").alias("n")).where(F.col("n") > 4 * SHARD_BYTES).select("shard")
    hot = kept(sizes.join(full, "shard").groupBy("h").agg(F.sum("a").alias("n")).where(F.col("n") > SHARD_BYTES).select("h"), "repeat-hot-anchors")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each window of each segment by a 16-byte digest."""
        for b in batches:
            m = np.fromiter((len(x) - width + 1 for x in b["segment"]), np.int64, len(b))
            w = [hashlib.blake2b(x[i : i + width], digest_size=16).digest() for x, n in zip(b["segment"], m) for i in range(n)]
            lo = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            yield pd.DataFrame({"h": np.repeat(b["h"].to_numpy(np.int64), m), "s": np.repeat(b["s"].to_numpy(np.int64), m), "k": np.repeat(b["k"].to_numpy(np.int64), m), "lo": lo.astype(np.int32), "w": w})

    # At most one hot anchor for each SHARD_BYTES of segments; the joins with them choose their strategy by the written table's size.  All other joins here are of tables that grow with the input and are merged, never broadcast.
    cold = segments.join(hot, "h", "left_anti").repartition(shards, "shard").sortWithinPartitions("shard", "h", "s")
    runs = cold.mapInPandas(tidy(lambda batches: settled(batches, width)), "h long, s long, lo int, n int, least long")
    if not hot.isEmpty():
        large = segments.join(hot, "h", "left_semi").select("h", "s", "segment", "k")
        each = large.mapInPandas(tidy(windows), "h long, s long, k long, lo int, w binary")
        least = each.groupBy("w").agg(F.min("k").alias("least"), F.count("*").alias("n")).where("n > 1").select("w", "least")
        earlier = each.join(least.hint("merge"), "w").where("least < k").select("h", "s", "lo", F.lit(1).alias("n"), "least")
        own = large.select("h", "s", F.lit(0).alias("lo"), (F.length("segment") - (width - 1)).alias("n"), F.col("k").alias("least"))
        runs = runs.union(earlier).union(own)
    places = spots.where("kind = 0").select("h", "s", "k", "t", F.col("a").alias("at"))
    met = places.join(runs.hint("merge"), ["h", "s"]).where("least < k")
    spans = met.select("k", "t", (F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("lo") + F.col("n") + width - 1).alias("b"))
    spans = spans.union(spots.where("kind = 2").select("k", "t", "a", "b"))
    spans = kept(spans.unionByName(copies.select("k", "t", F.lit(0).alias("a"), F.col("size").alias("b"))), "repeat-spans")
    _release(spark)
    return spans


def _release(spark) -> None:
    """Let the driver drop its handles on shuffles that are done, so their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    spans = removed_spans(docs, id_col, text_col, width)
    lists = spans.groupBy("k", "t").agg(F.collect_list("a").alias("loomstead a"), F.collect_list("b").alias("loomstead b"))
    lists = lists.withColumnsRenamed({"k": "loomstead k", "t": "loomstead t"})
    body = F.col(text_col).cast("binary")
    return docs.join(lists.hint("merge"), (F.col(id_col).cast("long") == F.col("`loomstead k`")) & (F.xxhash64(body) == F.col("`loomstead t`")), "left").drop("loomstead k", "loomstead t")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` holds the remaining bytes.

    Null texts count as empty; rows without id stay whole; rows of one id do not touch each other; extra
    columns are ignored; an empty table gives no rows.
    """
    chunked = _Chunks(docs, id_col, text_col)
    spans = _spans(chunked, width)
    lists = spans.groupBy("k", "t").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).withColumn("c", chunked.of("k", "t"))

    def run(key, part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        cuts = {x: y for x, *y in zip(zip(found["k"].tolist(), found["t"].tolist()), found["a"], found["b"])}
        out = []
        for k, keyed, t, body in zip(part["k"].tolist(), part["keyed"], part["t"].tolist(), part["body"]):
            spans = _merged(*cuts[k, t]) if keyed and (k, t) in cuts else []
            edges = [0, *[x for s in spans for x in s], len(body)]
            out.append((k if keyed else None, len(body), sum(y - x for x, y in spans), len(spans), b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2]))))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})

    return chunked.rows.groupBy("c").cogroup(lists.groupBy("c")).applyInPandas(tidy_group(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The input with its texts cut: a character goes if all of its bytes are covered.  ``n_chars`` follows if it is there."""
    found = _with_spans(docs, id_col, text_col, width)

    @F.pandas_udf("string")
    def cut(body: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(body, lo, hi):
            if a is None or t is None:
                out.append(t)
                continue
            raw = np.frombuffer(t.encode(), np.uint8)
            stay = np.ones(len(raw), bool)
            for x, y in _merged(list(a), list(b)):
                stay[x:y] = False
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            width_ = np.diff(np.append(lead, len(raw)))
            out.append(raw[np.repeat(np.maximum.reduceat(stay, lead), width_)].tobytes().decode())
        return pd.Series(out)

    # Filters on the text stay above the cut: pushed below, they would cut every text twice, with a second Python worker a task.
    cut = cut.asNondeterministic()
    text = F.when(F.col("`loomstead a`").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("`loomstead a`"), F.col("`loomstead b`")))
    out = found.withColumn(text_col, text).drop("loomstead a", "loomstead b")
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
