"""Token ids as binary shards with a minimal perfect hash index over document keys.

A shard file is a self-contained image:

    b"LSTK" | u32 header bytes | JSON header | sections

The header names each section's offset and dtype.  ``ids`` is the raw payload
(unsigned 16 bit when the vocabulary fits, else 32 bit), ``starts`` the payload
offset of each document, ``keys`` the ascending document keys.  The index is a
level-wise minimal perfect hash: ``bits`` holds each level's bit array,
``ranks`` the number of ones before each 64-bit word, and the slots hold a
32-bit key fingerprint, the key's first row and its number of rows.  A lookup
hashes the key, reads one slot, compares the fingerprint and slices the payload.

Files are written by Spark's own text writer, one image a record and a file, so
commits are atomic, a lost executor's files are written again and any file
system that Spark knows will do.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.llm.common import by_size, fresh_path, shuffle_width, tidy

MAGIC = b"LSTK"
SEPARATOR = "\nLSTK-END\n"
END_ID = 1
_GAMMA = 2.0


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    with np.errstate(over="ignore"):
        h = x.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class MinimalPerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1, about 3 bits a key.

    At each level the keys hash into a bit array; keys alone in their cell keep
    it, the others go to the next level.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        sizes, words, left, level = [], [], keys, 0
        while len(left):
            size = max(64, -(-int(len(left) * _GAMMA) // 64) * 64)
            cell = mix64(left, level) % np.uint64(size)
            alone = np.bincount(cell.astype(np.int64), minlength=size)[cell.astype(np.int64)] == 1
            flags = np.zeros(size, np.uint8)
            flags[cell[alone].astype(np.int64)] = 1
            words.append(np.packbits(flags, bitorder="little").view(np.uint64))
            sizes.append(size)
            left, level = left[~alone], level + 1
            if level > 200:
                raise ValueError("keys are not distinct")
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ones = np.bitwise_count(bits).astype(np.uint32)
        return cls(sizes, bits, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(ones) else ones)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; keys never seen get any slot or -1, which the fingerprint settles."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            cell = (mix64(keys[todo], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.bits[cell >> 6], (cell & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = self.ranks[cell[hit] >> 6] + below[hit]
            todo, base = todo[~hit], base + size
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 977) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: np.ndarray, n_null: int, lengths: np.ndarray, ids: np.ndarray, part: int, seq: int, before: int) -> bytes:
    """One shard image.  ``keys`` ascend and may repeat; the first ``n_null`` rows have no key."""
    distinct, first, run = np.unique(keys[n_null:], return_index=True, return_counts=True)
    index = MinimalPerfectHash.build(distinct)
    order = np.argsort(index.slots(distinct))
    sections = {
        "ids": ids,
        "starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64),
        "keys": keys.astype(np.int64),
        "bits": index.bits,
        "ranks": index.ranks,
        "fingerprints": fingerprints(distinct)[order],
        "first": (first[order] + n_null).astype(np.uint32),
        "run": run[order].astype(np.uint32),
    }
    layout, at = {}, 0
    for name, a in sections.items():
        layout[name] = [at, len(a), a.dtype.str]
        at += a.nbytes + -a.nbytes % 8
    header = json.dumps({"part": part, "seq": seq, "before": before, "n_docs": len(keys), "n_null": n_null, "n_ids": len(ids), "levels": index.sizes, "sections": layout}).encode()
    header += b" " * (-len(header) % 8)
    out = [MAGIC, len(header).to_bytes(4, "little"), header]
    for a in sections.values():
        out += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    return b"".join(out)


class Shard:
    """Reads a shard image without copying its payload."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(image[4:8], "little")
        self.header = json.loads(image[8 : 8 + size])
        self.part = {name: np.frombuffer(image, np.dtype(kind), count, 8 + size + at) for name, (at, count, kind) in self.header["sections"].items()}
        self.index = MinimalPerfectHash(self.header["levels"], self.part["bits"], self.part["ranks"])

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; a key that is not held has no rows."""
        first, run = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(self.part["run"]):
            slot = self.index.slots(keys)
            ok = (slot >= 0) & (self.part["fingerprints"][slot] == fingerprints(keys))
            first[ok], run[ok] = self.part["first"][slot[ok]], self.part["run"][slot[ok]]
        return first, run

    def ids(self, row: int) -> np.ndarray:
        a, b = self.part["starts"][row], self.part["starts"][row + 1]
        return self.part["ids"][int(a) : int(b)].astype("<u4")


#: Marks that end a chunk as one pre-token of their own, however many follow each other.
_MARKS = ".,;:!?%&#*$"


class ChunkEncoder:
    """Encodes whole texts through the tokenizers library, each distinct space-free chunk once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks in order.  It also drops case, so Latin-1 texts are lower-cased first.  A word with marks
    behind it is two pre-tokens, of which the word is encoded once.  New words go through the
    tokenizer together with a space between, and are told apart by the ids that end a word; other
    new chunks are divided by a special token; chunks that may hold one themselves go through the
    tokenizer alone, and as special tokens have their case, texts with one are not lower-cased first.
    What was used since the cache last held ``most``
    chunks stays, which bounds the memory.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.split, self.plain, self.most = Tokenizer.from_file(path), Tokenizer.from_file(path), most
        self.plain.encode_special_tokens = True
        self.mark = "<|endoftext|>"
        self.mark_id = self.split.token_to_id(self.mark)
        vocab = self.plain.get_vocab()
        self.kind = np.dtype("<u2") if len(vocab) <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _unknown(self, chunks: set[str]) -> list[str]:
        """The chunks to encode; those of the older generation move to the younger one."""
        new = []
        for c in chunks:
            if c not in self.cache:
                if c in self.old:
                    self.cache[c] = self.old[c]
                else:
                    new.append(c)
        return new

    def _learn(self, chunks: list[str]) -> None:
        pairs, words, rest = [], set(), set()
        for c in chunks:
            word = c.rstrip(_MARKS)
            if word.isalpha() and max(word) <= "ÿ":
                words.add(word)
                if len(word) < len(c):
                    pairs.append((c, word, c[len(word) :]))
                    rest.add(c[len(word) :])
            else:
                rest.add(c)
        self._encode_words(self._unknown(words))
        self._encode_rest(self._unknown(rest))
        cache = self.cache
        for c, word, marks in pairs:
            cache[c] = cache[word] + cache[marks]

    def _encode_words(self, new: list[str]) -> None:
        w = self.kind.itemsize
        for k in range(0, len(new), 500):
            part = new[k : k + 500]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * w).tolist()
            if len(ends) != len(part):
                raise ValueError("a word is not one pre-token of this tokenizer")
            raw = ids.tobytes()
            self.cache.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends))))

    def _encode_rest(self, new: list[str]) -> None:
        odd = [c for c in new if "<|" in c]
        new = [c for c in new if "<|" not in c]
        for c in odd:
            self.cache[c] = np.array(self.split.encode(c, add_special_tokens=False).ids, self.kind).tobytes()
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            ids = np.array(self.split.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.mark_id)
            raw, w = ids.tobytes(), self.kind.itemsize
            ends = [*(cuts * w).tolist(), len(raw)]
            begins = [0, *((cuts + 1) * w).tolist()]
            self.cache.update(zip(part, (raw[a:b] for a, b in zip(begins, ends))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Raw little-endian ids of each text, without an end id."""
        chunks = [_lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.cache) > self.most:
            self.cache, self.old = {"": b""}, self.cache
        new = self._unknown(set().union(*chunks))
        if new:
            self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, d)) for d in chunks]


def _lowered(text: str) -> str:
    """Lower case where Python's and the tokenizer's lower-casing and composing agree: in Latin-1 texts."""
    if "<|" in text:  # special tokens are told apart by case
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


_IMAGE = T.StructType([T.StructField("image", T.BinaryType())])
_READ = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part_ids", T.LongType()),
])


def write_token_shards(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 2_000_000, end_id: int = END_ID) -> str:
    """Tokenize documents and write shard files in ascending key order; returns the folder.

    The rows are range-partitioned by key, then each task streams its rows and closes a shard after
    ``shard_ids`` ids (a longer document fills a shard alone), so memory is bounded by one shard.

    Null text: no ids but the end id.  Null key: rows come first and are found by scanning only.
    Repeated keys: every row is stored; a lookup returns all of them.  Empty table: no shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    width = shuffle_width(docs.sparkSession)
    rows = rows.repartitionByRange(width, F.col("k"), F.xxhash64("t")).sortWithinPartitions("k", "t")

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.kind).tobytes()
        keys: list[int | None] = []
        raw: list[bytes] = []
        held, seq, before = 0, 0, 0

        def close() -> pd.DataFrame:
            nonlocal keys, raw, held, seq, before
            n_null = sum(k is None for k in keys)
            lengths = np.array([len(r) for r in raw], np.int64) // enc.kind.itemsize
            image = pack_shard(np.array([k or 0 for k in keys], np.int64), n_null, lengths, np.frombuffer(b"".join(raw), enc.kind), part, seq, before)
            before, seq = before + int(lengths.sum()), seq + 1
            keys, raw, held = [], [], 0
            return pd.DataFrame({"image": [image]})

        for b in batches:
            ks = [None if pd.isna(k) else int(k) for k in b["k"].astype(object)]
            texts = b["t"].tolist()
            for rows_ in by_size([len(t) + 256 for t in texts], 1 << 20):
                for k, r in zip(ks[rows_], enc.encode(texts[rows_])):
                    keys.append(k)
                    raw.append(r + end)
                    held += len(r) // enc.kind.itemsize + 1
                    if held >= shard_ids:
                        yield close()
        if keys:
            yield close()

    path = path or fresh_path(docs.sparkSession, "tokens")
    made = rows.mapInPandas(tidy(images), _IMAGE).select(F.col("image").cast("string").alias("value"))
    made.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    return path


def read_token_shards(spark, path: str) -> DataFrame:
    """One row per stored document: each key is hashed to its slot, and the rows found there are cut from the payload.

    Rows without key have no slot and are read from the front of their shard.

    ``start`` counts the ids of all documents before it.  Shards know the ids before them in their
    partition, so only one total per partition goes to the driver.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for image in b["content"]:
                s = Shard(image)
                head = s.header
                wanted = np.unique(s.part["keys"][head["n_null"] :])
                first, run = s.rows(wanted)
                # Where the hash sends each key, plus the rows without key at the front.
                row = np.repeat(first - np.cumsum(run) + run, run) + np.arange(int(run.sum()))
                row = np.concatenate([np.arange(head["n_null"]), row])
                if len(np.unique(row)) != head["n_docs"]:
                    raise ValueError("the index of a token shard is damaged")
                keys = pd.array([None] * head["n_null"] + np.repeat(wanted, run).tolist(), "Int64")
                starts = s.part["starts"].astype(np.int64)
                yield pd.DataFrame({
                    "doc_id": keys, "part": np.full(len(row), head["part"], np.int32), "local_start": head["before"] + starts[row], "n_tokens": starts[row + 1] - starts[row],
                    "ids_crc32": [zlib.crc32(s.ids(i).tobytes()) for i in row.tolist()], "part_ids": np.full(len(row), head["before"] + head["n_ids"], np.int64),
                })

    found = spark.read.format("binaryFile").load(path).select("content")
    return found.mapInPandas(tidy(rows), _READ)


def with_starts(stored: DataFrame) -> DataFrame:
    """Turn partition-local starts into global ones; one row a partition goes to the driver."""
    totals = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.max("part_ids").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = stored.sparkSession.createDataFrame(bases, "part int, base long")
    joined = stored.join(F.broadcast(base), "part", "left")
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Token ids of the wanted keys: each shard answers for the keys in its range through its index.

    Keys meet shards by a join on key range.  Every shard is read for its range, and again if a key falls into it.
    Null keys and keys that are not stored give no row; repeated keys give every stored row.
    """
    schema = "key long, ids array<long>"
    shards = spark.read.format("binaryFile").load(path).select("path", "content")

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, image in zip(b["path"], b["content"]):
                s = Shard(image)
                held = s.part["keys"][s.header["n_null"] :]
                if len(held):
                    yield pd.DataFrame({"path": [p], "lo": [int(held[0])], "hi": [int(held[-1])]})

    spans = shards.mapInPandas(span, "path string, lo long, hi long")
    want = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
    routed = want.join(spans, F.col("key").between(F.col("lo"), F.col("hi"))).select("path", "key")

    def answer(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out_k, out_i = [], []
        if len(left) and len(right):
            s = Shard(right["content"].iloc[0])
            ks = left["key"].to_numpy(np.int64)
            for k, f, r in zip(ks, *s.rows(ks)):
                for row in range(f, f + r):
                    if s.part["keys"][row] == k:
                        out_k.append(int(k))
                        out_i.append(s.ids(row).astype(np.int64).tolist())
        return pd.DataFrame({"key": pd.Series(out_k, dtype="int64"), "ids": pd.Series(out_i, dtype=object)})

    return routed.groupBy("path").cogroup(shards.groupBy("path")).applyInPandas(answer, schema)
