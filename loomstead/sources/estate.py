"""Source estates as DataFrames of files: directories, in-memory trees, revisions; decoding and kinds.

``files`` here means (path string, content binary).  A file that cannot be read as text is a row with
``problem`` set, never an exception.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, content binary"
TEXTS = "path string, text string, encoding string, problem string"

# Kinds by extension, first match wins.
KINDS = (
    ("program", r"(?i)[.](cbl|cob|cobol|pco|sqb)$"), ("copybook", r"(?i)[.](cpy|copy|inc)$"), ("jcl", r"(?i)[.](jcl|prc|proc|job|cntl)$"), ("bms", r"(?i)[.]bms$"),
    ("csd", r"(?i)[.]csd$"), ("ims", r"(?i)[.](dbd|psb)$"), ("db2", r"(?i)[.](ddl|sql|db2)$"), ("pli", r"(?i)[.](pli|pl1|plx)$"), ("assembler", r"(?i)[.](asm|hlasm|mac|mlc|assemble)$"),
)
#: Kinds by the head of a text, where the extension says nothing.
HEADS = (
    ("jcl", r"(?m)^//[A-Z@#$][A-Z0-9@#$]{0,7} +JOB\b"), ("bms", r"(?m)^.{0,9}\s+DFHMS?D[A-Z]?\b"), ("program", r"(?im)^.{0,7}\s*(IDENTIFICATION|ID) +DIVISION"),
    ("csd", r"(?im)^\s*DEFINE +(TRANSACTION|PROGRAM|TDQUEUE|URIMAP)\b"), ("ims", r"(?m)^\s+(DBD|PCB) +"), ("db2", r"(?im)^\s*CREATE +(TABLE|VIEW|INDEX|PROCEDURE)\b"),
)


def directory(spark: SparkSession, root: str) -> DataFrame:
    """All files under a folder of any file system that Spark reads, by path relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    return found.select(F.substring_index("path", base + "/", -1).alias("path"), "content")


def memory(spark: SparkSession, files: dict[str, str | bytes]) -> DataFrame:
    """A tree held by the caller."""
    return spark.createDataFrame([(p, bytearray(c.encode() if isinstance(c, str) else c)) for p, c in files.items()], FILES)


def revision(spark: SparkSession, repository: str, rev: str, out: str, chunk_bytes: int = 32 << 20) -> DataFrame:
    """The blobs of a revision without a checkout, streamed through the driver in bounded chunks to ``out``."""
    listed = subprocess.run(["git", "-C", repository, "ls-tree", "-r", "-z", rev], capture_output=True, check=True).stdout
    entries = [e.split(b"\t", 1) for e in listed.split(b"\0") if e]
    blobs = [(meta.split()[2], name.decode("utf-8", "replace")) for meta, name in entries if meta.split()[1] == b"blob"]
    memory(spark, {}).write.mode("overwrite").parquet(out)
    with subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
        held, size = {}, 0
        for sha, name in blobs:
            git.stdin.write(sha + b"\n")
            git.stdin.flush()
            length = int(git.stdout.readline().split()[2])
            held[name] = git.stdout.read(length)
            git.stdout.read(1)
            size += length
            if size >= chunk_bytes:
                memory(spark, held).write.mode("append").parquet(out)
                held, size = {}, 0
        if held:
            memory(spark, held).write.mode("append").parquet(out)
        git.stdin.close()
    return spark.read.schema(FILES).parquet(out)


def looks_ebcdic(content: bytes) -> bool:
    """More than 60 % EBCDIC letters, digits and blanks and under 25 % ASCII ones in the first 8 KB; a NUL is binary."""
    head = content[:8192]
    if len(head) < 16 or 0 in head:
        return False
    there = lambda ok: sum(map(ok.__contains__, head)) / len(head)
    return there(_EBCDIC_TEXT) > 0.6 and there(_ASCII_TEXT) < 0.25


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
_EBCDIC_TEXT, _ASCII_TEXT = frozenset(_LETTERS.encode("cp037")), frozenset(_LETTERS.encode("ascii"))


def decode(content: bytes | None) -> tuple[str | None, str, str | None]:
    """(text, encoding, problem): EBCDIC, then UTF-8 where a byte is above 0x7F, then Latin-1."""
    if content is None:
        return None, "none", "unread"
    content = bytes(content)
    if looks_ebcdic(content):
        text = content.decode("cp037").replace("\x85", "\n")
        if text.count("\n") < len(text) // 160 and len(text) % 80 == 0:
            text = "\n".join(text[i : i + 80].rstrip() for i in range(0, len(text), 80))
        return text, "ebcdic", None
    if 0 in content[:8192]:
        return None, "binary", "binary"
    try:
        return content.decode("utf-8"), "utf-8", None
    except UnicodeDecodeError:
        return content.decode("latin-1"), "latin-1", None


def unframe(content: bytes) -> list[bytes]:
    """Records behind four-byte descriptors (big-endian length that includes them, then two zero bytes)."""
    out, at = [], 0
    while at + 4 <= len(content):
        length = int.from_bytes(content[at : at + 2], "big")
        if length < 4 or content[at + 2 : at + 4] != b"\0\0" or at + length > len(content):
            raise ValueError(f"no record descriptor at {at}")
        out.append(content[at + 4 : at + length])
        at += length
    if at != len(content):
        raise ValueError("bytes behind the last record")
    return out


def texts(files: DataFrame) -> DataFrame:
    """(path, text, encoding, problem, kind) of every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decode(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": [g[0] for g in got], "encoding": [g[1] for g in got], "problem": [g[2] for g in got]})

    return files.select("path", "content").mapInPandas(run, TEXTS).withColumn("kind", kind(F.col("path"), F.col("text")))


def kind(path: Column, text: Column) -> Column:
    """The kind by extension, then by the first 4 KB, else 'other'."""
    head = F.substring(text, 1, 4096)
    out = None
    for name, pattern in KINDS:
        out = (F if out is None else out).when(path.rlike(pattern), name)
    for name, pattern in HEADS:
        out = out.when(head.rlike(pattern), name)
    return out.otherwise("other")
