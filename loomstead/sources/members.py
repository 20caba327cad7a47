"""Named members (COPY, %INCLUDE): resolution to the nearest file and expansion of texts.

Resolution is joins, one level of nesting a round, so neither a library nor the closure is held in one
place; each file then gets the members it needs itself and expands its text where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.graph import fixpoint, hold

#: Nesting and inclusions at which an expansion is refused as a whole (the row says so).
DEPTH, INCLUSIONS = 16, 2000

_COPY = re.compile(r"(?<![\w-])COPY\s+['\"]?([\w$#@-]+)['\"]?(?:\s+(?:OF|IN)\s+['\"]?[\w$#@.-]+['\"]?)?(?:\s+SUPPRESS)?((?:\s+REPLACING\s+(?:[^.'\"=]|=(?!=)|'[^']*'|\"[^\"]*\"|==.*?==)*))?\s*\.", re.I | re.S)
_INCLUDE = re.compile(r"%INCLUDE\s+(?:[\w@#$]+\s*\(\s*)?'?([\w@#$]+)[\w@#$.]*'?\s*\)?\s*;", re.I)
_PAIR = re.compile(r"(LEADING\s+|TRAILING\s+)?(==.*?==|'[^']*'|\"[^\"]*\"|[^\s]+)\s+BY\s+(==.*?==|'[^']*'|\"[^\"]*\"|[^\s]+)", re.I | re.S)


def member_name(path: Column) -> Column:
    """The upper-case file name without its extension."""
    return F.upper(F.regexp_replace(F.substring_index(path, "/", -1), r"[.][^.]*$", ""))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def named_in(text: Column) -> Column:
    """Distinct upper-case names of members that a text names; names in comment cards do not count."""
    code = F.regexp_replace(text, r"(?m)^.{6}[*/].*$", "")
    copies = F.regexp_extract_all(code, F.lit(r"(?i)(?:^|[^\w-])COPY\s+['\"]?([\w$#@-]+)"), 1)
    includes = F.regexp_extract_all(code, F.lit(r"(?i)%INCLUDE\s+(?:[\w@#$]+\s*\(\s*)?'?([\w@#$]+)"), 1)
    return F.transform(F.array_distinct(F.concat(copies, includes)), F.upper)


def nearest(wanted: DataFrame, library: DataFrame) -> DataFrame:
    """(path, name, member) for ``wanted(path, name)``: the member in the same folder, then in the folder that
    shares most leading parts, then the least path.  A name without a member has a null member."""
    have = library.select("path").where("path is not null").select(F.col("path").alias("member"), member_name(F.col("path")).alias("name"), F.split(folder(F.col("path")), "/").alias("there")).distinct()
    here = F.split(folder(F.col("path")), "/")
    shared = F.aggregate(
        F.zip_with(here, F.col("there"), lambda a, b: a.eqNullSafe(b) & a.isNotNull()), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda s, same: F.struct((s["on"] & same).alias("on"), (s["n"] + (s["on"] & same).cast("int")).alias("n")),
    )["n"]
    met = wanted.join(have, "name", "left").where("member is null or member <> path")
    ranked = F.struct((here != F.col("there")).alias("other"), (-shared).alias("far"), F.col("member").alias("member"))
    found = met.groupBy("path", "name").agg(F.min(F.when(F.col("member").isNotNull(), ranked)).alias("best")).select("path", "name", F.col("best.member").alias("member"))
    return wanted.distinct().join(found, ["path", "name"], "left")


def closure(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(path, by, name, member, level): all members a text needs, directly or through members, by least level.

    Members are chosen from where the naming text lies.  A member that comes back to itself ends there.
    """
    names = texts.where("path is not null").select("path", F.explode(named_in(F.coalesce("text", F.lit("")))).alias("name"))
    direct = hold(nearest(names, texts).select(F.col("path").alias("by"), "name", F.coalesce("member", F.lit("")).alias("member")))

    def deeper(rim: DataFrame) -> DataFrame:
        return rim.where("member <> ''").select("path", F.col("member").alias("by")).distinct().join(direct, "by")

    found = fixpoint(direct.withColumn("path", F.col("by")), deeper, ["path", "by", "name", "member"], depth - 1)
    return found.select("path", "by", "name", F.nullif("member", F.lit("")).alias("member"), (F.col("level") + 1).alias("level"))


def replacing(clause: str | None) -> list[tuple[re.Pattern, str]]:
    """Patterns and replacements of a REPLACING clause: whole words, or leading or trailing parts of words."""
    out = []
    strip = lambda x: x[2:-2].strip() if x.startswith("==") else x
    for m in _PAIR.finditer(re.sub(r"^\s*REPLACING", "", clause or "", flags=re.I)):
        side, old, new = (m[1] or "").strip().upper(), strip(m[2]), strip(m[3])
        if not old:
            continue
        body = r"\s+".join(map(re.escape, old.split()))
        left = r"(?<![\w-])" if side != "TRAILING" and re.match(r"[\w-]", old) else ""
        right = r"(?![\w-])" if side != "LEADING" and re.search(r"[\w-]$", old) else ""
        out.append((re.compile(left + body + right, re.I), new))
    return out


def expand(text: str, path: str, where: dict[tuple[str, str], str], member_texts: dict[str, str], depth: int = DEPTH, most: int = INCLUSIONS) -> tuple[str, list[str], list[str]]:
    """(expanded text, names missing, problems).  Missing members leave their statement as it stands; a member
    that includes itself, a nesting over ``depth`` and inclusions over ``most`` are problems."""
    missing, problems, count = [], [], 0

    def once(body: str, at: str, chain: tuple[str, ...]) -> str:
        def put(name: str, clause: str | None, whole: str) -> str:
            nonlocal count
            member = where.get((at, name.upper()))
            if member is None or member not in member_texts:
                missing.append(name.upper())
                return whole
            if member in chain:
                problems.append(f"{name.upper()} includes itself")
                return whole
            if len(chain) > depth or count >= most:
                problems.append(f"{name.upper()} lies beyond the limits")
                return whole
            count += 1
            inner = once(member_texts[member], member, (*chain, member))
            for old, new in replacing(clause):
                inner = old.sub(lambda _, new=new: new, inner)
            return "\n" + inner.rstrip("\n") + "\n"

        lines = body.split("\n")
        comments = {i: x for i, x in enumerate(lines) if len(x) > 6 and x[6] in "*/" and not x[:6].strip().startswith("%")}
        body = "\n".join(f"\0{i}\0" if i in comments else x for i, x in enumerate(lines))
        body = _COPY.sub(lambda m: put(m[1], m[2], m[0]), body)
        body = _INCLUDE.sub(lambda m: put(m[1], None, m[0]), body)
        return re.sub("\0(\\d+)\0", lambda m: comments[int(m[1])], body)

    return once(text, path, (path,)), missing, problems


def expanded(texts: DataFrame) -> DataFrame:
    """(path, kind, text, missing, problems) of every file with its members in place.

    Null texts stay null.  Files that name no member pass through without their text being shuffled for members.
    """
    needs = closure(texts)
    pieces = needs.where("member is not null").join(texts.select(F.col("path").alias("member"), F.col("text").alias("member_text")), "member")
    held = pieces.groupBy("path").agg(
        F.collect_set(F.struct("by", "name", "member")).alias("ways"), F.collect_set(F.struct("member", F.coalesce("member_text", F.lit("")).alias("member_text"))).alias("parts")
    )
    named = needs.select("path").distinct()
    rows = texts.select("path", "kind", "text").join(named, "path", "left_semi").join(held, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text, ways, parts in zip(b["path"], b["text"], b["ways"], b["parts"]):
                if not isinstance(text, str):
                    out.append((None, [], []))
                    continue
                where = {(w["by"], w["name"]): w["member"] for w in ways} if ways is not None else {}
                have = {p["member"]: p["member_text"] for p in parts} if parts is not None else {}
                out.append(expand(text, path, where, have))
            yield pd.DataFrame({"path": b["path"], "kind": b["kind"], "text": [o[0] for o in out], "missing": [o[1] for o in out], "problems": [o[2] for o in out]})

    schema = "path string, kind string, text string, missing array<string>, problems array<string>"
    done = rows.mapInPandas(run, schema)
    plain = texts.join(named, "path", "left_anti").select("path", "kind", "text", F.array().cast("array<string>").alias("missing"), F.array().cast("array<string>").alias("problems"))
    return done.unionByName(plain)
