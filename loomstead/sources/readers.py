"""Facts of job control, screen maps, resource definitions, database definitions and DDL; other languages join in ``facts``.

Each reader is a generator over one text; ``facts`` runs the reader of each file's kind in Arrow
batches and gives one long table.  A text that a reader cannot follow gives a 'problem' fact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.sources import cobol, hlasm, pli
from loomstead.sources.macros import macro_statements, operand_field, operand_map, split_operands

FACTS = "path string, kind string, fact string, line int, name string, parent string, value string, operands map<string,string>"


class Fact(NamedTuple):
    fact: str
    line: int
    name: str | None = None
    parent: str | None = None
    value: str | None = None
    operands: dict[str, str] = {}


def substitute(text: str, symbols: dict[str, str]) -> str:
    """&NAME and &NAME. by their values; unknown names stay."""
    return re.sub(r"&([A-Z@#$][A-Z0-9@#$]{0,7})[.]?", lambda m: symbols.get(m[1], m[0]), text)


def jcl_statements(text: str) -> Iterator[tuple[int, str, str, str, list[str]]]:
    """(line, name, operation, operands, in-stream data): continuations joined, comments left out."""
    lines = [x[:72].rstrip() if len(x) > 72 else x.rstrip() for x in text.split("\n")]
    i = 0
    while i < len(lines):
        line = lines[i]
        head = re.match(r"//([A-Z0-9@#$.]*) +([A-Z]+)(?: +(.*))?$", line)
        if line.startswith("//*") or not head:
            i += 1
            continue
        at, operands = i + 1, operand_field(head[3] or "")
        i += 1
        while operands.endswith(",") and i < len(lines) and lines[i].startswith("//"):
            if not lines[i].startswith("//*"):
                more = re.match(r"// +(.*)$", lines[i])
                if not more:
                    break
                operands += operand_field(more[1])
            i += 1
        data: list[str] = []
        given = operand_map(operands)
        if head[2] == "DD" and given.get("$0") in ("*", "DATA"):
            end = given.get("DLM", "/*").strip("'")
            while i < len(lines) and not lines[i].startswith(end) and not (given["$0"] == "*" and "DLM" not in given and lines[i].startswith("//")):
                data.append(lines[i])
                i += 1
        yield at, head[1], head[2], operands, data


def read_jcl(text: str) -> Iterator[Fact]:
    """Jobs, steps, DDs with data sets, procedures, includes and symbols, in order."""
    job = proc = step = None
    ddname = ""
    symbols: dict[str, str] = {}
    for line, name, op, raw, data in jcl_statements(text):
        given = operand_map(substitute(raw, symbols))
        if op == "JOB":
            job, step, symbols = name, None, {}
            yield Fact("job", line, name, None, None, given)
        elif op == "PROC":
            proc, step = name or None, None
            symbols |= {k: v.strip("'") for k, v in operand_map(raw).items() if not k.startswith("$")}
            yield Fact("proc", line, name or None, job, None, given)
        elif op == "PEND":
            proc = step = None
        elif op == "SET":
            symbols |= {k: v.strip("'") for k, v in given.items() if not k.startswith("$")}
            for k, v in given.items():
                yield Fact("symbol", line, k, job, v.strip("'"))
        elif op == "EXEC":
            step, ddname = name, ""
            target = given.get("PGM")
            yield Fact("step" if target else "call", line, name, proc or job, target or given.get("PROC") or given.get("$0"), given)
        elif op == "INCLUDE":
            yield Fact("include", line, given.get("MEMBER"), job)
        elif op == "DD":
            ddname = name or ddname  # a DD without a name goes on with the one before
            value = given.get("DSN") or given.get("DSNAME") or ("SYSOUT" if "SYSOUT" in given else "DUMMY" if given.get("$0") == "DUMMY" else None)
            yield Fact("dd", line, ddname, step, value, given)
            for k, row in enumerate(data):
                yield Fact("data", line + k + 1, ddname, step, row)


#: Macros that open a level, with the level's name; each other macro is a fact below the last one.
_LEVELS = {"DFHMSD": 0, "DFHMDI": 1, "DFHMDF": 2, "DBD": 0, "DATASET": 1, "SEGM": 1, "FIELD": 2, "XDFLD": 2, "LCHILD": 2, "PCB": 0, "SENSEG": 1, "SENFLD": 2, "PSBGEN": 0}
_NAMES = {"DFHMSD": "mapset", "DFHMDI": "map", "DFHMDF": "field", "SEGM": "segment", "PSBGEN": "psb"}


def read_macros(text: str) -> Iterator[Fact]:
    """Map sets, maps and fields; databases, segments and fields; PCBs and their segments.  ``parent`` is the level above."""
    open_: dict[int, str] = {}
    for line, label, op, raw in macro_statements(text):
        if op not in _LEVELS:
            continue
        given = operand_map(raw)
        if given.get("TYPE") == "FINAL":
            continue
        level = _LEVELS[op]
        name = label or given.get("NAME", given.get("PSBNAME", given.get("DBDNAME", ""))).strip("()").split(",")[0] or None
        yield Fact(_NAMES.get(op, op.lower()), line, name, open_.get(level - 1), given.get("INITIAL", given.get("PICOUT", given.get("PROCOPT"))), given)
        open_ = {k: v for k, v in open_.items() if k < level} | {level: name}


def read_csd(text: str) -> Iterator[Fact]:
    """DEFINE statements: resource type, name and attributes; an attribute list runs to the next DEFINE."""
    lines = [x for x in text.split("\n")]
    held: list[tuple[int, str]] = []
    for n, line in enumerate(lines, 1):
        line = line[:72]
        if line.startswith("*"):
            continue
        if re.match(r"\s*DEFINE\s", line, re.I):
            held.append((n, line.strip()))
        elif held and not re.match(r"\s*(ADD|DELETE|LIST|ALTER|INSTALL)\s", line, re.I):
            held[-1] = (held[-1][0], f"{held[-1][1]} {line.strip()}")
    for n, statement in held:
        given = {k.upper(): v.strip() for k, v in re.findall(r"([A-Za-z0-9]+)\s*\(((?:[^()]|\([^()]*\))*)\)", statement)}
        kind = re.match(r"DEFINE\s+([A-Za-z0-9]+)", statement, re.I)
        if kind and kind[1].upper() in given:
            yield Fact(kind[1].lower(), n, given[kind[1].upper()], given.get("GROUP"), given.get("PROGRAM"), given)


_DDL = re.compile(r"\s*(CREATE(?:\s+OR\s+REPLACE)?|ALTER|DROP|GRANT|REVOKE|COMMENT\s+ON|LABEL\s+ON|RENAME|SET)\s+(.*)", re.I | re.S)


def sql_statements(text: str) -> Iterator[tuple[int, str]]:
    """(line, statement) between semicolons outside quotes and comments."""
    at, start, word = 0, None, []
    for m in re.finditer(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|;|[^;'\"/-]+|.", text, re.S):
        token = m[0]
        if token.startswith("--") or token.startswith("/*"):
            continue
        if token == ";":
            if word:
                yield start, "".join(word).strip()
            start, word = None, []
        elif word or token.strip():
            if start is None:
                at = m.start() + len(token) - len(token.lstrip())
                start = text.count("\n", 0, at) + 1
            word.append(token)
    if "".join(word).strip():
        yield start, "".join(word).strip()


def read_ddl(text: str) -> Iterator[Fact]:
    """Each statement's verb, object type and name; grants with privileges, object and grantees; columns of tables."""
    for line, s in sql_statements(text):
        m = _DDL.match(s)
        if not m:
            yield Fact("sql", line, None, None, s.split(None, 1)[0].upper())
            continue
        verb, rest = m[1].split()[0].upper(), m[2]
        if verb in ("GRANT", "REVOKE"):
            g = re.match(r"(.*?)\s+ON\s+(?:(?:TABLE|PACKAGE|PROCEDURE|FUNCTION|DATABASE|SCHEMA|PLAN)\s+)?(\S+)\s+(?:TO|FROM)\s+(.*)", rest, re.I | re.S)
            to = (g[3] if g else rest.rsplit(None, 1)[-1]).strip()
            yield Fact(verb.lower(), line, g[2] if g else None, None, re.sub(r"\s+", " ", g[1] if g else rest).upper(), {"TO": re.sub(r"\s+WITH\s+GRANT\s+OPTION", "", to, flags=re.I), "GRANTABLE": str("WITH GRANT OPTION" in rest.upper()).lower()})
            continue
        o = re.match(r"((?:(?:UNIQUE|GLOBAL|TEMPORARY|LARGE|PUBLIC|AUXILIARY|DISTINCT)\s+)*[A-Za-z]+)\s+([\w.$#@\"]+)(.*)", rest, re.S)
        if not o:
            continue
        kind = o[1].split()[-1].upper()
        yield Fact(f"{verb.lower()}-{kind.lower()}", line, o[2], None, kind)
        if verb == "CREATE" and kind == "TABLE":
            for e in re.finditer(r"\b(EDITPROC|VALIDPROC|FIELDPROC)\s+([\w$#@]+)", o[3], re.I):
                yield Fact("exit-routine", line, e[2].upper(), o[2], e[1].upper())
        if verb == "CREATE" and kind in ("PROCEDURE", "FUNCTION"):
            e = re.search(r"\bEXTERNAL\b(?:\s+NAME\s+(?:'([^']*)'|\"?([\w$#@.!]+)\"?))?", o[3], re.I)
            if e:
                yield Fact("external-routine", line, o[2], None, e[1] or e[2])
        body = re.search(r"\((.*)\)", o[3], re.S)
        if verb == "CREATE" and kind == "TABLE" and body:
            for part in split_operands(body[1]):
                c = re.match(r"\s*([\w$#@]+)\s+([A-Za-z]+(?:\s*\([^)]*\))?)(.*)", part, re.S)
                if c and c[1].upper() not in ("PRIMARY", "FOREIGN", "CONSTRAINT", "UNIQUE", "CHECK", "LIKE", "PERIOD"):
                    yield Fact("column", line, c[1], o[2], re.sub(r"\s+", "", c[2]).upper(), {"NULLS": "no" if "NOT NULL" in c[3].upper() else "yes"})


READERS: dict[str, Callable[[str], Iterator[Fact]]] = {"jcl": read_jcl, "bms": read_macros, "ims": read_macros, "csd": read_csd, "db2": read_ddl}


#: Readers in modules of their own, whose rows have the fields of a fact.
FOREIGN = {"program": cobol.read, "copybook": cobol.read, "assembler": hlasm.read, "pli": pli.read}


def _read(kind: str, text: str | None) -> Iterator[Fact]:
    if text is None:
        yield Fact("problem", 0, value="unread")
    elif kind in FOREIGN:
        yield from (Fact(*row) for row in FOREIGN[kind](text))
    elif kind in READERS:
        yield from READERS[kind](text)


def facts(texts: DataFrame) -> DataFrame:
    """Facts of all files of ``texts(path, text, kind)``; kinds without a reader give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text, kind in zip(b["path"], b["text"], b["kind"]):
                try:
                    rows = list(_read(kind, text if isinstance(text, str) else None))
                except (ValueError, IndexError) as e:
                    rows = [Fact("problem", 0, value=str(e))]
                if rows:
                    out = pd.DataFrame(rows, columns=Fact._fields)
                    yield out.assign(path=path, kind=kind)[["path", "kind", "fact", "line", "name", "parent", "value", "operands"]]

    return texts.select("path", "text", F.col("kind")).mapInPandas(run, FACTS)
