"""PL/I source as facts: procedures, declarations with layout, calls, files, conditions, embedded commands.

Statements end at semicolons outside quotes and comments.  A structure's size adds up only while the
sizes of all its parts are known; a bound or length that is no number leaves it unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Row = tuple[str, int, str | None, str | None, str | None, dict[str, str]]

_PIECES = re.compile(r"/\*.*?(?:\*/|$)|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|;|[^/'\";]+|.", re.S)
_LABEL = re.compile(r"\s*([A-Z_@#$][\w@#$]*(?:\s*\(\s*-?\d+\s*\))?)\s*:(?!:)\s*", re.I)
_WORD = re.compile(r"[A-Z_@#$%][\w@#$]*", re.I)

#: First words of statements and the fact each gives.
VERBS = {
    "control": ("DO", "IF", "ELSE", "SELECT", "WHEN", "OTHERWISE", "OTHER", "LEAVE", "ITERATE", "GOTO", "GO", "RETURN", "STOP", "EXIT", "BEGIN", "PACKAGE"),
    "io": ("OPEN", "CLOSE", "READ", "WRITE", "REWRITE", "DELETE", "LOCATE", "PUT", "GET", "DISPLAY", "FLUSH", "FORMAT"),
    "condition": ("ON", "SIGNAL", "REVERT", "RESIGNAL"),
    "storage": ("ALLOCATE", "ALLOC", "FREE"),
    "fetch": ("FETCH", "RELEASE"),
}
_FACT_OF = {word: fact for fact, words in VERBS.items() for word in words}


def statements(text: str) -> Iterator[tuple[int, str]]:
    """(line, statement) without comments; literals stay."""
    line, begun, held = 1, 0, ""
    for piece in _PIECES.findall(text):
        if piece == ";":
            if held.strip():
                yield begun, held.strip()
            held, begun = "", 0
        else:
            if piece.startswith("/*"):
                held += " "
            else:
                if piece.strip() and not begun:
                    begun = line + piece[: len(piece) - len(piece.lstrip())].count("\n")
                held += piece
        line += piece.count("\n")
    if held.strip():
        yield begun, held.strip()


def in_margins(text: str) -> str:
    """Columns 2 to 72 if every line that is longer ends in a sequence number, else the text as it is."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    if any(len(x) > 72 for x in lines) and all(re.fullmatch(r"[\d ]*", x[72:]) for x in lines):
        return "\n".join(" " + x[1:72] for x in lines)
    return text


def parted(text: str, at: str = ",") -> list[str]:
    """Parts between separators outside parentheses and quotes."""
    out, depth, word = [], 0, ""
    for piece in re.findall(r"'(?:[^']|'')*'|.", text, re.S):
        depth += (piece == "(") - (piece == ")")
        if piece == at and depth <= 0:
            out.append(word.strip())
            word = ""
        else:
            word += piece
    return [*out, word.strip()] if word.strip() or out else []


def _bracket(text: str) -> tuple[str, str]:
    """(inside, behind) of a text that starts with a parenthesis."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return text[1:i], text[i + 1 :]
    raise ValueError("an open parenthesis")


def element_size(attributes: str) -> int | None:
    """Bytes of one element by its attributes; null where they do not tell."""
    a = attributes.upper()
    length = re.search(r"\b(?:CHARACTER|CHAR|WIDECHAR|WCHAR|GRAPHIC|BIT)\s*\(\s*(\d+)\s*\)", a)
    if re.search(r"\b(CHARACTER|CHAR|WIDECHAR|WCHAR|GRAPHIC|BIT)\b", a):
        if re.search(r"\b(?:CHARACTER|CHAR|WIDECHAR|WCHAR|GRAPHIC|BIT)\s*\(", a) and not length:
            return None
        n = int(length[1]) if length else 1
        n = (n + 7) // 8 if re.search(r"\bBIT\b", a) else n * 2 if re.search(r"\b(WIDECHAR|WCHAR|GRAPHIC)\b", a) else n
        return n + (2 if re.search(r"\bVAR(YING)?\b", a) else 0)
    picture = re.search(r"\bPIC(?:TURE)?\s*'([^']*)'", a)
    if picture:
        plain = re.sub(r"\((\d+)\)(.)", lambda m: m[2] * int(m[1]), picture[1])
        return len(re.sub(r"[VK]", "", re.sub(r"F\(-?\d+\)", "", plain)))
    if re.search(r"\b(POINTER|PTR|OFFSET|HANDLE)\b", a):
        return 4
    precision = re.search(r"\(\s*(\d+)\s*(?:,\s*-?\d+\s*)?\)", a)
    if re.search(r"\bFLOAT\b", a):
        digits = int(precision[1]) if precision else 6
        short, long_ = (21, 53) if re.search(r"\bBIN(ARY)?\b", a) else (6, 16)
        return 4 if digits <= short else 8 if digits <= long_ else 16
    if re.search(r"\bBIN(ARY)?\b", a):
        bits = int(precision[1]) if precision else 15
        bits += 0 if re.search(r"\bUNSIGNED\b", a) else 1
        return 1 if bits <= 8 else 2 if bits <= 16 else 4 if bits <= 32 else 8
    if re.search(r"\b(FIXED|DEC(IMAL)?)\b", a):
        return (int(precision[1]) if precision else 5) // 2 + 1
    return None


def _elements(bounds: str | None) -> int | None:
    n = 1
    for b in parted(bounds) if bounds else ():
        m = re.fullmatch(r"(?:(-?\d+)\s*:\s*)?(-?\d+)", b)
        if not m:
            return None
        n *= int(m[2]) - int(m[1] or 1) + 1
    return n


def declared(body: str) -> list[dict]:
    """Items of a DECLARE: level, name, bounds, attributes; factored names share attributes."""
    out = []
    for part in parted(body):
        m = re.match(r"\s*(\d+)?\s*", part)
        level, rest = int(m[1] or 1), part[m.end() :]
        if rest.startswith("("):
            inside, behind = _bracket(rest)
            for item in declared(inside):
                out.append(item | {"level": item["level"] if not m[1] else level, "attributes": f"{item['attributes']} {behind}".strip()})
            continue
        name = _WORD.match(rest)
        if not name:
            continue
        rest, bounds = rest[name.end() :].strip(), None
        if rest.startswith("("):
            bounds, rest = _bracket(rest)
        else:
            dim = re.match(r"DIM(?:ENSION)?\s*(?=\()", rest, re.I)
            if dim:
                bounds, rest = _bracket(rest[dim.end() :])
        out.append({"level": level, "name": name[0], "bounds": bounds, "attributes": re.sub(r"\s+", " ", rest).strip(), "leveled": bool(m[1])})
    return out


def layout(items: list[dict]) -> None:
    """``parent``, ``offset`` and ``size`` of each item, without padding; after an unknown size offsets are unknown."""

    def place(i: int, offset: int | None, parent: str | None) -> int:
        item, at, j = items[i], offset, i + 1
        item["parent"], item["offset"] = parent, offset
        one: int | None = 0
        while j < len(items) and items[j]["leveled"] and items[j]["level"] > item["level"]:
            if one is None:
                at = None
            k = place(j, at, item["name"])
            size = items[j]["size"]
            one = None if one is None or size is None else one + size
            at = None if at is None or size is None else at + size
            j = k
        if j == i + 1:
            one = element_size(item["attributes"])
        n = _elements(item["bounds"])
        item["size"] = None if one is None or n is None else one * n
        return j

    i = 0
    while i < len(items):
        i = place(i, 0, None)


def read(text: str) -> Iterator[Row]:
    """Facts of a source; ``parent`` is the procedure around a statement and the structure around an item."""
    open_: list[str | None] = []
    around = lambda: next((p for p in reversed(open_) if p), None)
    for line, statement in statements(in_margins(text)):
        labels = []
        while m := _LABEL.match(statement):
            labels.append(m[1])
            statement = statement[m.end() :]
        yield from _one(line, statement, labels, open_, around)


def _one(line: int, statement: str, labels: list[str], open_: list[str | None], around) -> Iterator[Row]:
    word = _WORD.match(statement)
    verb, rest = (word[0].upper(), statement[word.end() :].strip()) if word else ("", statement)
    label = labels[0] if labels else None
    if re.match(r"[^=']*?=", rest) and (not rest or rest[0] in "=(.-,") and verb not in ("IF", "DO", "WHEN", "SELECT", "DECLARE", "DCL"):
        target, value = statement.split("=", 1)
        yield "assignment", line, target.strip(), around(), value.strip(), {}
    elif verb in ("PROCEDURE", "PROC"):
        given = {"OPTIONS": m[1]} if (m := re.search(r"\bOPTIONS\s*\(([^)]*)\)", rest, re.I)) else {}
        yield "procedure", line, label, around(), _bracket(rest)[0] if rest.startswith("(") else None, given
        open_.append(label)
    elif verb == "ENTRY":
        yield "entry", line, label, around(), None, {}
    elif verb == "END":
        if open_:
            target = _WORD.match(rest)
            open_.pop()
            while target and open_ and target[0] in open_:
                open_.pop()
    elif verb in ("DECLARE", "DCL"):
        items = declared(rest)
        layout(items)
        for item in items:
            given = {"LEVEL": str(item["level"]), "BOUNDS": item["bounds"], "OFFSET": item["offset"], "SIZE": item["size"]}
            yield "item", line, item["name"], item["parent"] or around(), item["attributes"] or None, {k: str(v) for k, v in given.items() if v is not None}
    elif verb == "CALL":
        target = _WORD.match(rest)
        behind = rest[target.end() :].strip() if target else ""
        yield "call", line, target[0] if target else None, around(), _bracket(behind)[0] if behind.startswith("(") else None, {}
    elif verb == "EXEC":
        kind, _, body = rest.partition(" ")
        yield "exec", line, kind.upper(), around(), re.sub(r"\s+", " ", body).strip(), {}
    elif verb == "%INCLUDE":
        for name in parted(rest):
            m = re.match(r"(?:([\w@#$]+)\s*\(\s*)?'?([\w@#$.]+)'?", name)
            if m:
                yield "copy", line, m[2], None, m[1], {}
    elif verb.startswith("%"):
        yield "preprocessor", line, verb, around(), rest or None, {}
    elif verb in _FACT_OF:
        yield _FACT_OF[verb], line, label, around(), f"{verb} {rest}".strip(), {}
        if verb in ("DO", "SELECT", "BEGIN", "PACKAGE"):
            open_.append(None)
        elif verb == "IF" and (m := re.search(r"\bTHEN\b\s*(.+)$", statement, re.I | re.S)):
            yield from _one(line, m[1].strip(), [], open_, around)
        elif verb in ("ELSE", "OTHERWISE", "OTHER") and rest:
            yield from _one(line, rest, [], open_, around)
        elif verb == "WHEN" and rest.startswith("(") and (behind := _bracket(rest)[1].strip()):
            yield from _one(line, behind, [], open_, around)
        elif verb == "ON" and (m := re.search(r"\b(BEGIN|CALL|GO\s*TO|STOP|SNAP|SYSTEM)\b.*$", rest, re.I | re.S)):
            yield from _one(line, m[0], [], open_, around)
