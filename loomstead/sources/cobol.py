"""Facts of COBOL text: programs, copies, files, items with layout, paragraphs, statements, calls, EXEC blocks.

``read`` gives plain tuples (fact, line, name, parent, value, operands).  COPY members are named, not
expanded; the layout of a record that a COPY cuts is left open from there (null offsets).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Row = tuple[str, int, str | None, str | None, str | None, dict[str, str]]

#: Verbs that begin a statement.
VERBS = frozenset(
    "ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE ENTRY EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MERGE MOVE MULTIPLY OPEN PERFORM READ RELEASE RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WRITE".split()
)
_TOKEN = re.compile(r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|==.*?==|[A-Za-z0-9$#@][A-Za-z0-9$#@_-]*|[0-9]*[.,][0-9]+|\*\*|[<>]=|<>|[.]|[^\s]", re.S)


def is_fixed(text: str) -> bool:
    """Fixed format: most non-blank lines have a blank, comment, debug or continuation mark in column 7 behind six columns of sequence."""
    lines = [x.expandtabs(8) for x in text.split("\n") if x.strip()]
    ok = sum(len(x) > 6 and x[6] in " *-/Dd" and re.fullmatch(r"[ 0-9A-Za-z]{6}", x[:6]) is not None and (x[:6].strip() == "" or not x[:6].isalpha()) for x in lines)
    return 2 * ok > len(lines)


def cards(text: str) -> Iterator[tuple[int, str]]:
    """(line, text) without sequence, identification, comments and debugging lines; continued literals are joined."""
    held: tuple[int, str] | None = None
    fixed = is_fixed(text)
    for n, line in enumerate(text.replace("\r", "").split("\n"), 1):
        line = line.expandtabs(8)
        mark, body = (line[6:7], line[7:72]) if fixed else (" ", line)
        if mark in "*/Dd" and mark or not body.strip() or re.match(r"\s*\*>", body):
            continue
        body = re.sub(r"\*>(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$).*", "", body)
        if mark == "-" and held:
            more = body.lstrip()
            open_ = held[1].count("'") % 2 or held[1].count('"') % 2
            if open_ and more[:1] in "'\"":
                held = (held[0], held[1].ljust(65) + more[1:])
            else:
                held = (held[0], held[1].rstrip() + more)
            continue
        if held:
            yield held
        held = (n, body.rstrip())
    if held:
        yield held


def tokens(text: str) -> list[tuple[str, int]]:
    return [(m[0] if m[0][0] in "'\"=" else m[0].upper(), n) for n, card in cards(text) for m in _TOKEN.finditer(card)]


def picture_size(picture: str, usage: str) -> int | None:
    """Bytes of an elementary item, or None where the usage says nothing known."""
    full = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), picture.upper())
    digits = sum(full.count(c) for c in "9P") - full.count("P")
    if usage in ("COMP-1", "COMPUTATIONAL-1"):
        return 4
    if usage in ("COMP-2", "COMPUTATIONAL-2"):
        return 8
    if usage in ("INDEX", "POINTER"):
        return 4
    if usage in ("COMP-3", "COMPUTATIONAL-3", "PACKED-DECIMAL"):
        return digits // 2 + 1
    if usage in ("COMP", "COMP-4", "COMP-5", "BINARY", "COMPUTATIONAL", "COMPUTATIONAL-4", "COMPUTATIONAL-5"):
        return 2 if digits < 5 else 4 if digits < 10 else 8
    if not full:
        return None
    shown = re.sub(r"[SVP]", "", full)
    return len(shown) + len(re.findall("[NG]", shown))


_USAGES = re.compile(r"(COMP(UTATIONAL)?(-[1-5])?|BINARY|PACKED-DECIMAL|INDEX|POINTER|DISPLAY|NATIONAL)$")


def _item(words: list[tuple[str, int]]) -> dict | None:
    """One data description entry."""
    level, line = int(words[0][0]), words[0][1]
    w = [x[0] for x in words[1:]]
    named = bool(w) and w[0] not in ("PIC", "PICTURE", "REDEFINES", "OCCURS", "VALUE", "USAGE") and not _USAGES.match(w[0])
    item = {"level": level, "line": line, "name": w[0] if named else "FILLER", "picture": "", "usage": "", "occurs": 1, "redefines": None, "value": None, "separate": 0}
    i = int(named)
    while i < len(w):
        if w[i] in ("PIC", "PICTURE"):
            i += 1 + (i + 1 < len(w) and w[i + 1] == "IS")
            while i < len(w) and w[i] not in ("USAGE", "VALUE", "VALUES", "OCCURS", "REDEFINES", "SIGN", "LEADING", "TRAILING", "SYNC", "JUSTIFIED", "BLANK") and not _USAGES.match(w[i]):
                item["picture"] += w[i]
                i += 1
            continue
        if _USAGES.match(w[i]):
            item["usage"] = w[i]
        elif w[i] == "OCCURS":
            item["occurs"] = next((int(x) for x in reversed(w[i + 1 : i + 4]) if x.isdigit() and (x == w[i + 1] or "TO" in w[i + 1 : i + 4])), 1)
        elif w[i] == "REDEFINES" and i + 1 < len(w):
            item["redefines"] = w[i + 1]
        elif w[i] == "SEPARATE" and ("LEADING" in w[max(0, i - 2) : i] or "TRAILING" in w[max(0, i - 2) : i]):
            item["separate"] = 1  # the sign has a character of its own
        elif w[i] in ("VALUE", "VALUES"):
            item["value"] = next((x for x in w[i + 1 :] if x not in ("IS", "ARE")), None)
        i += 1
    return item


def layout(items: list[dict]) -> None:
    """Sets ``parent``, ``size`` and ``off`` (from the record's start) of items in order of declaration."""
    kids: dict[int | None, list[int]] = {None: []}
    above: list[int] = []
    for i, it in enumerate(items):
        kids[i] = []
        it["parent"] = None
        if it["level"] in (66, 88):
            it["parent"] = items[i - 1]["name"] if it["level"] == 88 and i else None
            it["size"] = it["off"] = None
            continue
        while above and (it["level"] in (1, 77) or items[above[-1]]["level"] >= it["level"]):
            above.pop()
        kids[above[-1] if above else None].append(i)
        it["parent"] = items[above[-1]]["name"] if above else None
        above.append(i)

    def place(i: int, at: int | None) -> int | None:
        """Places an item and what is below it; gives its size with all occurrences."""
        it = items[i]
        it["off"] = at
        if not kids[i]:
            one = picture_size(it["picture"], it["usage"])
            one = one if one is None else one + it["separate"]
        else:
            begin, end, spot = at, at, {}
            for k in kids[i]:
                kid = items[k]
                kid["usage"] = kid["usage"] or it["usage"]
                here = spot.get(kid["redefines"], begin) if kid["redefines"] else begin
                size = place(k, here)
                spot[kid["name"]] = here
                reached = None if here is None or size is None else here + size
                end = None if reached is None or end is None else max(end, reached)
                begin = begin if kid["redefines"] else reached
            one = None if end is None or at is None else end - at
        it["size"] = None if one is None else one * it["occurs"]
        return it["size"]

    for top in kids[None]:
        place(top, 0)


def read(text: str) -> Iterator[Row]:
    """All facts of one text, in order within each kind."""
    toks = tokens(text)
    program = division = section = paragraph = None
    items: list[dict] = []
    i, n, fresh = 0, len(toks), True

    def sentence(at: int) -> int:
        while at < n and toks[at][0] != ".":
            at += 1
        return at

    while i < n:
        word, line = toks[i]
        following = toks[i + 1][0] if i + 1 < n else ""
        if word == "COPY":
            end = sentence(i)
            yield "copy", line, following.strip("'\""), program, None, {"REPLACING": str(any(t[0] == "REPLACING" for t in toks[i:end])).lower()}
            i = end + 1
        elif following == "DIVISION":
            division, section, paragraph = word, None, None
            end = sentence(i)
            if word == "PROCEDURE":
                using = [t[0] for t in toks[i + 2 : end] if t[0] not in ("USING", "BY", "REFERENCE", "VALUE", "RETURNING")]
                yield "entry", line, program, None, " ".join(using), {}
            i = end + 1
        elif word == "PROGRAM-ID":
            i += 1 + (following == ".")
            program = toks[i][0].strip("'\"").upper() if i < n else None
            yield "program", line, program, None, "fixed" if is_fixed(text) else "free", {}
            i = sentence(i) + 1
        elif word == "EXEC":
            end = next((k for k in range(i, n) if toks[k][0] == "END-EXEC"), n)
            body = [t[0] for t in toks[i + 2 : end]]
            yield "exec", line, following, program, " ".join(body[:1]), {"PARAGRAPH": paragraph or "", "TEXT": " ".join(body)}
            i, fresh = end + 1, False
        elif division in ("ENVIRONMENT",) and word == "SELECT":
            end = sentence(i)
            words = [t[0] for t in toks[i:end]]
            to = words.index("ASSIGN") + 1 if "ASSIGN" in words else len(words)
            to += to < len(words) and words[to] == "TO"
            yield "file", line, following, program, words[to].strip("'\"") if to < len(words) else None, {}
            i = end + 1
        elif division in (None, "DATA") and word.isdigit() and len(word) <= 2 and fresh:
            end = sentence(i)
            items.append(_item(toks[i:end]))
            i = end + 1
        elif division == "PROCEDURE" and fresh and word not in VERBS and following in (".", "SECTION"):
            paragraph = word
            section = word if following == "SECTION" else section
            yield "section" if following == "SECTION" else "paragraph", line, word, program if following == "SECTION" else section or program, None, {}
            i = sentence(i) + 1
        elif division == "PROCEDURE" and word in VERBS:
            end = i + 1
            while end < n and toks[end][0] != "." and toks[end][0] not in VERBS and toks[end][0] not in ("ELSE", "WHEN"):
                end += 1
            rest = [t[0] for t in toks[i + 1 : end]]
            yield "statement", line, word, paragraph or program, " ".join(rest), {}
            if word == "CALL" and rest:
                using = rest[rest.index("USING") + 1 :] if "USING" in rest else []
                using = [x for x in using if x not in ("BY", "REFERENCE", "CONTENT", "VALUE", "END-CALL")]
                yield "call", line, rest[0].strip("'\""), program, "literal" if rest[0][0] in "'\"" else "dynamic", {"USING": " ".join(using)}
            i, fresh = end, False
        else:
            fresh = word == "."
            i += 1
            continue
        fresh = i > 0 and toks[min(i, n) - 1][0] == "." or i >= n
    layout(items)
    record = None
    for it in items:
        record = it["name"] if it["level"] in (1, 77) or record is None else record
        shown = {"RECORD": record, "LEVEL": it["level"], "PICTURE": it["picture"], "USAGE": it["usage"], "OCCURS": it["occurs"], "REDEFINES": it["redefines"], "OFFSET": it["off"], "SIZE": it["size"]}
        yield "item", it["line"], it["name"], it["parent"], it["value"], {k: str(v) for k, v in shown.items() if v not in (None, "")}
