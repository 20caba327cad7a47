"""Assembler source as facts: statements, sections, symbols with addresses and lengths, linkage.

The location counter follows the rule that nothing can be placed behind an unknown length: from there on
addresses in the section are null until an ORG to a known place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from loomstead.sources.macros import macro_statements, operand_map, split_operands

Row = tuple[str, int, str | None, str | None, str | None, dict[str, str]]

#: Bytes and boundary of one constant of each type without a length.
CONSTANTS = {
    "C": (1, 1), "X": (1, 1), "B": (1, 1), "P": (1, 1), "Z": (1, 1), "F": (4, 4), "H": (2, 2), "E": (4, 4), "D": (8, 8), "L": (16, 8),
    "A": (4, 4), "V": (4, 4), "Y": (2, 2), "S": (2, 2), "Q": (4, 4), "FD": (8, 8), "AD": (8, 8), "VD": (8, 8), "CU": (2, 1),
}
SECTIONS = ("CSECT", "DSECT", "RSECT", "START", "COM")
#: Assembler instructions that take no room.
NO_ROOM = ("USING", "DROP", "TITLE", "EJECT", "SPACE", "PRINT", "ENTRY", "EXTRN", "WXTRN", "AMODE", "RMODE", "END", "COPY", "MACRO", "MEND", "MEXIT", "PUSH", "POP", "ISEQ", "PUNCH", "REPRO", "ICTL", "OPSYN", "MNOTE", "GBLA", "GBLB", "GBLC", "LCLA", "LCLB", "LCLC", "SETA", "SETB", "SETC", "AIF", "AGO", "ANOP", "AREAD", "ACONTROL", "ADATA", "ALIAS", "CATTR", "XATTR", "CEJECT")
#: Macros of interest and the fact each gives.
MACROS = {
    "call": ("CALL", "LINK", "XCTL", "LOAD", "ATTACH", "ATTACHX", "LINKX", "XCTLX"), "authority": ("MODESET", "TESTAUTH", "RACROUTE", "RACHECK", "RACINIT"),
    "io": ("OPEN", "CLOSE", "GET", "PUT", "READ", "WRITE", "CHECK", "POINT"), "recovery": ("ESTAE", "ESTAEX", "ESPIE", "SPIE", "ABEND", "SNAP", "SNAPX", "SETRP"),
    "storage": ("STORAGE", "GETMAIN", "FREEMAIN"), "operator": ("WTO", "WTOR", "WTL"), "control-block": ("DCB", "ACB", "RPL"), "environment": ("CEEENTRY", "CEETERM", "CEEPPA", "SAVE", "RETURN"),
    "structured": ("IF", "ELSE", "ELSEIF", "ENDIF", "DO", "ENDDO", "SELECT", "WHEN", "ENDSEL", "DOEXIT"),
}
_FACT_OF = {op: fact for fact, ops in MACROS.items() for op in ops}
#: Extended branch conditions; each makes B<c>, B<c>R, J<c> and JL<c>.
CONDITIONS = ("E", "H", "L", "M", "NE", "NH", "NL", "NM", "NO", "NP", "NZ", "O", "P", "Z")
#: Machine operations of two, four and six bytes beside the extended branches.
TWO_BYTES = frozenset("AR ALR BALR BASR BASSM BCR BCTR BR BSM CLCL CLR CR DR LCR LNR LPR LR LTR MR MVCL NOPR NR OR SLR SPM SR SVC XR".split()) | {f"B{c}R" for c in CONDITIONS}
FOUR_BYTES = frozenset("A AH AL B BAL BAS BC BCT BXH BXLE NOP C CH CL CLI CLM CVB CVD D EX IC ICM L LA LH LM M MH MVI N NI O OI S SH SL SLA SLDA SLDL SLL SRA SRDA SRDL SRL ST STC STCM STH STM TM TS X XI AHI LHI CHI MHI BRAS JAS BRC BRCT J JCT LGR AGR SGR LTGR CGR LGFR MSR IPM EAR SAR CPYA MVST CLST SRST BAKR".split()) | {f"{b}{c}" for b in "BJ" for c in CONDITIONS}
SIX_BYTES = frozenset("AP CLC CP DP ED EDMK MP MVC MVCIN MVN MVO MVZ NC OC PACK SP SRP TR TRT UNPK XC ZAP BRCL JLU LARL BRASL JASL LG STG AG SG NG OG XG CG LMG STMG LGF LGH LLGC LLGH LLC LLH LAY LY STY".split()) | {f"JL{c}" for c in CONDITIONS}

_OPERAND = re.compile(r"(?P<dup>\d+|\([^)]*\))?(?P<type>[A-Z])(?P<ext>[DUEBH](?=L|'|\(|$))?(?:L(?P<len>\d+|\([^)]*\)|\.\d+))?(?:S[-+]?\d+)?(?:E[-+]?\d+)?(?P<value>'(?:[^']|'')*'|\(.*\))?$")


def number(text: str, symbols: dict[str, int | None]) -> int | None:
    """A sum or difference of numbers, known symbols and self-defining terms; null where a part is unknown."""
    total = 0
    parts = re.findall(r"([-+]?)\s*((?:[XCB]'[^']*')|[\w$#@]+|\*)", text)
    if not parts or "".join(a + b for a, b in parts) != text.replace(" ", ""):
        return None
    for sign, word in parts:
        if word.isdigit():
            v: int | None = int(word)
        elif word.startswith("X'"):
            v = int(word[2:-1], 16)
        elif word.startswith("B'"):
            v = int(word[2:-1], 2)
        elif word.startswith("C'"):
            v = int.from_bytes(word[2:-1].encode("cp037"), "big")
        else:
            v = symbols.get(word)
        if v is None:
            return None
        total += -v if sign == "-" else v
    return total


def constant(operand: str, symbols: dict[str, int | None]) -> tuple[int | None, int, int | None]:
    """(bytes, boundary, length of one) of a DC or DS operand; null bytes where they depend on something unknown."""
    m = _OPERAND.match(operand)
    if not m:
        return None, 1, None
    kind = m["type"] + (m["ext"] or "")
    one, boundary = CONSTANTS.get(kind) or CONSTANTS.get(m["type"], (None, 1))
    value = m["value"]
    count = 1
    if m["len"]:
        one, boundary = (None if m["len"].startswith(".") else number(m["len"].strip("()"), symbols)), 1
    elif value and value[0] == "'":
        body = value[1:-1].replace("''", "'").replace("&&", "&")
        if m["type"] == "C":
            one = len(body) * (2 if kind == "CU" else 1)
        elif m["type"] == "X":
            one = (len(body.replace(",", "")) + 1) // 2
        elif m["type"] == "B":
            one = (len(body) + 7) // 8
        elif m["type"] == "P":
            one = len(re.sub(r"\D", "", body)) // 2 + 1
        elif m["type"] == "Z":
            one = len(re.sub(r"\D", "", body))
    if value and m["type"] not in "CXB":
        count = len(split_operands(value[1:-1]))
    times = number(m["dup"].strip("()"), symbols) if m["dup"] else 1
    return (None if one is None or times is None else one * count * times), boundary, one


def room(op: str) -> int | None:
    """Bytes of a machine operation; null for a macro or an unknown operation."""
    return 2 if op in TWO_BYTES else 6 if op in SIX_BYTES else 4 if op in FOUR_BYTES else None


def read(text: str) -> Iterator[Row]:
    """Statements' facts.  A symbol's operands hold section, offset and length; unknown ones are left out."""
    section, at, symbols, counters = None, 0, {}, {}
    in_macro = 0

    def place(name: str, kind: str, line: int, offset: int | None, length: int | None) -> Row:
        symbols[name] = offset
        given = {"SECTION": section, "OFFSET": offset, "LENGTH": length, "KIND": kind}
        return "symbol", line, name, section, kind, {k: str(v) for k, v in given.items() if v is not None}

    for line, label, op, raw in macro_statements(text):
        if op == "MACRO":
            in_macro += 1
        if in_macro:
            in_macro -= op == "MEND"
            continue
        operands = split_operands(raw) if raw else []
        if op in SECTIONS:
            counters[section] = at
            section, at = label or None, counters.get(label or None, 0)
            yield "section", line, section, None, op, {}
            if label:
                symbols.setdefault(label, 0)
            continue
        if op == "EQU":
            offset = at if raw.split(",")[0] == "*" else number(operands[0], symbols | {"*": at}) if operands else None
            yield place(label, "EQU", line, offset, number(operands[1], symbols) if len(operands) > 1 else 1)
        elif op == "ORG":
            at = number(operands[0], symbols | {"*": at}) if operands and operands[0] else at
        elif op in ("DC", "DS", "CCW", "CCW0", "CCW1"):
            first = True
            for operand in operands if op in ("DC", "DS") else ["D"]:
                size, boundary, one = constant(operand, symbols)
                if at is not None and boundary > 1:
                    at += -at % boundary
                if first and label:
                    yield place(label, op, line, at, one)
                first = False
                v = re.match(r"\d*V(?:D|L\d)?\(([^)]*)\)", operand)
                for target in v[1].split(",") if v else ():
                    yield "call", line, target, section, "V-constant", {}
                at = None if at is None or size is None else at + size
        elif op == "CNOP" or op == "LTORG":
            boundary = int(operands[1]) if op == "CNOP" and len(operands) > 1 and operands[1].isdigit() else 8
            at = None if at is None or op == "LTORG" else at + (int(operands[0]) - at) % boundary if operands and operands[0].isdigit() else None
        elif op in ("ENTRY", "EXTRN", "WXTRN"):
            for name in operands:
                yield op.lower(), line, name, section, None, {}
        elif op in ("USING", "DROP", "COPY"):
            yield op.lower(), line, operands[0] if operands else None, section, ",".join(operands[1:]) or None, {}
        elif op not in NO_ROOM:
            size = room(op)
            if at is not None and size:
                at += at % 2
            if label:
                yield place(label, "code", line, at, size)
            fact = _FACT_OF.get(op, "statement" if size else "macro")
            given = operand_map(raw)
            target = given.get("EP") or (operands[0] if operands else None)
            yield fact, line, target if fact in ("call", "io", "control-block") else label or None, section, op, given
            at = None if at is None or size is None else at + size
