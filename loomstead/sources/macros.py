"""Statements and operands of card-shaped macro source."""

from __future__ import annotations

import re
from collections.abc import Iterator


def split_operands(text: str) -> list[str]:
    """Operands between commas that lie outside quotes and parentheses."""
    out, depth, quoted, word = [], 0, False, ""
    for c in text:
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth <= 0:
                out.append(word)
                word = ""
                continue
        word += c
    return [*out, word] if out or word else []


def operand_map(text: str) -> dict[str, str]:
    """KEY=value operands by key, others by position (``$0``, ``$1``, ...); the last of a key holds."""
    out, k = {}, 0
    for part in split_operands(text):
        key = re.match(r"([A-Z@#$][A-Z0-9@#$.]*)=(.*)", part, re.S)
        if key:
            out[key[1]] = key[2]
        else:
            out[f"${k}"] = part
            k += 1
    return out


def operand_field(text: str) -> str:
    """The operand field: up to the first blank outside quotes."""
    quoted = False
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if c == " " and not quoted:
            return text[:i]
    return text


def macro_statements(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, label, operation, operands) of macro source: a mark in column 72 continues at column 16."""
    lines, i = text.split("\n"), 0
    while i < len(lines):
        at, body = i + 1, lines[i].rstrip("\r")
        i += 1
        if not body.strip() or body[0] in "*":
            continue
        goes_on, body = len(body) > 71 and body[71] != " ", body[:71].rstrip()
        while goes_on and i < len(lines):
            more = lines[i].rstrip("\r")
            i += 1
            goes_on = len(more) > 71 and more[71] != " "
            body = (body if body.endswith(",") else body) + more[15:71].rstrip()
        found = re.match(r"(\S*)\s+(\S+)(?:\s+(.*))?$", body)
        if found:
            yield at, found[1], found[2], operand_field(found[3] or "")
