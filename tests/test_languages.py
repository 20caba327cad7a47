from __future__ import annotations

import pytest

from loomstead.sources import estate, hlasm, pli, readers

ASSEMBLER = """\
PAYASM   CSECT
         STM   14,12,12(13)
         BALR  12,0
         USING *,12
LOOP     CLI   FLAG,C'Y'
         BE    DONE
DONE     BR    14
FLAG     DC    C'N'
COUNT    DC    2F'0'
LEN      EQU   *-FLAG
         CALL  SUBRTN,(FLAG,AREA)
AREA     DS    CL80
VCON     DC    V(EXTPGM)
WORK     DSECT
W1       DS    PL5
W2       DS    0D
W3       DS    XL(LEN)
         END
"""
PLI = """\
 PAY: PROC(PARM) OPTIONS(MAIN);
  /* a comment; with a semicolon */
  DCL 1 REC, 2 ID FIXED DEC(7), 2 NAME CHAR(20) VAR, 2 T(3), 3 A BIN FIXED(31), 3 B PIC '(3)9V99';
  DCL (X, Y) CHAR(10), N BIN FIXED(15), Z CHAR(*);
  %INCLUDE SYSLIB(MEMB);
  IF X = 'A;B' THEN DO; CALL SUB(X, Y); END;
  ELSE N = N + 1;
  EXEC SQL SELECT A INTO :X FROM T;
  ON ERROR BEGIN; PUT SKIP LIST('BAD'); END;
  SUB2: PROC; READ FILE(F) INTO(REC); END SUB2;
  CALL PLITDLI (N);
 END PAY;
"""


def symbols(text: str) -> dict:
    return {r[2]: r[5].get("OFFSET") for r in hlasm.read(text) if r[0] == "symbol"}


def test_assembler_locations_stop_behind_an_unknown_length():
    found = symbols(ASSEMBLER)
    assert {k: found[k] for k in ("LOOP", "DONE", "FLAG", "COUNT", "LEN")} == {"LOOP": "6", "DONE": "14", "FLAG": "16", "COUNT": "20", "LEN": "12"}
    assert found["AREA"] is None and found["VCON"] is None
    assert (found["W1"], found["W2"], found["W3"]) == ("0", "8", "8")


def test_assembler_calls_and_sections():
    rows = list(hlasm.read(ASSEMBLER))
    assert [r[2] for r in rows if r[0] == "call"] == ["SUBRTN", "EXTPGM"]
    assert [(r[2], r[4]) for r in rows if r[0] == "section"] == [("PAYASM", "CSECT"), ("WORK", "DSECT")]


@pytest.mark.parametrize("operand,size", [("CL8'A'", 8), ("X'0A0B0'", 3), ("P'-123'", 2), ("3H", 6), ("A(1,2,3)", 12), ("0D", 0), ("CL(N)", None), ("FD'1'", 8), ("C'IT''S'", 4)])
def test_constant_sizes(operand, size):
    assert hlasm.constant(operand, {})[0] == size


def test_pli_structures_and_statements():
    rows = list(pli.read(PLI))
    items = {r[2]: r for r in rows if r[0] == "item"}
    assert items["REC"][5]["SIZE"] == "53" and items["T"][5] == {"LEVEL": "2", "BOUNDS": "3", "OFFSET": "26", "SIZE": "27"}
    assert "SIZE" not in items["Z"][5] and items["B"][3] == "T"
    assert [(r[2], r[3], r[1]) for r in rows if r[0] == "call"] == [("SUB", "PAY", 6), ("PLITDLI", "PAY", 11)]
    assert [(r[2], r[4]) for r in rows if r[0] == "copy"] == [("MEMB", "SYSLIB")]
    assert [r[3] for r in rows if r[0] == "io"] == ["PAY", "SUB2"]
    assert [r[4] for r in rows if r[0] == "assignment"] == ["N + 1"]


@pytest.mark.parametrize("text", ["", ";", " DCL (A;", "END;", "/* open", " X: PROC; DCL 1", "'"])
def test_odd_texts_do_not_break_the_readers(text):
    for read in (pli.read, hlasm.read):
        try:
            list(read(text))
        except ValueError:
            pass  # facts() turns it into a problem row


def test_facts_of_both_languages(spark):
    files = estate.memory(spark, {"a/pay.asm": ASSEMBLER, "a/pay.pli": PLI})
    found = {(r.kind, r.fact) for r in readers.facts(estate.texts(files)).collect()}
    assert {("assembler", "symbol"), ("pli", "procedure"), ("pli", "item")} <= found
