from __future__ import annotations

import subprocess

import pytest

from loomstead.operators import contexts as C
from loomstead.sources import cobol, estate, readers

PROGRAM = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAYRUN.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT LEDGER ASSIGN TO LEDGDD.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-REC.
           05  WS-ID       PIC 9(4).
           05  WS-NAME     PIC X(10).
           05  WS-ALT REDEFINES WS-NAME.
               10  WS-A    PIC S9(5) COMP-3.
               10  WS-B    PIC 9(4) COMP.
           05  WS-TAB OCCURS 3 TIMES PIC X(2).
       COPY PAYCOPY.
       PROCEDURE DIVISION.
       MAIN-PARA.
           MOVE WS-ID TO WS-B
           CALL 'SUBPGM' USING BY REFERENCE WS-REC WS-ID.
      * a comment
           EXEC SQL SELECT A INTO :WS-ID FROM T END-EXEC.
       DONE-PARA.
           GOBACK.
"""
JOB = """\
//NIGHT    JOB (ACCT),'RUN',CLASS=A
//         SET HLQ=PROD
//* comment
//STEP1    EXEC PGM=PAYRUN,
//             PARM='A, B'
//LEDGDD   DD DSN=&HLQ..LEDGER,DISP=SHR
//SYSIN    DD *
FIRST ROW
SECOND ROW
/*
//STEP2    EXEC CLEANUP
"""


def _facts(text, kind):
    return list(readers._read(kind, text))


def test_program_facts_and_layout():
    rows = [readers.Fact(*r) for r in cobol.read(PROGRAM)]
    named = lambda fact: [r.name for r in rows if r.fact == fact]
    assert named("program") == ["PAYRUN"] and named("copy") == ["PAYCOPY"] and named("paragraph") == ["MAIN-PARA", "DONE-PARA"]
    assert [(r.name, r.value, r.operands["USING"]) for r in rows if r.fact == "call"] == [("SUBPGM", "literal", "WS-REC WS-ID")]
    assert [(r.name, r.value) for r in rows if r.fact == "file"] == [("LEDGER", "LEDGDD")]
    assert [(r.name, r.value) for r in rows if r.fact == "exec"] == [("SQL", "SELECT")]
    placed = {r.name: (r.operands["OFFSET"], r.operands["SIZE"]) for r in rows if r.fact == "item"}
    assert placed == {"WS-REC": ("0", "20"), "WS-ID": ("0", "4"), "WS-NAME": ("4", "10"), "WS-ALT": ("4", "5"), "WS-A": ("4", "3"), "WS-B": ("7", "2"), "WS-TAB": ("14", "6")}


def test_job_facts():
    rows = _facts(JOB, "jcl")
    assert [(r.fact, r.name, r.parent, r.value) for r in rows] == [
        ("job", "NIGHT", None, None), ("symbol", "HLQ", "NIGHT", "PROD"), ("step", "STEP1", "NIGHT", "PAYRUN"), ("dd", "LEDGDD", "STEP1", "PROD.LEDGER"),
        ("dd", "SYSIN", "STEP1", None), ("data", "SYSIN", "STEP1", "FIRST ROW"), ("data", "SYSIN", "STEP1", "SECOND ROW"), ("call", "STEP2", "NIGHT", "CLEANUP"),
    ]
    assert rows[2].operands["PARM"] == "'A, B'"


def test_macros_definitions_and_ddl():
    screen = "SETA     DFHMSD TYPE=MAP,LANG=COBOL\nMAPA     DFHMDI SIZE=(24,80)\n" + "USERID   DFHMDF POS=(1,2),LENGTH=8,".ljust(71) + "X\n" + " " * 15 + "ATTRB=(UNPROT,DRK)\n         DFHMSD TYPE=FINAL\n"
    assert [(r.fact, r.name, r.parent, r.operands.get("ATTRB")) for r in _facts(screen, "bms")] == [("mapset", "SETA", None, None), ("map", "MAPA", "SETA", None), ("field", "USERID", "MAPA", "(UNPROT,DRK)")]
    csd = "DEFINE TRANSACTION(PAY1) GROUP(PAY)\n       PROGRAM(PAYRUN)\nDEFINE URIMAP(U1) GROUP(PAY) PATH(/a)\n"
    assert [(r.fact, r.name, r.parent, r.value) for r in _facts(csd, "csd")] == [("transaction", "PAY1", "PAY", "PAYRUN"), ("urimap", "U1", "PAY", None)]
    ddl = "-- note;\nCREATE TABLE A.T (ID INTEGER NOT NULL, N VARCHAR(10), PRIMARY KEY (ID));\nGRANT SELECT, UPDATE ON TABLE A.T TO PUBLIC WITH GRANT OPTION;"
    rows = _facts(ddl, "db2")
    assert [(r.fact, r.name, r.value) for r in rows] == [("create-table", "A.T", "TABLE"), ("column", "ID", "INTEGER"), ("column", "N", "VARCHAR(10)"), ("grant", "A.T", "SELECT, UPDATE")]
    assert rows[0].line == 2 and rows[-1].operands == {"TO": "PUBLIC", "GRANTABLE": "true"}


def test_decoding_and_records():
    plain = "HELLO WORLD 123 " * 20
    assert estate.decode(plain.encode("cp037"))[1] == "ebcdic" and estate.decode("a plain café".encode())[:2] == ("a plain café", "utf-8")
    assert estate.decode(b"a plain caf\xe9")[:2] == ("a plain caf\xe9", "latin-1") and estate.decode(b"a\0b")[2] == "binary" and estate.decode(None)[2] == "unread"
    assert estate.unframe(b"\0\x06\0\0ab\0\x05\0\0c") == [b"ab", b"c"]
    with pytest.raises(ValueError):
        estate.unframe(b"\0\x09\0\0ab")


def test_estate_to_facts(spark, tmp_path):
    tree = {"src/payrun.cbl": PROGRAM, "jobs/night": JOB, "x.bin": b"\0\1"}
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    want = sorted(estate.memory(spark, tree).collect())
    assert sorted(estate.directory(spark, str(tmp_path)).collect()) == want
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True)
    assert sorted(estate.revision(spark, str(tmp_path), "HEAD", str(tmp_path / "out")).collect()) == want
    texts = estate.texts(estate.memory(spark, tree))
    assert {r["path"]: (r["kind"], r["problem"]) for r in texts.collect()} == {"src/payrun.cbl": ("program", None), "jobs/night": ("jcl", None), "x.bin": ("other", "binary")}
    found = readers.facts(texts)
    steps, programs = found.where("fact = 'step'"), found.where("fact = 'program'")
    assert [r["name"] for r in steps.join(programs.selectExpr("name as value"), "value").collect()] == ["STEP1"]


def test_returns_go_to_their_call_only(spark):
    e = [(1, 5, "call", 1), (2, 5, "call", 2), (5, 6, "plain", None), (6, 3, "return", 1), (6, 4, "return", 2)]
    edges = spark.createDataFrame(e, "src long, dst long, kind string, site long")
    starts = spark.createDataFrame([(1,)], "node long")
    assert sorted(r["node"] for r in C.summary_reach(edges, starts).collect()) == [1, 3, 5, 6]
    assert sorted((r["node"], r["stack"]) for r in C.context_reach(edges, starts).collect()) == [(1, []), (3, []), (5, [1]), (6, [1])]
