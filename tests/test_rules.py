"""Rule sets on invented sources, read by the readers, with near misses beside each case."""

from __future__ import annotations

import pytest

from loomstead.plans import flow, rule_queries, rules
from loomstead.sources import readers
from loomstead.sources.estate import looks_ebcdic

TEXTS = "path string, text string, kind string"


def found(rows):
    return sorted((r["rule"], r["path"], r["line"], r["sev"]) for r in rows.collect())


def estate(spark, *files):
    texts = spark.createDataFrame([(p, t, k) for p, k, t in files], TEXTS)
    return readers.facts(texts), texts


def test_ddl(spark):
    facts, _ = estate(spark, ("a.ddl", "db2", "GRANT SELECT, INSERT ON TABLE PAY.T TO PUBLIC;\nGRANT SELECT ON TABLE PAY.T TO BOB;\nCREATE TABLE PAY.U (A INT FIELDPROC FP1) VALIDPROC VP1;\nCREATE PROCEDURE PAY.P (IN A INT) LANGUAGE COBOL EXTERNAL NAME 'MOD1';\nCREATE TABLE PAY.V (A INT);"))
    assert found(rules.ddl(facts)) == [("db2-exit-routine-declared", "a.ddl", 3, "info"), ("db2-exit-routine-declared", "a.ddl", 3, "info"), ("db2-external-routine", "a.ddl", 4, "info"), ("db2-grant-to-public", "a.ddl", 1, "crit")]


def test_ims(spark):
    dbd = "         DBD   NAME=STOCK,ACCESS=HDAM\n         SEGM  NAME=PART,PARENT=0,BYTES=50\n         DBDGEN\n"
    psb = "P1       PCB   TYPE=DB,DBDNAME=STOCK,PROCOPT=A,KEYLEN=10\n         SENSEG NAME=PART,PARENT=0\n         SENSEG NAME=GONE,PARENT=0\nP2       PCB   TYPE=DB,DBDNAME=OTHER,PROCOPT=G,KEYLEN=10\n         SENSEG NAME=ANY,PARENT=0\n         PSBGEN PSBNAME=USES\n"
    facts, _ = estate(spark, ("s.dbd", "ims", dbd), ("u.psb", "ims", psb))
    assert found(rules.ims(facts)) == [("ims-pcb-procopt-all", "u.psb", 1, "info"), ("ims-senseg-unknown-segment", "u.psb", 3, "low")]


def test_jcl_from_text(spark):
    job = "//J1 JOB 1\n//S1 EXEC PGM=IDCAMS\n//SYSIN DD *\n  DELETE PAY.OLD\n  LISTCAT\n/*\n//S2 EXEC PGM=SORT\n//SYSIN DD *\n  MODS E15=(MYEXIT,4096)\n/*\n//S3 EXEC PGM=MISSING\n//IN DD DATA,DLM=ZZ\n//LOOKS LIKE JCL\nZZ\n"
    facts, _ = estate(spark, ("j.jcl", "jcl", job))
    assert found(rules.jcl(facts, production=("PAY",))) == [("jcl-dlm-hides-instream", "j.jcl", 12, "med"), ("jcl-exec-pgm-unresolved", "j.jcl", 11, "info"), ("jcl-instream-destructive", "j.jcl", 4, "high"), ("sort-exit-named", "j.jcl", 9, "med")]


def test_hidden_web_and_obsolete(spark):
    program = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n       AUTHOR. SOMEONE.\n      *AUTHOR. NOT HERE.\n       DATA DIVISION.\n       FILE SECTION.\n       FD F LABEL RECORDS ARE STANDARD.\n       PROCEDURE DIVISION.\n       A SECTION 60.\n       B.\n           GO TO.\n           STOP 'WAIT'.\n           STOP RUN.\n"
    blob = "x = " + "QUJD" * 60 + "\nplain\n"
    facts, texts = estate(spark, ("p.cbl", "program", program), ("x.txt", "other", blob), ("y.txt", "other", "﻿ok\nre‮verse\n"), ("c.csd", "csd", "DEFINE TCPIPSERVICE(WEB1) GROUP(G) SSL(NO)\nDEFINE TCPIPSERVICE(WEB2) GROUP(G) SSL(YES)\n"))
    assert found(rules.hidden(texts)) == [("bidi-or-invisible-characters", "y.txt", 2, "high"), ("encoded-blob", "x.txt", 1, "med")]
    assert found(rules.web(facts)) == [("cics-listener-accepts-cleartext", "c.csd", 1, "high")]
    assert found(rules.obsolete(facts, texts)) == [("obsolete-go-to-without-name", "p.cbl", 11, "low"), ("obsolete-identification-paragraph", "p.cbl", 3, "info"), ("obsolete-label-records", "p.cbl", 7, "low"), ("obsolete-segment-number", "p.cbl", 9, "low"), ("obsolete-stop-literal", "p.cbl", 12, "low")]
    assert {r["rule"] for r in rules.scan(facts, texts).collect()} <= {r[0] for r in rules.RULES}


def test_no_facts_give_no_findings(spark):
    facts = spark.createDataFrame([], rule_queries.SCHEMA)
    assert rules.scan(facts, spark.createDataFrame([], TEXTS)).collect() == []


def test_separate_signs_take_a_character(spark):
    text = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 R.\n          05 X PIC S9(4) SIGN IS LEADING SEPARATE.\n          05 Y PIC S9(4) TRAILING.\n          05 Z PIC X.\n       PROCEDURE DIVISION.\n           STOP RUN.\n"
    facts, _ = estate(spark, ("p.cbl", "program", text))
    assert {r["name"]: (r["off"], r["size"]) for r in flow.items(facts).collect()} == {"R": (0, 10), "X": (0, 5), "Y": (5, 4), "Z": (9, 1)}


@pytest.mark.parametrize("statement", ["ADD A TO B GIVING C", "MULTIPLY A BY B GIVING C", "SUBTRACT A FROM B GIVING C", "DIVIDE A INTO B GIVING C"])
def test_operands_before_giving_are_read(spark, statement):
    text = f"       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 A PIC 9.\n       01 B PIC 9.\n       01 C PIC 9.\n       PROCEDURE DIVISION.\n           {statement}.\n           STOP RUN.\n"
    facts, _ = estate(spark, ("p.cbl", "program", text))
    assert {(r["src"], r["dst"]) for r in flow.edges(facts).collect()} == {("A", "C"), ("B", "C")}


def test_ebcdic_needs_a_floor_and_more_than_sixty_percent():
    assert not looks_ebcdic("SHORT".encode("cp037")) and looks_ebcdic("A LONG ENOUGH LINE OF TEXT".encode("cp037"))
    assert not looks_ebcdic("AAA".encode("cp037") * 4 + b"\x01\x02" * 4)
