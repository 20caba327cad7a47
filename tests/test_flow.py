from __future__ import annotations

from loomstead.plans import flow
from loomstead.sources import estate, readers, sinks

FIRST = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. ONE.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-ARG PIC X(80).
       01  WS-REC.
           05  WS-CMD PIC X(80).
           05  WS-SAFE PIC X(10).
       01  WS-IDX PIC 9(4).
       01  WS-TAB.
           05  WS-ROW OCCURS 10 TIMES PIC X(2).
       01  WS-OTHER PIC X(4).
       PROCEDURE DIVISION.
       MAIN-PARA.
           ACCEPT WS-ARG FROM COMMAND-LINE.
           MOVE WS-ARG TO WS-CMD.
           CALL 'TWO' USING WS-REC WS-IDX.
           MOVE WS-ROW ( WS-IDX ) TO WS-OTHER.
           EXEC SQL EXECUTE IMMEDIATE :WS-OTHER END-EXEC.
           GOBACK.
"""
SECOND = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. TWO.
       DATA DIVISION.
       LINKAGE SECTION.
       01  LK-REC.
           05  LK-CMD PIC X(80).
           05  LK-SAFE PIC X(10).
       01  LK-NUM PIC 9(4).
       PROCEDURE DIVISION USING LK-REC LK-NUM.
       MAIN-PARA.
           CALL 'SYSTEM' USING LK-CMD.
           CALL 'SYSTEM' USING LK-NUM.
           GOBACK.
"""
JOB = """\
//NIGHT    JOB (ACCT),'RUN'
//STEP1    EXEC PGM=THREE,PARM='A'
"""
THIRD = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. THREE.
       DATA DIVISION.
       LINKAGE SECTION.
       01  LK-PARM PIC X(8).
       PROCEDURE DIVISION USING LK-PARM.
       MAIN-PARA.
           CALL LK-PARM.
           GOBACK.
"""


def found(spark, files):
    facts = readers.facts(estate.texts(estate.memory(spark, files))).persist()
    return flow.flow_findings(facts)


def test_routes_cross_programs_and_groups(spark):
    df = found(spark, {"one.cbl": FIRST, "two.cbl": SECOND, "three.cbl": THIRD, "night.jcl": JOB})
    rows = {(r.rule, r.path, r.line): r for r in df.collect()}
    command = rows[("flow-os-command", "two.cbl", 11)]
    assert command.source_kind == "argv-or-env" and command.cross_program and command.sev == "crit" and command.hops == 4
    assert ("flow-os-command", "two.cbl", 12) not in rows  # the index is no part of the record
    assert ("flow-dynamic-sql", "one.cbl", 19) not in rows
    assert rows[("flow-dynamic-program-load", "three.cbl", 8)].source_kind == "jcl-parm"
    assert len({r.fingerprint for r in rows.values()}) == len(rows)


def test_no_facts_give_no_findings(spark):
    assert found(spark, {"x.txt": "nothing"}).count() == 0


def test_sources_and_sinks_of_commands(spark):
    text = FIRST.replace("EXEC SQL EXECUTE IMMEDIATE :WS-OTHER END-EXEC.", "EXEC CICS RECEIVE INTO(WS-OTHER) END-EXEC.\n           EXEC CICS LINK PROGRAM(WS-OTHER) END-EXEC.")
    facts = readers.facts(estate.texts(estate.memory(spark, {"one.cbl": text}))).persist()
    assert {(r.kind, r.name) for r in flow.sources(facts).collect()} == {("argv-or-env", "WS-ARG"), ("cics-terminal", "WS-OTHER")}
    assert {(r.kind, r.name) for r in flow.sinks(facts).collect()} == {("cics-dynamic-transfer", "WS-OTHER"), ("subscript", "WS-IDX")}


def test_findings_go_into_a_report(spark):
    df = found(spark, {"three.cbl": THIRD, "night.jcl": JOB})
    lines = sinks.sarif(df, df.selectExpr("rule", "'CWE-829' as cwe"))
    assert "flow-dynamic-program-load" in "\n".join(r.value for r in lines.orderBy("section", "n").collect())
