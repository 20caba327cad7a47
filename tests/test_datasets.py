from __future__ import annotations

import pytest

from loomstead.operators.linediff import changed_lines
from loomstead.plans import datasets
from loomstead.sources import estate, readers

JOB = """\
//NIGHT    JOB (ACCT),'RUN'
//S1       EXEC PGM=IEBGENER
//SYSUT1   DD DSN=PROD.A,DISP=SHR
//SYSUT2   DD DSN=PROD.B(MEM),DISP=SHR
//S2       EXEC PGM=IDCAMS
//IN1      DD DSN=PROD.B,DISP=SHR
//OUT1     DD DSN=PROD.C,DISP=SHR
//SYSIN    DD *
  REPRO INFILE(IN1) -
        OUTFILE(OUT1)
  REPRO INDATASET(PROD.C) OUTDATASET(PROD.D)
/*
//S3       EXEC PGM=SORT
//SORTIN   DD DSN=PROD.D,DISP=SHR
//SORTOUT  DD DSN=PROD.D,DISP=SHR
//X1       DD DSN=PROD.E,DISP=SHR
//SYSIN    DD *
 SORT FIELDS=COPY
 OUTFIL FNAMES=X1
/*
//S4       EXEC PGM=OTHER
//SYSUT1   DD DSN=PROD.Y,DISP=SHR
//SYSUT2   DD DSN=PROD.Z,DISP=SHR
"""
SQL = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. Q.
       PROCEDURE DIVISION.
       P1.
           EXEC SQL SELECT A, B INTO :WA, :WB FROM T WHERE K = :WK
           END-EXEC.
           EXEC SQL UPDATE T SET A = :WA END-EXEC.
           GOBACK.
"""


@pytest.fixture(scope="module")
def facts(spark):
    return readers.facts(estate.texts(estate.memory(spark, {"n.jcl": JOB, "q.cbl": SQL}))).persist()


def test_copies_of_utilities(facts):
    got = {(r.step, r.src, r.dst) for r in datasets.copies(facts).collect()}
    assert got == {("S1", "PROD.A", "PROD.B"), ("S2", "PROD.B", "PROD.C"), ("S2", "PROD.C", "PROD.D"), ("S3", "PROD.D", "PROD.E")}


def test_lineage_counts_copies(facts):
    got = {(r.origin, r.dataset): r.hops for r in datasets.lineage(facts).collect()}
    assert got["PROD.A", "PROD.E"] == 4 and got["PROD.B", "PROD.C"] == 1 and len(got) == 10


def test_host_variable_roles(facts):
    got = {(r.name, r.role, r.line) for r in datasets.host_variables(facts).collect()}
    assert got == {("WA", "written", 5), ("WB", "written", 5), ("WK", "read", 5), ("WA", "read", 7)}


def test_line_changes(spark):
    base = spark.createDataFrame([("a", "1\n2\n3\n"), ("same", "x"), ("gone", "y\nz"), ("empty", None)], "path string, text string")
    head = spark.createDataFrame([("a", "1\n3\n4\n"), ("same", "x"), ("new", "n"), ("empty", "")], "path string, text string")
    got = {(r.path, r.change, r.base_from, r.base_to, r.head_from, r.head_to): (r.removed, r.added) for r in changed_lines(base, head).collect()}
    assert got == {
        ("a", "delete", 2, 3, 2, 2): (["2"], []), ("a", "insert", 4, 4, 3, 4): ([], ["4"]),
        ("gone", "delete", 1, 3, 1, 1): (["y", "z"], []), ("new", "insert", 1, 1, 1, 2): ([], ["n"]),
    }
