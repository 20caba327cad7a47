from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from loomstead.sources import estate, members, sinks

FINDINGS = "rule string, path string, line int, sev string, detail string, fingerprint string"
ROWS = [("r2", "b.cbl", 3, "crit", "say \"hi\"", "f1"), ("r1", "a.cbl", 9, "low", None, None), ("r1", "a.cbl", None, None, "x*y", "f2"), ("r1", "a.cbl", 9, "low", None, None), (None, "a.cbl", 1, "low", "", "f")]


def document(lines) -> str:
    return "\n".join(r.value for r in lines.orderBy("section", "n").collect())


def test_numbers_are_gapless_and_ordered(spark):
    rows = sinks.numbered(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")), ["k"]).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.k)] == list(range(1000))


def test_sarif_refers_by_index(spark, tmp_path):
    lines = sinks.sarif(spark.createDataFrame(ROWS, FINDINGS), spark.createDataFrame([("r1", "CWE-1"), ("r0", "")], "rule string, cwe string"))
    run = json.loads(document(lines))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r0", "r1", "r2"]
    assert [a["location"]["uri"] for a in run["artifacts"]] == ["a.cbl", "b.cbl"]
    assert len(run["results"]) == 4
    for r in run["results"]:
        assert run["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"]
        place = r["locations"][0]["physicalLocation"]["artifactLocation"]
        assert run["artifacts"][place["index"]]["location"]["uri"] == place["uri"]
    assert {r["level"] for r in run["results"]} == {"error", "note"}
    sinks.write_document(lines, str(tmp_path / "s"))
    written = "".join(p.read_text() for p in sorted(Path(tmp_path / "s").glob("part-*")))
    assert json.loads(written)["runs"][0] == run


def test_sarif_of_nothing(spark):
    empty = sinks.sarif(spark.createDataFrame([], FINDINGS), spark.createDataFrame([], "rule string, cwe string"))
    assert json.loads(document(empty))["runs"][0]["results"] == []


def test_sbom_does_not_depend_on_order(spark):
    parts = [("p", "PAY", "application", "1"), ("c", "COPYA", "file", None), ("c", "COPYA", "file", None)]
    made = [json.loads(document(sinks.sbom(spark.createDataFrame(p, "ref string, name string, type string, version string"), spark.createDataFrame([("p", "c"), ("p", "c"), ("p", "gone")], "src string, dst string")))) for p in (parts, parts[::-1])]
    assert made[0] == made[1]
    assert made[0]["dependencies"] == [{"ref": "p", "dependsOn": ["c"]}] and [c["bom-ref"] for c in made[0]["components"]] == ["c", "p"]


def test_markdown(spark):
    text = document(sinks.markdown(spark.createDataFrame(ROWS, FINDINGS)))
    assert "## r1 (3)" in text and r"x\*y" in text and text.index("## r1") < text.index("## r2")


def test_journal_finds_what_was_changed(spark, tmp_path):
    path = str(tmp_path / "j")
    sinks.append_journal(spark, path, "c", [("scan", "2026-01-01", {"b": 1, "a": 2})], create=True)
    sinks.append_journal(spark, path, "c", [("gate", "2026-01-02", {}), ("gate", "2026-01-03", {"x": "y"})])
    records = spark.read.schema(sinks.JOURNAL).json(path)
    assert records.count() == 3 and sinks.verify_journal(records).count() == 0
    changed = records.withColumn("fields", F.when(F.col("seq") == 1, "{}x").otherwise(F.col("fields")))
    assert [(r.seq, r.problem) for r in sinks.verify_journal(changed).collect()] == [(1, "hash")]
    assert [(r.seq, r.problem) for r in sinks.verify_journal(records.where("seq <> 1")).collect()] == [(2, "gap")]


def test_provenance():
    s = sinks.provenance({"out": "aa"}, "b", "k", {"in": "bb"})
    assert s["subject"][0]["digest"]["sha256"] == "aa" and s["predicate"]["buildDefinition"]["resolvedDependencies"][0]["name"] == "in"


def test_members_come_from_the_nearest_folder_and_nest(spark):
    files = {
        "x/app/main.cbl": "       COPY OUTER REPLACING ==:P:== BY ==WS== A BY B.\n       COPY GONE.\n      * COPY NOT.\n       COPY LOOP.\n",
        "x/app/OUTER.cpy": "       01 :P:-REC.\n       COPY INNER.\n", "x/lib/INNER.cpy": "       05 A PIC X.\n       05 A-B PIC X.\n",
        "y/OUTER.cpy": "       01 WRONG.\n", "x/app/LOOP.cpy": "       COPY LOOP2.\n", "x/app/LOOP2.cpy": "       COPY LOOP.\n",
        "z/p.pli": " P: PROC; %INCLUDE DECLS; END;\n", "z/decls.pli": " DCL N CHAR(3);\n", "z/none.cbl": "       01 PLAIN.\n",
    }
    got = {r.path: r for r in members.expanded(estate.texts(estate.memory(spark, files))).collect()}
    assert set(got) == set(files)
    main = got["x/app/main.cbl"]
    assert "01 WS-REC." in main.text and "05 B PIC X." in main.text and "05 A-B PIC X." in main.text and "WRONG" not in main.text
    assert main.missing == ["GONE"] and main.problems == ["LOOP includes itself"] and "COPY NOT." in main.text
    assert "DCL N CHAR(3);" in got["z/p.pli"].text and got["z/none.cbl"].text == files["z/none.cbl"]
