"""Driver queries of the rule sets over a small invented fact table, with SQL oracles written apart from them.

The test tables hold no program source, so the facts stand here; DuckDB gets the same rows as VALUES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstead.plans import rules

SCHEMA = "path string, kind string, fact string, line int, name string, parent string, value string, operands map<string,string>"
#: path, kind, fact, line, name, parent, value, operands
FACTS = (
    ("g.ddl", "db2", "grant", 1, "PAY.STAFF", None, "SELECT, UPDATE", {"TO": "PUBLIC", "GRANTABLE": "False"}),
    ("g.ddl", "db2", "grant", 2, "PAY.STAFF", None, "SELECT", {"TO": "CLERK, PUBLIC", "GRANTABLE": "False"}),
    ("g.ddl", "db2", "grant", 3, None, None, "DBADM", {"TO": "OPS1", "GRANTABLE": "True"}),
    ("g.ddl", "db2", "grant", 4, "PAY.STAFF", None, "SELECT", {"TO": "PUBLICAN", "GRANTABLE": "False"}),
    ("g.ddl", "db2", "exit-routine", 5, "CHKROW", "PAY.STAFF", "VALIDPROC", {}),
    ("g.ddl", "db2", "external-routine", 6, "PAY.RAISE", None, "RAISE01", {}),
    ("a.jcl", "jcl", "step", 2, "S1", "JOBA", "IKJEFT01", {"PGM": "IKJEFT01"}),
    ("a.jcl", "jcl", "dd", 3, "SYSTSIN", "S1", None, {"$0": "*"}),
    ("a.jcl", "jcl", "data", 4, "SYSTSIN", "S1", " ADDUSER BOB PASSWORD(SECRET1)", {}),
    ("a.jcl", "jcl", "data", 5, "SYSTSIN", "S1", " PERMIT 'PAY.**' ID(BOB)", {}),
    ("a.jcl", "jcl", "data", 6, "SYSTSIN", "S1", " CALL 'PAY.LOAD(RUN1)'", {}),
    ("a.jcl", "jcl", "data", 7, "SYSTSIN", "S1", " DELETE PAY.OLD", {}),
    ("a.jcl", "jcl", "step", 9, "S2", "JOBA", "PAYROLL", {"PGM": "PAYROLL", "PARM": "'X'"}),
    ("a.jcl", "jcl", "dd", 10, "IN", "S2", None, {"$0": "DATA", "DLM": "@@"}),
    ("a.jcl", "jcl", "data", 11, "IN", "S2", "DELETE not a command here", {}),
    ("a.jcl", "jcl", "dd", 12, "OUT", "S2", "PAY.OLD", {"DSN": "PAY.OLD", "DISP": "(NEW,CATLG)"}),
    ("b.jcl", "jcl", "step", 1, "S1", "JOBB", "SORT", {"PGM": "SORT"}),
    ("b.jcl", "jcl", "dd", 2, "SYSIN", "S1", "CTL.CARDS(A)", {"DSN": "CTL.CARDS(A)"}),
    ("b.jcl", "jcl", "step", 3, "S2", "JOBB", "NOWHERE", {"PGM": "NOWHERE"}),
    ("b.jcl", "jcl", "step", 4, "S3", "JOBB", "IDCAMS", {"PGM": "IDCAMS"}),
    ("b.jcl", "jcl", "data", 5, "SYSIN", "S3", "  delete (PAY.GONE)", {}),
    ("p.cbl", "program", "program", 1, "PAYROLL", None, None, {}),
    ("p.cbl", "program", "statement", 20, "SET", None, "ADDRESS OF AREA-1 TO P", {}),
    ("p.cbl", "program", "statement", 21, "SET", None, "P TO ADDRESS OF AREA-1", {}),
    ("p.cbl", "program", "statement", 22, "SET", None, "FLAG TO TRUE", {}),
    ("p.cbl", "program", "statement", 23, "ALTER", None, "PARA-1 TO PROCEED TO PARA-2", {}),
    ("p.cbl", "program", "statement", 24, "GO", None, "TO A B DEPENDING ON N", {}),
    ("p.cbl", "program", "statement", 25, "GO", None, "TO A", {}),
    ("p.cbl", "program", "statement", 26, "ENTRY", None, "'PAYALT' USING X", {}),
    ("p.cbl", "program", "statement", 27, "ENTRY", None, "'not a name!'", {}),
)


def _facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FACTS), SCHEMA)


def rules_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the DDL rules."""
    return rules.ddl(_facts(spark))


def rules_jcl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the JCL rules."""
    return rules.jcl(_facts(spark))


def rules_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules on code that cannot be followed."""
    return rules.opaque(_facts(spark))


def _sql(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values() -> str:
    keys = ("TO", "GRANTABLE", "DLM", "PARM", "DISP")
    rows = ",\n  ".join("(" + ", ".join(_sql(x) for x in (*row[:7], *[row[7].get(k) for k in keys])) + ")" for row in FACTS)
    return f"WITH facts(path, kind, fact, line, name, parent, value, to_, grantable, dlm, parm, disp) AS (VALUES\n  {rows})"


DDL_SQL = """
SELECT 'db2-grant-to-public' AS rule, path, line,
       CASE WHEN len(list_filter(list_transform(string_split(value, ','), lambda x: trim(x)), lambda x: x IN ('ALL', 'ALTER', 'DELETE', 'INSERT', 'UPDATE', 'LOAD', 'DBADM', 'SYSADM'))) > 0 THEN 'crit' ELSE 'high' END AS sev,
       'construct' AS evidence, 'CWE-732' AS cwe, value || coalesce(' on ' || name, '') || ' granted to PUBLIC' AS detail
FROM facts WHERE fact = 'grant' AND list_contains(list_transform(string_split(to_, ','), lambda x: trim(x)), 'PUBLIC')
UNION ALL
SELECT 'db2-grant-with-grant-option', path, line, 'med', 'construct', 'CWE-269', to_ || ' may grant ' || value || coalesce(' on ' || name, '') || ' to others' FROM facts WHERE grantable = 'True'
UNION ALL
SELECT 'db2-system-authority-granted', path, line, 'med', 'construct', 'CWE-250', value || ' granted to ' || to_ FROM facts WHERE fact = 'grant' AND value = 'DBADM'
UNION ALL
SELECT 'db2-exit-routine-declared', path, line, 'info', 'context', 'CWE-829', parent || ' runs ' || value || ' ' || name FROM facts WHERE fact = 'exit-routine'
UNION ALL
SELECT 'db2-external-routine', path, line, 'info', 'context', 'CWE-829', name || ' runs load module ' || value FROM facts WHERE fact = 'external-routine'
"""

JCL_SQL = """,
steps AS (SELECT path, line, name AS step, value AS pgm, parm, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line), 1000000) AS until FROM facts WHERE kind = 'jcl' AND fact = 'step'),
scoped AS (SELECT f.path, f.fact, f.line, f.name, f.value, f.dlm, f.disp, s.step, s.pgm, s.line AS step_line FROM facts f JOIN steps s ON s.path = f.path AND f.line >= s.line AND f.line < s.until),
judged AS (
  SELECT *, CASE WHEN regexp_matches(upper(value), 'PASSWORD ?[(]') THEN 'jcl-instream-credential'
                 WHEN regexp_matches(upper(trim(value)), '^(ADDUSER|PERMIT) ') THEN 'jcl-instream-security-command'
                 WHEN regexp_matches(upper(trim(value)), '^DELETE ') AND pgm IN ('IKJEFT01', 'IDCAMS') THEN 'jcl-instream-destructive' END AS rule
  FROM scoped WHERE fact = 'data')
SELECT rule, path, line,
       CASE rule WHEN 'jcl-instream-credential' THEN 'crit' WHEN 'jcl-instream-security-command' THEN 'high'
            ELSE CASE WHEN EXISTS (SELECT 1 FROM facts d WHERE d.fact = 'dd' AND d.path = judged.path AND d.disp LIKE '(NEW%' AND contains(upper(judged.value), d.value)) THEN 'info' ELSE 'med' END END AS sev,
       'construct' AS evidence, CASE rule WHEN 'jcl-instream-credential' THEN 'CWE-798' ELSE 'CWE-284' END AS cwe,
       CASE rule WHEN 'jcl-instream-credential' THEN replace(trim(value), 'PASSWORD(SECRET1', '(masked)') ELSE trim(value) END AS detail
FROM judged WHERE rule IS NOT NULL
UNION ALL
SELECT 'jcl-dlm-hides-instream', path, line, 'med', 'tampering', 'CWE-1427', 'DD ' || name || ' ends its data at ' || dlm FROM facts WHERE dlm IS NOT NULL
UNION ALL
SELECT 'jcl-parm-is-an-entry-point', path, line, 'info', 'context', 'CWE-20', 'step ' || step || ' passes PARM to ' || pgm FROM steps WHERE parm IS NOT NULL AND pgm IN (SELECT name FROM facts WHERE fact = 'program')
UNION ALL
SELECT 'jcl-exec-pgm-unresolved', path, line, 'info', 'coverage', '', 'step ' || step || ' runs ' || pgm FROM steps WHERE pgm NOT IN ('IKJEFT01', 'SORT', 'IDCAMS') AND pgm NOT IN (SELECT name FROM facts WHERE fact = 'program')
UNION ALL
SELECT 'control-cards-from-dataset', path, line, 'low', 'construct', 'CWE-829', 'step ' || step || ' runs ' || pgm || ' with its ' || name || ' commands in ' || value FROM scoped WHERE fact = 'dd' AND pgm = 'SORT' AND name = 'SYSIN' AND value IS NOT NULL
UNION ALL
SELECT 'tso-batch-runs-program', path, min(step_line)::INT, 'low', 'construct', 'CWE-78', 'step ' || min(step) || ' runs ' || count(*) || ' TSO command(s) that start other work: CALL' FROM scoped WHERE fact = 'data' AND pgm = 'IKJEFT01' AND regexp_matches(trim(value), '^(CALL|EXEC|RUN) ') GROUP BY path, step_line
"""

OPAQUE_SQL = """
SELECT CASE name WHEN 'SET' THEN 'opaque-pointer-addressing' WHEN 'ENTRY' THEN 'opaque-alternate-entry' ELSE 'opaque-altered-control-flow' END AS rule, path, line, 'info' AS sev, 'coverage' AS evidence,
       CASE name WHEN 'SET' THEN 'CWE-119' WHEN 'ENTRY' THEN 'CWE-1419' ELSE 'CWE-691' END AS cwe,
       CASE WHEN name <> 'ENTRY' THEN name || ' ' || value WHEN contains(value, '!') THEN 'ENTRY with a literal that is not a program name' ELSE 'ENTRY ' || string_split(value, '''')[2] END AS detail
FROM facts WHERE fact = 'statement' AND (name IN ('ALTER', 'ENTRY') OR (name = 'GO' AND contains(value, 'DEPENDING')) OR (name = 'SET' AND contains(value, 'ADDRESS OF')))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (rules_ddl, rules_jcl, rules_opaque)}


def oracle_sql() -> dict[str, str]:
    head = _values()
    return {"rules_ddl": head + DDL_SQL, "rules_jcl": head + JCL_SQL, "rules_opaque": head + OPAQUE_SQL}
