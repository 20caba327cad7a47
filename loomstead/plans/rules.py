"""Rule sets as DataFrame functions on the readers' facts: facts in, findings (rule, path, line, sev, evidence, cwe, detail) out.

Each set is a union of predicates.  A rule gives its own severity, or the declared one of ``RULES``.
Facts are narrow rows, so predicates are filters, forward fills by file and line, and equi-joins with
names that the estate holds; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rule, severity, evidence, CWE.
RULES = (
    ("db2-grant-to-public", "high", "construct", "CWE-732"), ("db2-grant-with-grant-option", "med", "construct", "CWE-269"),
    ("db2-system-authority-granted", "med", "construct", "CWE-250"), ("db2-exit-routine-declared", "info", "context", "CWE-829"),
    ("db2-external-routine", "info", "context", "CWE-829"),
    ("ims-pcb-procopt-all", "info", "context", "CWE-250"), ("ims-senseg-unknown-segment", "low", "construct", "CWE-1076"),
    ("opaque-pointer-addressing", "info", "coverage", "CWE-119"), ("opaque-altered-control-flow", "info", "coverage", "CWE-691"),
    ("opaque-alternate-entry", "info", "coverage", "CWE-1419"),
    ("jcl-instream-credential", "crit", "construct", "CWE-798"), ("jcl-instream-security-command", "high", "construct", "CWE-284"),
    ("jcl-instream-destructive", "med", "construct", "CWE-284"), ("jcl-dlm-hides-instream", "med", "tampering", "CWE-1427"),
    ("jcl-parm-is-an-entry-point", "info", "context", "CWE-20"), ("jcl-exec-pgm-unresolved", "info", "coverage", ""),
    ("control-cards-from-dataset", "low", "construct", "CWE-829"), ("sort-exit-named", "med", "construct", "CWE-829"),
    ("tso-batch-runs-program", "low", "construct", "CWE-78"),
    ("cics-listener-accepts-cleartext", "high", "construct", "CWE-319"),
    ("encoded-blob", "med", "tampering", "CWE-506"), ("bidi-or-invisible-characters", "high", "tampering", "CWE-94"),
    ("obsolete-alter", "low", "construct", "CWE-477"), ("obsolete-go-to-without-name", "low", "construct", "CWE-477"), ("obsolete-enter", "low", "construct", "CWE-477"),
    ("obsolete-identification-paragraph", "info", "construct", "CWE-477"), ("obsolete-debugging-declarative", "low", "construct", "CWE-477"),
    ("obsolete-label-records", "low", "construct", "CWE-477"), ("obsolete-value-of", "low", "construct", "CWE-477"), ("obsolete-data-records", "low", "construct", "CWE-477"),
    ("obsolete-memory-size", "low", "construct", "CWE-477"), ("obsolete-multiple-file-tape", "low", "construct", "CWE-477"), ("obsolete-rerun", "low", "construct", "CWE-477"),
    ("obsolete-reversed", "low", "construct", "CWE-477"), ("obsolete-stop-literal", "low", "construct", "CWE-477"), ("obsolete-segment-number", "low", "construct", "CWE-477"),
)
# Words of the languages and products that predicates test for.
WRITING = "ALL|ALTER|DELETE|INSERT|UPDATE|LOAD"
AUTHORITIES = "SYSADM|SYSCTRL|SYSOPR|SECADM|DBADM|DBCTRL|DBMAINT|ACCESSCTRL|DATAACCESS|SYSTEM DBADM|SQLADM"
FLAGGED = ("SYSADM", "SYSCTRL", "SECADM", "ACCESSCTRL", "DATAACCESS", "DBADM", "SYSOPR")
TSO, SORTS, SQL_PROGRAMS = ("IKJEFT01", "IKJEFT1A", "IKJEFT1B"), ("SORT", "ICEMAN", "SYNCSORT"), ("DSNTEP2", "DSNTEP4", "DSNTIAD")
DATASET_UTILITIES = ("IDCAMS", *TSO, "ADRDSSU")
CONTROL_DDS = ((TSO, ("SYSTSIN",)), (("BPXBATCH",), ("STDPARM",)), (("IDCAMS",), ("SYSIN",)), (SORTS, ("SYSIN", "DFSPARM")), (("ICETOOL",), ("TOOLIN", "DFSPARM")), (SQL_PROGRAMS, ("SYSIN",)))
SYSTEM_PROGRAMS = ("IEFBR14", "IEBGENER", "IEBCOPY", "IEBUPDTE", "IEBPTPCH", "IEHLIST", "IDCAMS", "ICETOOL", "ADRDSSU", "BPXBATCH", "DFSRRC00", "DSNUTILB", "FTP", "ISRSUPC", "IGYCRCTL", "IEWL", "HEWL", "ASMA90", *TSO, *SORTS, *SQL_PROGRAMS)
CREDENTIAL = r"(?i)\b(?:PASSWORD|PASSWRD|PHRASE|PASSPHRASE)\s*(?:\(\s*)?(?:=\s*)?['\"]?([A-Z0-9@#$_.-]{3,})"
SECURITY_COMMAND = r"(?i)^\s*(?:TSS\s+)?(ADDUSER|ALTUSER|DELUSER|ADDGROUP|ALTGROUP|CONNECT|REMOVE|PERMIT|SETROPTS|RDEFINE|RALTER|RDELETE|ADDSD|ALTDSD|DELDSD|PASSWORD|ACFNRULE)\b"
ACF2_COMMAND = r"(?i)^\s*(?:SET\s+(?:LID|RULE|PROFILE)|INSERT\s+(?!INTO\b)[A-Z0-9$#@]+|CHANGE\s+[A-Z0-9$#@]+\s)"
DESTRUCTIVE = r"(?i)^\s*(DELETE(?!\s+FROM\b)|ALTER\s+\S+\s+NEWNAME|REPRO\b.*\bREPLACE)\b"
TSO_RUNS = r"(?i)^\s*(CALL|EXEC|EX|SUBMIT|ISPSTART|RUN)\b"
SORT_EXIT = r"(?i)\b(E\d\d)\s*=\s*\(\s*([A-Z$#@][A-Z0-9$#@]{0,7})"
ENCODED = r"[A-Za-z0-9+/]{200,}|[0-9A-Fa-f]{200,}"
INVISIBLE = "[​-‏‪-‮⁠-⁤⁦-⁩﻿]"
#: Obsolete elements by the text of a code line.
OBSOLETE = (
    ("obsolete-enter", r"(?i)^\s*ENTER\s+[A-Z]"), ("obsolete-identification-paragraph", r"(?i)^\s*(AUTHOR|INSTALLATION|DATE-WRITTEN|DATE-COMPILED|SECURITY)\s*\."),
    ("obsolete-debugging-declarative", r"(?i)\bUSE\s+(FOR\s+)?DEBUGGING\b"), ("obsolete-label-records", r"(?i)\bLABEL\s+RECORDS?\b"), ("obsolete-value-of", r"(?i)\bVALUE\s+OF\s+[A-Z]"),
    ("obsolete-data-records", r"(?i)\bDATA\s+RECORDS?\s+(IS\s+|ARE\s+)?[A-Z]"), ("obsolete-memory-size", r"(?i)\bMEMORY\s+(SIZE\s+)?[0-9]"), ("obsolete-multiple-file-tape", r"(?i)\bMULTIPLE\s+FILE\b"),
    ("obsolete-rerun", r"(?i)^\s*RERUN\b"), ("obsolete-reversed", r"(?i)\bOPEN\s+INPUT\b.*\bREVERSED\b"), ("obsolete-segment-number", r"(?i)^[A-Z0-9-]+\s+SECTION\s+[0-9]+\s*\."),
)

FINDINGS = ("rule", "path", "line", "sev", "evidence", "cwe", "detail")


def _found(rows: DataFrame, rule: str | Column, detail: Column, sev: Column | None = None) -> DataFrame:
    return rows.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), "path", "line", (sev if sev is not None else F.lit(None)).cast("string").alias("own"), detail.alias("detail"))


def _stamped(parts: list[DataFrame]) -> DataFrame:
    """Severity, evidence and CWE of each rule; an own severity wins."""
    meta = F.create_map(*[x for r in RULES for x in (F.lit(r[0]), F.struct(*[F.lit(v).alias(k) for k, v in zip(("sev", "evidence", "cwe"), r[1:])]))])
    rows = reduce(DataFrame.unionByName, parts).withColumn("meta", meta[F.col("rule")])
    return rows.select("rule", "path", "line", F.coalesce("own", "meta.sev").alias("sev"), "meta.evidence", "meta.cwe", "detail")


def _words(column: Column) -> Column:
    return F.transform(F.split(column, r"\s*,\s*"), lambda x: F.trim(x))


def ddl(facts: DataFrame) -> DataFrame:
    """Grants to everyone, grants that may be passed on, system authorities, exit and external routines."""
    grants = facts.where("kind = 'db2' and fact = 'grant'").withColumn("given", _words(F.col("value")))
    to = F.col("operands")["TO"]
    scope = F.coalesce(F.concat(F.lit(" on "), F.col("name")), F.lit(""))
    public = F.exists(_words(F.upper(to)), lambda x: x == "PUBLIC")
    strong = F.exists("given", lambda x: F.regexp_replace(x, r"\(.*$", "").rlike(f"^({WRITING}|{AUTHORITIES}|ALL PRIVILEGES)$"))
    authority = grants.select("*", F.explode(F.filter("given", lambda x: x.isin(*FLAGGED))).alias("authority"))
    exits = facts.where("kind = 'db2' and fact = 'exit-routine'")
    external = facts.where("kind = 'db2' and fact = 'external-routine'")
    return _stamped([
        _found(grants.where(public), "db2-grant-to-public", F.concat("value", scope, F.lit(" granted to PUBLIC")), F.when(strong, F.lit("crit"))),
        _found(grants.where(F.col("operands")["GRANTABLE"] == "True"), "db2-grant-with-grant-option", F.concat(to, F.lit(" may grant "), "value", scope, F.lit(" to others"))),
        _found(authority, "db2-system-authority-granted", F.concat("authority", scope, F.lit(" granted to "), to)),
        _found(exits, "db2-exit-routine-declared", F.concat("parent", F.lit(" runs "), "value", F.lit(" "), "name")),
        _found(external, "db2-external-routine", F.concat("name", F.lit(" runs load module "), F.coalesce("value", F.col("name")))),
    ])


def _everything(options: Column) -> Column:
    """A holds get, insert, replace and delete; replace and delete each imply get."""
    return options.contains("A") | (options.contains("I") & options.contains("R") & options.contains("D"))


def ims(facts: DataFrame) -> DataFrame:
    """PCBs that may change everything, and sensitive segments that their database does not define."""
    here = facts.where("kind = 'ims'")
    order = Window.partitionBy("path").orderBy("line")
    last = lambda fact, c: F.last(F.when(F.col("fact") == fact, c), ignorenulls=True).over(order)
    option = F.coalesce(F.col("operands")["PROCOPT"], F.lit("A"))
    named = here.withColumn("dbd", last("dbd", F.col("name"))).withColumn("pcb_line", last("pcb", F.col("line")))
    named = named.withColumn("pcb_dbd", last("pcb", F.coalesce(F.col("operands")["DBDNAME"], F.col("operands")["NAME"]))).withColumn("pcb_option", last("pcb", option))
    pcbs = named.where("fact = 'pcb'").where(F.coalesce(F.col("operands")["TYPE"], F.lit("DB")) == "DB")
    segs = named.where("fact = 'senseg'").withColumn("effective", F.coalesce(F.col("operands")["PROCOPT"], F.col("pcb_option")))
    held = segs.groupBy("path", F.col("pcb_line").alias("line")).agg(F.sort_array(F.collect_list(F.when(_everything(F.col("effective")), F.col("name")))).alias("full"))
    each = pcbs.join(held, ["path", "line"], "left")
    wide = each.where(F.when(F.col("full").isNull(), _everything(F.col("pcb_option"))).otherwise(F.size("full") > 0))
    what = F.coalesce(F.concat(F.lit("segments "), F.concat_ws(", ", "full")), F.lit("every sensitive segment"))
    written = F.coalesce(F.concat(F.lit("PROCOPT="), F.col("operands")["PROCOPT"]), F.lit("PROCOPT omitted, so A,"))
    defined = named.where("fact = 'segment' and dbd is not null").select(F.col("dbd").alias("pcb_dbd"), F.col("name"))
    once = named.where("fact = 'dbd'").groupBy(F.col("name").alias("pcb_dbd")).agg(F.count("*").alias("n")).where("n = 1").select("pcb_dbd")
    unknown = segs.join(once, "pcb_dbd", "left_semi").join(defined, ["pcb_dbd", "name"], "left_anti")
    return _stamped([
        _found(wide, "ims-pcb-procopt-all", F.concat(written, F.lit(" gives get, insert, replace and delete on "), what)),
        _found(unknown, "ims-senseg-unknown-segment", F.concat(F.lit("SENSEG "), "name", F.lit(" is not a segment of DBD "), "pcb_dbd")),
    ])


def opaque(facts: DataFrame) -> DataFrame:
    """Statements that code or data cannot be followed through."""
    st = facts.where("fact = 'statement' and kind in ('program', 'copybook')").withColumn("rest", F.coalesce("value", F.lit("")))
    upper = F.upper("rest")
    return _stamped([
        _found(st.where((F.col("name") == "SET") & upper.rlike(r"^ADDRESS\s+OF\s")), "opaque-pointer-addressing", F.concat(F.lit("SET "), "rest")),
        _found(st.where((F.col("name") == "SET") & upper.rlike(r"\sTO\s+ADDRESS\s+OF\b")), "opaque-pointer-addressing", F.concat(F.lit("SET "), "rest")),
        _found(st.where(F.col("name") == "ALTER"), "opaque-altered-control-flow", F.concat(F.lit("ALTER "), "rest")),
        _found(st.where((F.col("name") == "GO") & upper.rlike(r"\bDEPENDING\b")), "opaque-altered-control-flow", F.concat(F.lit("GO "), "rest")),
        _found(st.where(F.col("name") == "ENTRY"), "opaque-alternate-entry", F.concat(F.lit("ENTRY "), F.when(F.col("rest").rlike(r"^['\"][A-Za-z0-9$#@-]{1,30}['\"]"), F.regexp_extract("rest", r"^['\"]([^'\"]*)", 1)).otherwise(F.lit("with a literal that is not a program name")))),
    ])


def obsolete(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Elements that the standard has dropped, from statements and from code lines (columns 8 to 72) that are no comments."""
    st = facts.where("fact = 'statement' and kind in ('program', 'copybook')").withColumn("rest", F.upper(F.trim(F.coalesce("value", F.lit("")))))
    lines = texts.where("kind in ('program', 'copybook') and text is not null").select("path", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    code = lines.where(~F.substring("raw", 7, 1).isin("*", "/")).select("path", (F.col("at") + 1).alias("line"), F.substring("raw", 8, 65).alias("code"))
    hits = code.select("path", "line", F.explode(F.filter(F.array(*[F.when(F.col("code").rlike(p), F.lit(r)) for r, p in OBSOLETE]), lambda x: x.isNotNull())).alias("hit"), F.trim("code").alias("code"))
    return _stamped([
        _found(hits, F.col("hit"), F.col("code")),
        _found(st.where("name = 'ALTER'"), "obsolete-alter", F.concat(F.lit("ALTER "), "rest")),
        _found(st.where("name = 'GO' and rest in ('', 'TO')"), "obsolete-go-to-without-name", F.lit("GO TO without a name")),
        _found(st.where("name = 'STOP' and rest not like 'RUN%'"), "obsolete-stop-literal", F.concat(F.lit("STOP "), "rest")),
    ])


def jcl(facts: DataFrame, system_programs: tuple[str, ...] = SYSTEM_PROGRAMS, production: tuple[str, ...] = ()) -> DataFrame:
    """In-stream secrets and commands (the first that fits a line), hidden in-stream data, entry points, unresolved programs, control cards, exits."""
    order = Window.partitionBy("path").orderBy("line", F.when(F.col("fact") == "data", 1).otherwise(0))
    is_step = F.col("fact") == "step"
    scoped = facts.where("kind = 'jcl'").withColumn("step_line", F.last(F.when(is_step, F.col("line")), ignorenulls=True).over(order))
    scoped = scoped.withColumn("step", F.last(F.when(is_step, F.coalesce("name", F.lit("(unnamed)"))), ignorenulls=True).over(order))
    scoped = scoped.withColumn("pgm", F.upper(F.last(F.when(is_step, F.col("value")), ignorenulls=True).over(order)))
    data, dds, steps = scoped.where("fact = 'data'"), scoped.where("fact = 'dd'"), scoped.where("fact = 'step'")
    text, sql = F.col("value"), F.col("pgm").isin(*SQL_PROGRAMS)
    command = F.coalesce((text.rlike(SECURITY_COMMAND) | text.rlike(ACF2_COMMAND)) & ~F.coalesce(sql, F.lit(False)), F.lit(False))
    which = F.when(text.rlike(CREDENTIAL), F.lit("jcl-instream-credential")).when(command, F.lit("jcl-instream-security-command")).when(text.rlike(DESTRUCTIVE) & F.col("pgm").isin(*DATASET_UTILITIES), F.lit("jcl-instream-destructive"))
    lines = data.withColumn("which", which).where("which is not null")
    target = F.upper(F.regexp_extract("value", r"(?i)^\s*DELETE\s+\(?\s*'?([A-Z0-9$#@&<>.\-]+)", 1))
    made = dds.where(F.coalesce(F.col("operands")["DISP"], F.lit("")).rlike(r"^\(?NEW|^\(,")).select("path", F.upper(F.regexp_replace("value", r"\(.*$", "")).alias("target")).distinct().withColumn("rebuilt", F.lit(True))
    destroyed = lines.where("which = 'jcl-instream-destructive'").withColumn("target", target).join(made, ["path", "target"], "left")
    under = F.lit(False)
    for q in production:
        under = under | (F.col("target") == q) | F.col("target").startswith(q + ".")
    secret = F.regexp_replace("value", CREDENTIAL, "(masked)")
    ids = facts.where("fact in ('program', 'section') and name is not null").select(F.upper("name").alias("pgm")).distinct()
    known = ids.union(facts.sparkSession.createDataFrame([(p,) for p in system_programs], "pgm string"))
    cards = F.lit(False)
    for programs, names in CONTROL_DDS:
        cards = cards | (F.col("pgm").isin(*programs) & F.col("name").isin(*names))
    instream = data.select("path", "step_line", "name").distinct()
    outside = dds.where(cards & F.col("value").isNotNull() & ~F.col("value").rlike(r"^&&|^SYSOUT$|^DUMMY$")).join(instream, ["path", "step_line", "name"], "left_anti")
    mods = data.where((F.col("pgm").isin(*SORTS, "ICETOOL")) & F.col("name").isin("SYSIN", "DFSPARM") & text.rlike(r"(?i)^\s*MODS\s"))
    exits = mods.select("path", "line", "step", F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(SORT_EXIT), 1).alias("at"), F.regexp_extract_all("value", F.lit(SORT_EXIT), 2).alias("module"))).alias("x"))
    started = data.where(F.col("pgm").isin(*TSO) & (F.col("name") == "SYSTSIN")).withColumn("verb", F.upper(F.regexp_extract("value", TSO_RUNS, 1))).where("verb <> ''")
    started = started.groupBy("path", F.col("step_line").alias("line"), "step", "pgm").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("verb")).alias("verbs"))
    parm = steps.where(F.col("operands")["PARM"].isNotNull()).join(ids, "pgm", "left_semi")
    return _stamped([
        _found(lines.where("which = 'jcl-instream-credential'"), "jcl-instream-credential", F.trim(secret)),
        _found(lines.where("which = 'jcl-instream-security-command'"), "jcl-instream-security-command", F.trim("value")),
        _found(destroyed, "jcl-instream-destructive", F.trim("value"), F.when(F.col("rebuilt"), F.lit("info")).when(under, F.lit("high"))),
        _found(dds.where(F.col("operands")["DLM"].isNotNull()), "jcl-dlm-hides-instream", F.concat(F.lit("DD "), "name", F.lit(" ends its data at "), F.col("operands")["DLM"])),
        _found(parm, "jcl-parm-is-an-entry-point", F.concat(F.lit("step "), "step", F.lit(" passes PARM to "), "pgm")),
        _found(steps.join(known, "pgm", "left_anti"), "jcl-exec-pgm-unresolved", F.concat(F.lit("step "), "step", F.lit(" runs "), "pgm")),
        _found(outside, "control-cards-from-dataset", F.concat(F.lit("step "), "step", F.lit(" runs "), "pgm", F.lit(" with its "), "name", F.lit(" commands in "), "value")),
        _found(exits, "sort-exit-named", F.concat(F.lit("step "), "step", F.lit(" names "), F.upper("x.at"), F.lit(" exit "), F.upper("x.module"))),
        _found(started, "tso-batch-runs-program", F.concat(F.lit("step "), "step", F.lit(" runs "), F.col("n").cast("string"), F.lit(" TSO command(s) that start other work: "), F.concat_ws(", ", "verbs"))),
    ])


def web(facts: DataFrame) -> DataFrame:
    """Listeners without SSL."""
    listeners = facts.where("kind = 'csd' and fact = 'tcpipservice'")
    return _stamped([_found(listeners.where(F.coalesce(F.upper(F.col("operands")["SSL"]), F.lit("NO")) == "NO"), "cics-listener-accepts-cleartext", F.concat(F.lit("TCPIPSERVICE "), "name", F.lit(" has no SSL")))])


def hidden(texts: DataFrame) -> DataFrame:
    """Long encoded runs by line, and invisible or direction-changing characters once a file (a leading byte order mark is none)."""
    lines = texts.where("text is not null").select("path", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.select("path", (F.col("at") + 1).alias("line"), F.when(F.col("at") == 0, F.regexp_replace("raw", "^﻿", "")).otherwise(F.col("raw")).alias("raw"))
    odd = lines.where(F.col("raw").rlike(INVISIBLE)).groupBy("path").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    return _stamped([
        _found(lines.where(F.col("raw").rlike(ENCODED)), "encoded-blob", F.concat(F.lit("a run of "), F.length(F.regexp_extract("raw", f"({ENCODED})", 1)).cast("string"), F.lit(" encoded characters"))),
        _found(odd, "bidi-or-invisible-characters", F.concat("n", F.lit(" line(s) with invisible or direction-changing characters"))),
    ])


#: Sets by name; each takes facts and texts.
SETS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "ddl": lambda facts, texts: ddl(facts), "ims": lambda facts, texts: ims(facts), "opaque": lambda facts, texts: opaque(facts), "jcl": lambda facts, texts: jcl(facts),
    "web": lambda facts, texts: web(facts), "practice": obsolete, "hidden": lambda facts, texts: hidden(texts),
}


def scan(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """The findings of all sets in canonical order: rule, path, line."""
    return reduce(DataFrame.unionByName, [s(facts, texts) for s in SETS.values()]).orderBy("rule", "path", F.coalesce("line", F.lit(0)), "detail")
