"""From facts to flow: items as nodes, moves and calls as edges, what enters and what is at risk, and routes between.

All steps are joins and projections over the fact table (``readers.facts``); a node is the path of a
text and the name of an item in it.  Names that several records hold are one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.graph import fixpoint, hold

#: Routines that run a command.
COMMAND_ROUTINES = ("SYSTEM", "C$SYSTEM", "CBL_EXEC_RUN_UNIT", "CBL_GC_HOSTED", "BXPSYSTM")
#: Severity of each sink kind.
SEVERITY = {
    "os-command": "crit", "dynamic-sql": "crit", "dynamic-program-load": "high", "cics-dynamic-transfer": "high", "connection-target": "high",
    "dynamic-file-path": "high", "message-queue": "med", "extrapartition-queue": "med", "web-response": "med", "record-key": "med", "subscript": "high",
    "reference-modification": "high", "xml-document": "med", "screen": "low", "log": "low",
}
#: (kind, first word of the command, pattern of the rest up to the option, option): what CICS commands bring in.
CICS_SOURCES = (
    ("cics-terminal", "RECEIVE", "", "INTO"), ("cics-queue", "READQ", "", "INTO"), ("cics-queue", "RETRIEVE", "", "INTO"),
    ("file-record", "READ", "", "INTO"), ("file-record", "READNEXT", "", "INTO"), ("file-record", "READPREV", "", "INTO"), ("cics-web", "WEB", "RECEIVE", "INTO"),
)
CICS_SINKS = (
    ("cics-dynamic-transfer", "LINK", "", "PROGRAM"), ("cics-dynamic-transfer", "XCTL", "", "PROGRAM"), ("cics-dynamic-transfer", "START", "", "TRANSID"),
    ("extrapartition-queue", "WRITEQ", "TD", "FROM"), ("screen", "SEND", "", "FROM"), ("web-response", "WEB", "SEND", "FROM"), ("record-key", "READ", "", "RIDFLD"),
    ("record-key", "STARTBR", "", "RIDFLD"), ("record-key", "DELETE", "", "RIDFLD"), ("dynamic-file-path", "READ", "", "FILE"), ("dynamic-file-path", "WRITE", "", "FILE"),
)
#: Restricted pairs: sinks that a source kind may not be held against are left out.
NOT_AGAINST = {"file-record": ("record-key", "screen"), "database": ("screen",)}

_NAME = r"[A-Z0-9$#@][A-Z0-9$#@_-]*"
_ITEM = r"[A-Z0-9$#@-]*[A-Z$#@][A-Z0-9$#@_-]*"


def _names(text: Column) -> Column:
    """Item-like words outside literals."""
    bare = F.regexp_replace(text, r"'[^']*'|\"[^\"]*\"", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"(?<![\w-])({_ITEM})(?![\w-])"), 0))


def _known(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Only rows whose (path, name) is an item."""
    return found.join(nodes.select("path", "name").distinct(), ["path", "name"], "left_semi")


def items(facts: DataFrame) -> DataFrame:
    """(path, name, record, off, size) of each item with a name."""
    o = F.col("operands")
    found = facts.where("fact = 'item' and kind in ('program', 'copybook') and name is not null and name <> 'FILLER'")
    return found.select("path", "name", o["RECORD"].alias("record"), o["OFFSET"].cast("int").alias("off"), o["SIZE"].cast("int").alias("size"))


def _statements(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'statement' and kind in ('program', 'copybook')").select("path", "line", F.col("name").alias("verb"), F.coalesce("value", F.lit("")).alias("rest"))


#: How the words of a statement part into what is read and what is set, by verb.
_SPLITS = {
    "MOVE": r"^(?:CORR(?:ESPONDING)? )?(.*?) TO (.*)$", "STRING": r"^(.*?) INTO (\S+)", "UNSTRING": r"^(\S+) .*?INTO (.*)$", "ADD": r"^(.*(?= GIVING )|.*?(?= TO )) (?:TO|GIVING) (.*)$",
    "SUBTRACT": r"^(.*(?= GIVING )|.*?(?= FROM )) (?:FROM|GIVING) (.*)$", "DIVIDE": r"^(.*(?= GIVING )|.*?(?= INTO )) (?:INTO|GIVING) (.*)$",
    "MULTIPLY": r"^(.*(?= GIVING )|.*?(?= BY )) (?:BY|GIVING) (.*)$",  # with GIVING all operands before it are read "SET": r"^()(.*)$",
}


def edges(facts: DataFrame) -> DataFrame:
    """(src_path, src, dst_path, dst, via): assignments, overlapping storage, and arguments to parameters by position.

    Overlap is an equi-join on the record and a byte-range condition; items of unknown place join their record.
    """
    nodes = items(facts)
    st = _statements(facts)
    read, set_ = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, pattern in _SPLITS.items():
        read = F.when(F.col("verb") == verb, F.regexp_extract("rest", pattern, 1)).otherwise(read)
        set_ = F.when(F.col("verb") == verb, F.regexp_extract("rest", pattern, 2)).otherwise(set_)
    read = F.when(F.col("verb") == "COMPUTE", F.regexp_extract("rest", r"^[^=]*=(.*)$", 1)).otherwise(read)
    set_ = F.when(F.col("verb") == "COMPUTE", F.regexp_extract("rest", r"^([^=]*)=", 1)).otherwise(set_)
    parted = st.select("path", "line", "verb", _names(read).alias("reads"), _names(set_).alias("sets")).where("size(reads) > 0 and size(sets) > 0")
    moved = parted.select("path", "verb", F.explode("reads").alias("name"), "sets")
    moved = _known(moved, nodes).select("path", "verb", F.col("name").alias("src"), F.explode("sets").alias("name"))
    moved = _known(moved, nodes).select(F.col("path").alias("src_path"), "src", F.col("path").alias("dst_path"), F.col("name").alias("dst"), F.lower("verb").alias("via"))

    a, b = nodes.alias("a"), nodes.alias("b")
    meets = F.coalesce((F.col("a.off") < F.col("b.off") + F.col("b.size")) & (F.col("b.off") < F.col("a.off") + F.col("a.size")), F.col("a.name") == F.col("a.record"), F.lit(False))
    shared = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.record") == F.col("b.record")) & (F.col("a.name") != F.col("b.name")) & meets)
    shared = shared.select(F.col("a.path").alias("src_path"), F.col("a.name").alias("src"), F.col("b.path").alias("dst_path"), F.col("b.name").alias("dst"), F.lit("storage").alias("via"))

    spread = lambda text: F.posexplode(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w.rlike(f"^{_NAME}$")))
    args = facts.where("fact = 'call' and kind = 'program' and value = 'literal'").select("path", F.upper("name").alias("callee"), spread(F.col("operands")["USING"]).alias("pos", "arg"))
    params = entries(facts).select(F.col("path").alias("to_path"), "callee", "pos", "param")
    passed = args.join(params, ["callee", "pos"])
    into = passed.select(F.col("path").alias("src_path"), F.col("arg").alias("src"), F.col("to_path").alias("dst_path"), F.col("param").alias("dst"), F.lit("call").alias("via"))
    back = passed.select(F.col("to_path").alias("src_path"), F.col("param").alias("src"), F.col("path").alias("dst_path"), F.col("arg").alias("dst"), F.lit("return").alias("via"))
    return moved.unionByName(shared).unionByName(into).unionByName(back).distinct()


def entries(facts: DataFrame) -> DataFrame:
    """(path, callee, pos, param): parameters of each program by position; of programs of one name, that of the least path."""
    found = facts.where("fact = 'entry' and kind = 'program' and name is not null").groupBy(F.upper("name").alias("callee")).agg(F.min(F.struct("path", F.coalesce("value", F.lit("")).alias("value"))).alias("e"))
    words = F.filter(F.split("e.value", " "), lambda w: w != "")
    return found.select(F.col("e.path").alias("path"), "callee", F.posexplode(words).alias("pos", "param"))


def _cics(facts: DataFrame, table: tuple) -> DataFrame:
    """(path, line, kind, name): data items in the options of CICS commands."""
    found = facts.where("fact = 'exec' and name = 'CICS'").select("path", "line", F.concat(F.lit(" "), F.col("operands")["TEXT"], F.lit(" ")).alias("t"))
    hits = [F.when(F.col("t").rlike(rf"^ {first}\b" + (rf".* {then}\b" if then else "")), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("t", rf" {option} ?\( ?({_ITEM})\b", 1).alias("name"))) for kind, first, then, option in table]
    return found.select("path", "line", F.explode(F.array(*hits)).alias("h")).where("h is not null and h.name <> ''").select("path", "line", "h.kind", "h.name")


def _sql(facts: DataFrame, kind: str, pattern: str) -> DataFrame:
    found = facts.where("fact = 'exec' and name = 'SQL'").select("path", "line", F.regexp_extract(F.col("operands")["TEXT"], pattern, 1).alias("hosts"))
    return found.select("path", "line", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("hosts", F.lit(rf": ?({_ITEM})"), 1)).alias("name"))


def _verb(facts: DataFrame, kind: str, verbs: tuple, pattern: str) -> DataFrame:
    found = _statements(facts).where(F.col("verb").isin(*verbs)).select("path", "line", F.regexp_extract("rest", pattern, 1).alias("name"))
    return found.where("name <> ''").select("path", "line", F.lit(kind).alias("kind"), "name")


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def sources(facts: DataFrame) -> DataFrame:
    """(path, line, kind, name): items that hold what comes from outside."""
    parm = facts.where("fact = 'step' and kind = 'jcl' and operands['PARM'] is not null").select(F.upper("value").alias("callee"), "line")
    first = entries(facts).where("pos = 0").select("path", "callee", F.col("param").alias("name"))
    started = parm.join(first, "callee").select("path", "line", F.lit("jcl-parm").alias("kind"), "name")
    found = [
        _verb(facts, "argv-or-env", ("ACCEPT",), rf"^({_ITEM}) FROM (?:COMMAND-LINE|ARGUMENT-VALUE|ENVIRONMENT|ENVIRONMENT-VALUE)\b"),
        _verb(facts, "file-record", ("READ", "RETURN"), rf"\bINTO ({_ITEM})\b"), _cics(facts, CICS_SOURCES), _sql(facts, "database", r"^(?:SELECT|FETCH)\b.*?\bINTO\b(.*?)(?:\bFROM\b|$)"),
    ]
    return _together([_known(_together(found), items(facts)), started])


def sinks(facts: DataFrame) -> DataFrame:
    """(path, line, kind, name): items whose value decides something at risk."""
    calls = facts.where("fact = 'call' and kind = 'program'").select("path", "line", F.upper("name").alias("to"), "value", F.split(F.coalesce(F.col("operands")["USING"], F.lit("")), " ").alias("using"))
    at = lambda n: F.try_element_at("using", F.lit(n))
    subscripted = lambda kind, pattern: _statements(facts).select("path", "line", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("rest", F.lit(pattern), 1)).alias("name"))
    on_cics = facts.where("fact = 'exec' and name = 'CICS'").select("path").distinct()
    found = [
        calls.where(F.col("to").isin(*COMMAND_ROUTINES) & (F.col("value") == "literal")).select("path", "line", F.lit("os-command").alias("kind"), F.explode("using").alias("name")),
        calls.where("value = 'dynamic'").select("path", "line", F.lit("dynamic-program-load").alias("kind"), F.col("to").alias("name")),
        calls.where("to = 'MQPUT'").select("path", "line", F.lit("message-queue").alias("kind"), at(6).alias("name")), calls.where("to = 'MQCONN'").select("path", "line", F.lit("connection-target").alias("kind"), at(1).alias("name")),
        facts.where("fact = 'file' and kind = 'program'").select("path", "line", F.lit("dynamic-file-path").alias("kind"), F.col("value").alias("name")),
        _cics(facts, CICS_SINKS), _sql(facts, "dynamic-sql", r"^(?:PREPARE\b.*?\bFROM|EXECUTE IMMEDIATE)\b(.*)$"), _sql(facts, "connection-target", r"^CONNECT TO\b(.*)$"),
        _verb(facts, "log", ("DISPLAY",), rf"({_ITEM})").join(on_cics, "path", "left_semi"), facts.where("fact = 'statement' and name = 'XML' and value like 'PARSE %'").select("path", "line", F.lit("xml-document").alias("kind"), F.split("value", " ")[1].alias("name")),
        subscripted("subscript", rf"{_ITEM} ?\( ?({_ITEM}) ?\)"), subscripted("reference-modification", rf"{_ITEM} ?\( ?({_ITEM}) ?:"),
    ]
    return _known(_together(found), items(facts))


def flow_findings(facts: DataFrame, rounds: int = 64) -> DataFrame:
    """(rule, path, line, program, sev, evidence, detail, source_kind, source_path, source_line, item, hops, cross_program, fingerprint).

    One row for each source place and sink place that a route joins, with the fewest hops; restricted pairs are left
    out.  A source that is itself a sink's item has no hops.  Only the frontier of new (source item, item) pairs is joined each round.
    """
    src, snk, e = hold(sources(facts)), hold(sinks(facts)), hold(edges(facts))
    start = src.select(F.col("path").alias("from_path"), F.col("name").alias("from_name"), "path", "name").distinct()
    step = lambda f: f.join(e, (f["path"] == e["src_path"]) & (f["name"] == e["src"])).select("from_path", "from_name", F.col("dst_path").alias("path"), F.col("dst").alias("name"))
    reached = fixpoint(start, step, ["from_path", "from_name", "path", "name"], rounds)
    enter = src.select(F.col("path").alias("from_path"), F.col("name").alias("from_name"), F.col("kind").alias("source_kind"), F.col("line").alias("source_line"))
    met = reached.join(snk, ["path", "name"]).join(enter, ["from_path", "from_name"])
    refused = F.lit(False)
    for kind, sinks_ in NOT_AGAINST.items():
        refused = refused | ((F.col("source_kind") == kind) & F.col("kind").isin(*sinks_))
    one = met.where(~refused).groupBy("source_kind", "from_path", "source_line", "kind", "path", "line").agg(F.min(F.struct("level", "from_name", "name")).alias("best"))
    programs = facts.where("fact = 'program'").groupBy("path").agg(F.min("name").alias("program"))
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    rows = one.join(programs, "path", "left")
    rule = F.concat(F.lit("flow-"), "kind")
    detail = F.concat(F.col("source_kind"), F.lit(" item "), F.col("best.from_name"), F.lit(" reaches "), F.col("kind"), F.lit(" by "), F.col("best.name"))
    return rows.select(
        rule.alias("rule"), "path", "line", "program", F.element_at(severity, F.col("kind")).alias("sev"), F.lit("flow").alias("evidence"), detail.alias("detail"), "source_kind",
        F.col("from_path").alias("source_path"), "source_line", F.col("best.name").alias("item"), F.col("best.level").alias("hops"), (F.col("from_path") != F.col("path")).alias("cross_program"),
        F.substring(F.sha2(F.concat_ws("\0", F.lit("1"), rule, "path", "source_kind", "from_path", "best.from_name", "best.name"), 256), 1, 32).alias("fingerprint"),
    )
