"""Data sets that jobs copy, by what each utility reads and writes, and where their content goes from there.

Joins and projections over the fact table; a step is a path and a step name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.graph import fixpoint

#: Utilities that copy from one DD to another without saying so in control statements.
FIXED_COPIES = {
    "IEBGENER": (("SYSUT1", "SYSUT2"),), "ICEGENER": (("SYSUT1", "SYSUT2"),), "IEBPTPCH": (("SYSUT1", "SYSUT2"),), "IEBUPDTE": (("SYSUT1", "SYSUT2"), ("SYSIN", "SYSUT2")),
    "SORT": (("SORTIN", "SORTOUT"),), "DFSORT": (("SORTIN", "SORTOUT"),), "SYNCSORT": (("SORTIN", "SORTOUT"),), "ICEMAN": (("SORTIN", "SORTOUT"),),
}
#: Fixed values: (utilities, statement, operand that reads, operand that writes, whether they name DDs).
STATED_COPIES = (
    (("IDCAMS",), "REPRO", "INFILE|IFILE", "OUTFILE|OFILE", True), (("IDCAMS",), "REPRO", "INDATASET|IDS", "OUTDATASET|ODS", False),
    (("IEBCOPY",), "C(?:OPY|OPYMOD)?", "INDD|I", "OUTDD|O", True), (("ICETOOL",), "COPY|SORT|SELECT|SPLICE", "FROM", "TO|USING", True),
    (("SORT", "DFSORT", "SYNCSORT", "ICEMAN"), "OUTFIL", None, "FNAMES|FILES", True),
)


def _steps(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'step' and kind = 'jcl'").select("path", F.col("name").alias("step"), F.upper("value").alias("program"), "line")


def _dds(facts: DataFrame) -> DataFrame:
    """(path, step, dd, dsn): data sets by DD; a member's name is left off."""
    dd = facts.where("fact = 'dd' and kind = 'jcl' and operands['DSN'] is not null or fact = 'dd' and operands['DSNAME'] is not null")
    dsn = F.coalesce(F.col("operands")["DSN"], F.col("operands")["DSNAME"])
    return dd.select("path", F.col("parent").alias("step"), F.col("name").alias("dd"), F.regexp_replace(F.regexp_replace(dsn, "'", ""), r"\([^)]*\)$", "").alias("dsn"))


def _operand(text: Column, names: str) -> Column:
    """The value of NAME(value), NAME=value or NAME=(value); empty if it is not there."""
    return F.regexp_extract(text, rf"(?i)(?:^|[\s,(])(?:{names})(?:\s*\(\s*|=\(*)'?([^\s,)']+)", 1)


def control_statements(facts: DataFrame) -> DataFrame:
    """(path, step, statement): control text of each step in one line a statement.

    A card that ends in a comma, a hyphen or a plus sign goes on; the cards of one in-stream file are put
    together by a running count of the cards that do not.
    """
    cards = facts.where("fact = 'data' and kind = 'jcl'").select("path", F.col("parent").alias("step"), F.col("name").alias("dd"), "line", F.trim(F.substring(F.coalesce("value", F.lit("")), 1, 72)).alias("card"))
    cards = cards.where("card <> '' and substring(card, 1, 1) <> '*' and substring(card, 1, 2) <> '/*'")
    order = Window.partitionBy("path", "step", "dd").orderBy("line")
    goes_on = F.col("card").rlike(r"[,+-]$")
    cards = cards.withColumn("begins", ~F.coalesce(F.lag(goes_on).over(order), F.lit(False))).withColumn("nth", F.sum(F.col("begins").cast("int")).over(order))
    joined = cards.groupBy("path", "step", "dd", "nth").agg(F.sort_array(F.collect_list(F.struct("line", F.regexp_replace("card", r"\s*[+-]$", "").alias("card")))).alias("cards"))
    return joined.select("path", "step", F.array_join("cards.card", " ").alias("statement"))


def copies(facts: DataFrame) -> DataFrame:
    """(path, step, program, src, dst): distinct data set copies of utility steps; a copy onto itself is left out."""
    steps, dds = _steps(facts), _dds(facts)
    pairs = facts.sparkSession.createDataFrame([(p, a, b) for p, ways in FIXED_COPIES.items() for a, b in ways], "program string, from_dd string, to_dd string")
    named = steps.join(F.broadcast(pairs), "program").select("path", "step", "program", "from_dd", "to_dd")
    said = control_statements(facts).join(steps, ["path", "step"])
    direct = None
    for programs, statement, reads, writes, by_dd in STATED_COPIES:
        hit = said.where(F.col("program").isin(*programs) & F.col("statement").rlike(rf"(?i)^(?:\S+:\s*|\S+\s+)?(?:{statement})\b"))
        hit = hit.select("path", "step", "program", _operand(F.col("statement"), reads).alias("a") if reads else F.lit("SORTIN").alias("a"), _operand(F.col("statement"), writes).alias("b")).where("a <> '' and b <> ''")
        if by_dd:
            named = named.unionByName(hit.select("path", "step", "program", F.upper("a").alias("from_dd"), F.upper("b").alias("to_dd")))
        else:
            direct = hit.select("path", "step", "program", F.upper("a").alias("src"), F.upper("b").alias("dst"))
    met = named.join(dds.select("path", "step", F.col("dd").alias("from_dd"), F.col("dsn").alias("src")), ["path", "step", "from_dd"])
    met = met.join(dds.select("path", "step", F.col("dd").alias("to_dd"), F.col("dsn").alias("dst")), ["path", "step", "to_dd"])
    return met.select("path", "step", "program", "src", "dst").unionByName(direct).where("src <> dst").distinct()


def lineage(facts: DataFrame, rounds: int | None = None) -> DataFrame:
    """(origin, dataset, hops): data sets whose content comes from another through copies, by fewest copies."""
    edges = copies(facts).select("src", "dst").distinct()
    step = lambda f: f.join(edges, f["dataset"] == edges["src"]).select("origin", F.col("dst").alias("dataset"))
    found = fixpoint(edges.select(F.col("src").alias("origin"), F.col("dst").alias("dataset")), step, ["origin", "dataset"], rounds)
    return found.where("origin <> dataset").select("origin", "dataset", (F.col("level") + 1).alias("hops"))


def host_variables(facts: DataFrame) -> DataFrame:
    """(path, line, name, role): host variables of embedded SQL that the statement sets ('written') or uses ('read').

    Those of an INTO list of SELECT, FETCH or VALUES are written, and one after SET before an equals sign; all others are read.
    """
    text = F.col("operands")["TEXT"]
    found = facts.where("fact = 'exec' and name = 'SQL'").select("path", "line", text.alias("t"))
    into = F.regexp_extract("t", r"(?i)^(?:SELECT|FETCH|VALUES)\b.*?\bINTO\b((?:\s*:\s*[\w-]+(?:\s*\.\s*[\w-]+)?(?:\s*:\s*[\w-]+)?\s*,?)+)", 1)
    assigned = F.regexp_extract("t", r"(?i)^SET\b(\s*:\s*[\w-]+\s*)=", 1)
    hosts = lambda c: F.regexp_extract_all(c, F.lit(r":\s*([A-Za-z][\w-]*)"), 1)
    written = F.array_distinct(F.concat(hosts(into), hosts(assigned)))
    rest = F.when(into != "", F.replace("t", into, F.lit(" "))).when(assigned != "", F.replace("t", assigned, F.lit(" "))).otherwise(F.col("t"))
    roles = F.concat(F.transform(written, lambda n: F.struct(n.alias("name"), F.lit("written").alias("role"))), F.transform(F.array_distinct(hosts(rest)), lambda n: F.struct(n.alias("name"), F.lit("read").alias("role"))))
    return found.select("path", "line", F.explode(roles).alias("r")).select("path", "line", "r.name", "r.role").distinct()
