"""Reports as documents: SARIF, CycloneDX, Markdown, provenance statements and hash-chained journals.

A document is a DataFrame of (section, n, value) lines; ``write_document`` lays them in order into text
parts whose concatenation in name order is the document, so no report passes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.operators.graph import hold

#: Fixed values of the SARIF 2.1.0 levels by severity.
LEVELS = {"crit": "error", "high": "error", "med": "warning", "low": "note", "info": "note"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: The name space of document ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:loomstead:report")


def numbered(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Gapless numbers from 0 in the order of the keys, without moving all rows to one task.

    Rows are dealt by range and counted by partition; only one count a partition is summed in one place.
    """
    dealt = hold(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_begin"))
    out = dealt.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return out.withColumn(name, F.col("_begin") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_begin")


def _fixed(spark: SparkSession, lines: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame([(section, 0, value) for section, value in lines], "section int, n long, value string")


def _listed(section: int, rows: DataFrame, value: Column) -> DataFrame:
    """Members of a JSON list from rows with their number ``n``: all but the first begin with a comma."""
    return rows.select(F.lit(section).alias("section"), "n", F.concat(F.when(F.col("n") > 0, ",").otherwise(""), value).alias("value"))


def write_document(lines: DataFrame, path: str) -> None:
    """Write a document's lines in order as text parts."""
    lines.repartitionByRange("section", "n").sortWithinPartitions("section", "n").select("value").write.mode("overwrite").text(path)


def sarif(findings: DataFrame, rules: DataFrame, tool: str = "loomstead") -> DataFrame:
    """A SARIF 2.1.0 document of ``findings(rule, path, line, sev, detail, fingerprint[, suppressed])`` and ``rules(rule, cwe)``.

    Rules and artifacts are listed once in name order and results refer to them by index.  Null severities
    are notes, null details are empty, a null line leaves the region out; rows without a rule or path are left out.
    A rule that only findings name is listed too.
    """
    spark = findings.sparkSession
    rows = findings.where("rule is not null and path is not null")
    if "suppressed" not in rows.columns:
        rows = rows.withColumn("suppressed", F.lit(False))
    named = rules.where("rule is not null").select("rule", "cwe").unionByName(rows.select("rule", F.lit(None).cast("string").alias("cwe")))
    ruled = numbered(named.groupBy("rule").agg(F.max("cwe").alias("cwe")), ["rule"])
    artifacts = numbered(rows.select("path").distinct(), ["path"])
    placed = rows.join(ruled.select("rule", F.col("n").alias("rule_index")), "rule").join(artifacts.select("path", F.col("n").alias("artifact_index")), "path")
    results = numbered(placed, ["path", "line", "rule", "fingerprint"])
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.coalesce("sev", F.lit("info"))), F.lit("note"))
    place = F.struct(F.struct(F.col("path").alias("uri"), F.col("artifact_index").alias("index")).alias("artifactLocation"), F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"))).alias("region"))
    result = F.struct(
        F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.coalesce("detail", F.lit("")).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), F.when(F.col("fingerprint").isNotNull(), F.struct(F.col("fingerprint").alias("primary/v1"))).alias("partialFingerprints"),
        F.when(F.col("suppressed"), F.array(F.struct(F.lit("external").alias("kind")))).alias("suppressions"),
    )
    rule = F.struct(F.col("rule").alias("id"), F.when(F.col("cwe") != "", F.struct(F.array("cwe").alias("tags"))).alias("properties"))
    head = '{"$schema":%s,"version":"2.1.0","runs":[{"tool":{"driver":{"name":%s,"rules":[' % (json.dumps(SARIF_SCHEMA), json.dumps(tool))
    frame = _fixed(spark, [(0, head), (2, ']}},"artifacts":['), (4, '],"results":['), (6, "]}]}")])
    lists = _listed(1, ruled, F.to_json(rule)), _listed(3, artifacts, F.to_json(F.struct(F.struct(F.col("path").alias("uri")).alias("location")))), _listed(5, results, F.to_json(result))
    return frame.unionByName(lists[0]).unionByName(lists[1]).unionByName(lists[2])


def sbom(components: DataFrame, uses: DataFrame) -> DataFrame:
    """A CycloneDX 1.6 document of ``components(ref, name, type, version)`` and ``uses(src, dst)`` edges.

    Repeated rows count once; edges with an end that is no component are left out.  The serial number
    depends on the content alone, in any order.
    """
    spark = components.sparkSession
    parts = hold(components.where("ref is not null").groupBy("ref").agg(*[F.max(c).alias(c) for c in ("name", "type", "version")]))
    known = parts.select("ref")
    edges = uses.select("src", "dst").distinct().join(known.withColumnRenamed("ref", "src"), "src", "left_semi").join(known.withColumnRenamed("ref", "dst"), "dst", "left_semi")
    depends = hold(edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dependsOn")))
    digest = lambda df: str(tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()))
    serial = uuid.uuid5(NAMESPACE, digest(parts) + digest(depends))
    component = F.struct(F.coalesce("type", F.lit("application")).alias("type"), F.col("ref").alias("bom-ref"), F.coalesce("name", "ref").alias("name"), "version")
    head = '{"bomFormat":"CycloneDX","specVersion":"1.6","serialNumber":"urn:uuid:%s","version":1,"components":[' % serial
    frame = _fixed(spark, [(0, head), (2, '],"dependencies":['), (4, "]}")])
    return frame.unionByName(_listed(1, numbered(parts, ["ref"]), F.to_json(component))).unionByName(_listed(3, numbered(depends.withColumnRenamed("src", "ref"), ["ref"]), F.to_json(F.struct("ref", "dependsOn"))))


def markdown(findings: DataFrame, title: str = "Findings") -> DataFrame:
    """A Markdown document: a heading with its count for each rule, then its findings by path and line."""
    rows = findings.where("rule is not null").select("rule", F.coalesce("path", F.lit("?")).alias("path"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("detail", F.lit("")).alias("detail"))
    plain = F.regexp_replace(F.regexp_replace("detail", r"[\r\n]+", " "), r"([\\`*_\[\]<>|])", r"\\$1")
    heads = rows.groupBy("rule").agg(F.count("*").alias("many")).select("rule", F.lit(0).alias("rank"), F.lit("").alias("path"), F.lit(0).alias("line"), F.concat(F.lit("\n## "), "rule", F.lit(" ("), "many", F.lit(")\n")).alias("value"))
    items = rows.select("rule", F.lit(1).alias("rank"), "path", "line", F.concat(F.lit("- `"), F.regexp_replace("path", "`", "'"), F.lit(":"), "line", F.lit("` "), plain).alias("value"))
    body = numbered(heads.unionByName(items), ["rule", "rank", "path", "line", "value"]).select(F.lit(1).alias("section"), "n", "value")
    return _fixed(findings.sparkSession, [(0, f"# {title}")]).unionByName(body)


def provenance(subjects: dict[str, str], builder: str, kind: str, inputs: dict[str, str]) -> dict:
    """An in-toto statement (SLSA 1.0 predicate) that binds outputs to inputs by SHA-256."""
    listed = lambda d: [{"name": k, "digest": {"sha256": v}} for k, v in sorted(d.items())]
    definition = {"buildType": kind, "externalParameters": {}, "resolvedDependencies": listed(inputs)}
    return {"_type": "https://in-toto.io/Statement/v1", "subject": listed(subjects), "predicateType": "https://slsa.dev/provenance/v1", "predicate": {"buildDefinition": definition, "runDetails": {"builder": {"id": builder}}}}


JOURNAL = "chain string, seq long, prev string, kind string, at string, fields string, hash string"


def _link(chain: str, seq: int, prev: str, kind: str, at: str, fields: str) -> str:
    return hashlib.sha256("\0".join((chain, str(seq), prev, kind, at, fields)).encode()).hexdigest()


def append_journal(spark: SparkSession, path: str, chain: str, records: list[tuple[str, str, dict]], create: bool = False) -> str:
    """Append (kind, at, fields) records to a chain of a journal folder and return the last hash.  Keys of fields are sorted.

    One writer a chain; ``create`` begins a journal.
    """
    last = None if create else spark.read.schema(JOURNAL).json(path).where(F.col("chain") == chain).orderBy(F.desc("seq")).first()
    seq, prev, rows = (last["seq"], last["hash"], []) if last else (-1, "", [])
    for kind, at, fields in records:
        seq, text = seq + 1, json.dumps(fields, sort_keys=True, separators=(",", ":"))
        this = _link(chain, seq, prev, kind, at, text)
        rows.append((chain, seq, prev, kind, at, text, this))
        prev = this
    spark.createDataFrame(rows, JOURNAL).coalesce(1).write.mode("append").json(path)
    return prev


def verify_journal(records: DataFrame) -> DataFrame:
    """(chain, seq, problem) of every record that breaks its chain: hash, place, link to the one before, or repeated."""
    order = Window.partitionBy("chain").orderBy("seq", "hash")
    again = F.sha2(F.concat_ws("\0", "chain", F.col("seq").cast("string"), "prev", "kind", "at", "fields"), 256)
    before = records.withColumn("_hash", F.lag("hash").over(order)).withColumn("_seq", F.lag("seq").over(order))
    problem = (
        F.when(F.coalesce(again != F.col("hash"), F.lit(True)), "hash")
        .when(F.col("seq") == F.col("_seq"), "repeated").when(F.col("seq") != F.coalesce("_seq", F.lit(-1)) + 1, "gap")
        .when(F.col("prev") != F.coalesce("_hash", F.lit("")), "link")
    )
    return before.select("chain", "seq", problem.alias("problem")).where("problem is not null")
