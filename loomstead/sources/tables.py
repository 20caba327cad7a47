"""Tables of a data folder and the line and finding relations over them, as Spark views."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The relations that every query may name, for each engine.
SPARK_LINES = "SELECT doc_id, source, lang, pos + 1 AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line"
DUCK_LINES = "SELECT doc_id, source, lang, unnest(generate_series(1, len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"

RELATIONS = """
rules_meta AS (SELECT * FROM (VALUES
  ('routable-address', 'low', 'exposure', 'CWE-497'), ('encoded-run', 'med', 'tampering', 'CWE-506'), ('literal-token', 'crit', 'construct', 'CWE-798'),
  ('contact-address', 'med', 'exposure', 'CWE-359'), ('license-line', 'info', 'context', ''), ('noise-run', 'info', 'coverage', '')) AS t(rule, sev, evidence, cwe)),
graph AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 + 1 AS dst FROM lineitem),
call_graph AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 + 1 AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'call' ELSE 'return' END AS kind, l_orderkey % 5 AS site FROM lineitem),
prog AS (SELECT user_id, ts, event_id, event_type AS verb, value FROM events)
"""
#: Line rules: thresholds suit the text tables rather than program source.
LINE_RULES = (
    ("routable-address", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), ("encoded-run", "[0-9a-fA-F]{32,}"), ("literal-token", 'token *= *"'),
    ("contact-address", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+"), ("license-line", "[Ll]icen[cs]e"), ("noise-run", "[%#$&*]{3}"),
)
FOUND = "concat(l.source, '/', CAST(l.doc_id AS VARCHAR(20))) AS path, l.line_no AS line, l.lang AS program, l.line AS text, l.doc_id"


def findings_text(engine: str) -> str:
    """The findings relation.  Spark tests every literal pattern in one projection over the lines; the oracle joins lines with rules."""
    if engine == "spark":
        hits = ", ".join(f"CASE WHEN regexp_like(line, '{p}') THEN '{r}' END" for r, p in LINE_RULES)
        return f"findings0 AS (SELECT rule, {FOUND} FROM (SELECT *, explode(filter(array({hits}), x -> x IS NOT NULL)) AS rule FROM lines) l)"
    rows = ", ".join(f"('{r}', '{p}')" for r, p in LINE_RULES)
    return f"line_rules AS (SELECT * FROM (VALUES {rows}) AS t(rule, pattern)), findings0 AS (SELECT r.rule, {FOUND} FROM lines l JOIN line_rules r ON regexp_matches(l.line, r.pattern))"


#: Words of the shared dialect and what each engine calls them.
WORDS = (
    ("RX(", "regexp_like(", "regexp_matches("),
    ("SHA(", "loom_sha(", "sha256("),
    ("[[", "array_join(sort_array(collect_list(", "array_to_string(list_sort(list("),
    ("]]", ")), ',')", ")), ',')"),
    ("STRPOS(", "instr(", "instr("),
)


def spark_text(text: str) -> str:
    for word, spark_word, _ in WORDS:
        text = text.replace(word, spark_word)
    while "loom_sha(" in text:
        at = text.index("loom_sha(") + len("loom_sha(")
        depth, end = 1, at
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[: at - len("loom_sha(")] + "sha2(" + text[at : end - 1] + ", 256)" + text[end:]
    return text


def duck_text(text: str) -> str:
    for word, _, duck_word in WORDS:
        text = text.replace(word, duck_word)
    return text


def with_relations(body: str, engine: str) -> str:
    """A query body (``SELECT ...`` or ``, more AS (...) SELECT ...``) behind the common relations of an engine."""
    lines = SPARK_LINES if engine == "spark" else DUCK_LINES
    head = f"WITH lines AS ({lines}), {findings_text(engine)}, {RELATIONS}"
    return (spark_text if engine == "spark" else duck_text)(head + body)


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
