"""The driver catalogue: every query over the test tables with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators import contexts as C
from loomstead.operators import graph as G
from loomstead.operators import joins as J
from loomstead.plans import rule_queries
from loomstead.plans.shared_sql import Q
from loomstead.sources.tables import duck_text, register, with_relations

FULL_REPLACE = ", 'g')"  # one engine replaces the first match unless told otherwise


def _declared(body: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(with_relations(body.replace(FULL_REPLACE, ")"), "spark"))

    return run


def _relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(with_relations(f"SELECT * FROM {name}", "spark"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def first_match_join(spark, sf_dir):
    """Each part with its supplier of least quantity, then of least key."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("p_partkey"), "l_suppkey").agg(F.min("l_quantity").alias("quantity"))
    return J.first_match(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), items, ["p_partkey"], [F.col("quantity"), F.col("l_suppkey")])


def nearest_match_join(spark, sf_dir):
    """Each customer with the suppliers of its nation, or else of its region."""
    read = lambda name, **cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*[F.col(c).alias(a) for a, c in cols.items()])
    tree = read("nation", leaf="n_nationkey", branch="n_regionkey")
    found = J.nearest_match(read("customer", left_id="c_custkey", leaf="c_nationkey"), read("supplier", right_id="s_suppkey", leaf="s_nationkey"), tree)
    return found.select(F.col("left_id").alias("c_custkey"), F.col("right_id").alias("s_suppkey"), "depth")


def multilevel_pairing(spark, sf_dir):
    """Documents of even ids paired with those of odd ids: by text, then language and length, then language."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), "lang", "n_chars")
    return J.pair_levels(d.where("id % 2 = 0"), d.where("id % 2 = 1"), [["digest"], ["lang", "n_chars"], ["lang"]], ["id"])


def entry_reach(spark, sf_dir):
    """Nodes that every twentieth node reaches."""
    g = _relation(spark, sf_dir, "graph").persist()
    found = G.reach(g, g.where("src % 20 = 0").select(F.col("src").alias("node")).distinct())
    return found.select("start", "node")


def shortest_trace(spark, sf_dir):
    """Fewest hops from each start."""
    g = _relation(spark, sf_dir, "graph").persist()
    found = G.reach(g, g.where("src % 20 = 0").select(F.col("src").alias("node")).distinct())
    return found.select("start", "node", F.col("level").alias("hops"))


def reverse_reach(spark, sf_dir):
    """Nodes that reach a sink (a target divisible by ten)."""
    g = _relation(spark, sf_dir, "graph").persist()
    return G.reverse_reach(g, g.where("dst % 10 = 0").select(F.col("dst").alias("node")).distinct()).select("node")


def dead_nodes(spark, sf_dir):
    """Nodes that no start reaches."""
    g = _relation(spark, sf_dir, "graph").persist()
    live = G.reach(g, g.where("src % 20 = 0").select(F.col("src").alias("node")).distinct()).select("node").distinct()
    return g.select(F.col("src").alias("node")).union(g.select("dst")).distinct().join(live, "node", "left_anti")


def all_routes(spark, sf_dir):
    """Edges on any way from a start to a sink: reached from a start and reaching a sink."""
    g = _relation(spark, sf_dir, "graph").persist()
    ahead = G.reach(g, g.where("src % 20 = 0").select(F.col("src").alias("node")).distinct()).select(F.col("node").alias("src")).distinct()
    back = G.reverse_reach(g, g.where("dst % 10 = 0").select(F.col("dst").alias("node")).distinct()).select(F.col("node").alias("dst"))
    return g.join(ahead, "src", "left_semi").join(back, "dst", "left_semi").select("src", "dst")


def refusal_walk(spark, sf_dir):
    """What starts still reach when nodes divisible by seven refuse."""
    g = _relation(spark, sf_dir, "graph").where("dst % 7 <> 0").persist()
    found = G.reach(g, g.where("src % 20 = 0").select(F.col("src").alias("node")).distinct())
    return found.select("start", "node")


def taint_walk(spark, sf_dir):
    """Nodes with the byte range that arrives: each edge clips the range to its own, an empty one ends the walk."""
    g = _relation(spark, sf_dir, "graph").select("src", "dst", (F.col("dst") % 8).alias("cut_lo"), (F.col("src") % 8 + 8).alias("cut_hi")).persist()
    start = g.where("src % 20 = 0").select(F.col("src").alias("node"), F.lit(0).cast("long").alias("lo"), F.lit(16).cast("long").alias("hi")).distinct()

    def hop(f: DataFrame) -> DataFrame:
        met = f.join(g, f["node"] == g["src"]).select(F.col("dst").alias("node"), F.greatest("lo", "cut_lo").alias("lo"), F.least("hi", "cut_hi").alias("hi"))
        return met.where("lo < hi")

    return G.fixpoint(start, hop, ["node", "lo", "hi"]).select("node", "lo", "hi")


def _calls(spark, sf_dir):
    """(edges with call and return kinds, starts) over suppliers and parts."""
    g = _relation(spark, sf_dir, "call_graph")  # not persisted: walks keep the edges that they can use
    return g, g.where("src % 20 = 0").select(F.col("src").alias("node")).distinct()


def context_reach(spark, sf_dir):
    """Nodes with the innermost four call sites and the fewest hops from a start."""
    found = C.context_reach(*_calls(spark, sf_dir), depth=4)
    return found.select("start", "node", F.array_join("stack", ",").alias("stack"), F.col("level").alias("hops"))


def summary_reach(spark, sf_dir):
    """Nodes each start reaches over matched calls and returns and open calls."""
    return C.summary_reach(*_calls(spark, sf_dir)).select("start", "node")


#: Products and what precedes their version in a text.
PINS = {"licence": "[Ll]icen[cs]e[^0-9]{0,12}([0-9]+[.]?[0-9]*)", "network": "([0-9]{1,3}[.][0-9]{1,3})[.][0-9]{1,3}[.][0-9]{1,3}", "token": "token *= *[^A-Za-z0-9]([A-Za-z0-9]{4})"}


def pin_extract(spark, sf_dir):
    """Distinct (document, product, version) by a table of patterns, in one pass over the texts."""
    hits = F.array(*[F.struct(F.lit(name).alias("product"), F.regexp_extract_all("text", F.lit(pattern), 1).alias("versions")) for name, pattern in PINS.items()])
    found = _documents(spark, sf_dir).select("doc_id", F.explode(hits).alias("h"))
    return found.select("doc_id", "h.product", F.explode("h.versions").alias("version")).distinct()


def tokenize_count(spark, sf_dir):
    """The words of every text with their counts."""
    words = _documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), 1)).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def ipv4_routable(spark, sf_dir):
    """Routable dotted quads by document with their first line; private and reserved ranges are left out."""
    lines = _relation(spark, sf_dir, "lines")
    hits = lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})"), 1)).alias("address"))
    part = lambda i: F.split("address", "[.]")[i].cast("int")
    a, b = part(0), part(1)
    ok = (F.greatest(a, b, part(2), part(3)) <= 255) & ~a.isin(0, 10, 127) & (a < 224) & ~((a == 172) & b.between(16, 31)) & ~((a == 192) & (b == 168)) & ~((a == 169) & (b == 254)) & ~((a == 100) & b.between(64, 127))
    return hits.where(ok).groupBy("doc_id", "address").agg(F.min("line_no").alias("first_line"))


def operand_split(spark, sf_dir):
    """Key and value of each parameter in page addresses; pages without any give their path parts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = pages.select("page_id", F.posexplode(F.split("url", "[/?&]")).alias("pos", "operand")).where("operand <> ''")
    return parts.select("page_id", F.col("pos").cast("int").alias("pos"), F.split("operand", "=")[0].alias("k"), F.when(F.col("operand").contains("="), F.substring_index("operand", "=", -1)).alias("v"))


def must_bit_and(spark, sf_dir):
    """Facts that hold on every way into a node: intersection over predecessors until no node changes."""
    g = _relation(spark, sf_dir, "graph").persist()
    facts = G.hold(g.select(F.col("src").alias("node")).union(g.select("dst")).distinct().withColumn("bits", F.lit(255).cast("long")))
    while True:
        into = g.join(facts, g["src"] == facts["node"]).groupBy("dst").agg(F.bit_and(F.col("bits").bitwiseAND(F.lit(255) - F.call_function("shiftleft", F.lit(1), (F.col("src") % 8).cast("int"))).bitwiseOR(F.call_function("shiftleft", F.lit(1), (F.col("dst") % 8).cast("int")))).alias("met"))
        both = G.hold(facts.join(into, facts["node"] == into["dst"], "left").select("node", F.coalesce("met", F.lit(0).cast("long")).alias("bits"), (F.coalesce("met", F.lit(0)) != F.col("bits")).alias("changed")))
        facts = both.select("node", "bits")
        if both.where("changed").isEmpty():
            return facts


_STARTS = "starts AS (SELECT DISTINCT src AS node FROM graph WHERE src % 20 = 0)"
_ROUNDS = 6
_DUCK = {
    "context_reach": f""", {_STARTS.replace("graph", "call_graph")}, r(start, node, stack, hops) USING KEY (start, node, stack) AS (SELECT node, node, CAST([] AS BIGINT[]), 0 FROM starts UNION
 SELECT n.* FROM (SELECT DISTINCT r.start, g.dst AS node, CASE g.kind WHEN 'call' THEN list_append(r.stack, g.site)[-4:] WHEN 'return' THEN r.stack[:greatest(len(r.stack) - 1, 0)] ELSE r.stack END AS stack, r.hops + 1 AS hops
 FROM r JOIN call_graph g ON g.src = r.node WHERE g.kind <> 'return' OR len(r.stack) = 0 OR r.stack[-1] = g.site) n ANTI JOIN recurring.r s ON s.start = n.start AND s.node = n.node AND s.stack = n.stack)
 SELECT start, node, array_to_string(stack, ',') AS stack, hops FROM r""",
    "summary_reach": f", {_STARTS.replace('graph', 'call_graph')}, entries AS (SELECT DISTINCT dst AS node FROM call_graph WHERE kind = 'call'), s0 AS (SELECT DISTINCT src, dst FROM call_graph WHERE kind = 'plain')"
    + "".join(f", p{k} AS (SELECT node AS start, node FROM entries UNION SELECT p.start, s.dst FROM p{k} p JOIN s{k} s ON s.src = p.node), s{k + 1} AS MATERIALIZED (SELECT src, dst FROM s{k} UNION SELECT c.src, b.dst FROM call_graph c JOIN p{k} p ON p.start = c.dst JOIN call_graph b ON b.src = p.node AND b.site = c.site WHERE c.kind = 'call' AND b.kind = 'return')" for k in range(_ROUNDS))
    + f", ahead AS (SELECT src, dst FROM s{_ROUNDS} UNION SELECT src, dst FROM call_graph WHERE kind = 'call'), r AS (SELECT node AS start, node FROM starts UNION SELECT r.start, a.dst FROM r JOIN ahead a ON a.src = r.node) SELECT start, node FROM r",
    "pin_extract": " SELECT DISTINCT doc_id, product, version FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS product, unnest(regexp_extract_all(text, '{pattern}', 1)) AS version FROM documents" for name, pattern in PINS.items()) + ") x",
    "first_match_join": "SELECT p_partkey, l_suppkey, quantity FROM (SELECT l_partkey AS p_partkey, l_suppkey, min(l_quantity) AS quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY min(l_quantity), l_suppkey) AS nth FROM lineitem GROUP BY l_partkey, l_suppkey) x WHERE nth = 1",
    "multilevel_pairing": """, d AS (SELECT doc_id AS id, sha256(text) AS digest, lang, n_chars FROM documents),
 a0 AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY id) AS nth FROM d WHERE id % 2 = 0), b0 AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY id) AS nth FROM d WHERE id % 2 = 1),
 m0 AS (SELECT a0.id AS base_id, b0.id AS head_id, 0 AS level FROM a0 JOIN b0 ON a0.digest = b0.digest AND a0.nth = b0.nth),
 a1 AS (SELECT id, lang, n_chars, row_number() OVER (PARTITION BY lang, n_chars ORDER BY id) AS nth FROM d WHERE id % 2 = 0 AND id NOT IN (SELECT base_id FROM m0)), b1 AS (SELECT id, lang, n_chars, row_number() OVER (PARTITION BY lang, n_chars ORDER BY id) AS nth FROM d WHERE id % 2 = 1 AND id NOT IN (SELECT head_id FROM m0)),
 m1 AS (SELECT a1.id AS base_id, b1.id AS head_id, 1 AS level FROM a1 JOIN b1 ON a1.lang = b1.lang AND a1.n_chars = b1.n_chars AND a1.nth = b1.nth),
 a2 AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY id) AS nth FROM d WHERE id % 2 = 0 AND id NOT IN (SELECT base_id FROM m0) AND id NOT IN (SELECT base_id FROM m1)), b2 AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY id) AS nth FROM d WHERE id % 2 = 1 AND id NOT IN (SELECT head_id FROM m0) AND id NOT IN (SELECT head_id FROM m1))
 SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT a2.id, b2.id, 2 FROM a2 JOIN b2 ON a2.lang = b2.lang AND a2.nth = b2.nth""",
    "entry_reach": f", {_STARTS}, r AS (SELECT node AS start, node FROM starts UNION SELECT r.start, g.dst FROM r JOIN graph g ON g.src = r.node) SELECT start, node FROM r",
    "shortest_trace": f", {_STARTS}, r(start, node, hops) USING KEY (start, node) AS (SELECT node, node, 0 FROM starts UNION SELECT n.* FROM (SELECT DISTINCT r.start, g.dst AS node, r.hops + 1 AS hops FROM r JOIN graph g ON g.src = r.node) n ANTI JOIN recurring.r s ON s.start = n.start AND s.node = n.node) SELECT start, node, hops FROM r",
    "reverse_reach": ", r AS (SELECT dst AS node FROM graph WHERE dst % 10 = 0 UNION SELECT g.src FROM r JOIN graph g ON g.dst = r.node) SELECT node FROM r",
    "dead_nodes": f", {_STARTS}, r AS (SELECT node FROM starts UNION SELECT g.dst FROM r JOIN graph g ON g.src = r.node) SELECT src AS node FROM graph WHERE src NOT IN (SELECT node FROM r) UNION SELECT dst FROM graph WHERE dst NOT IN (SELECT node FROM r)",
    "all_routes": f", {_STARTS}, r AS (SELECT node FROM starts UNION SELECT g.dst FROM r JOIN graph g ON g.src = r.node), b AS (SELECT dst AS node FROM graph WHERE dst % 10 = 0 UNION SELECT g.src FROM b JOIN graph g ON g.dst = b.node) SELECT src, dst FROM graph WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM b)",
    "refusal_walk": ", kept AS (SELECT * FROM graph WHERE dst % 7 <> 0), r AS (SELECT DISTINCT src AS start, src AS node FROM kept WHERE src % 20 = 0 UNION SELECT r.start, g.dst FROM r JOIN kept g ON g.src = r.node) SELECT start, node FROM r",
    "taint_walk": ", r AS (SELECT DISTINCT src AS node, 0::BIGINT AS lo, 16::BIGINT AS hi FROM graph WHERE src % 20 = 0 UNION SELECT g.dst, greatest(r.lo, g.dst % 8), least(r.hi, g.src % 8 + 8) FROM r JOIN graph g ON g.src = r.node WHERE greatest(r.lo, g.dst % 8) < least(r.hi, g.src % 8 + 8)) SELECT DISTINCT node, lo, hi FROM r",
    "tokenize_count": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS token FROM documents) t GROUP BY token",
    "ipv4_routable": ", h AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS address FROM lines), q AS (SELECT *, split_part(address, '.', 1)::INT AS a, split_part(address, '.', 2)::INT AS b, split_part(address, '.', 3)::INT AS c, split_part(address, '.', 4)::INT AS d FROM h) SELECT doc_id, address, min(line_no) AS first_line FROM q WHERE greatest(a, b, c, d) <= 255 AND a NOT IN (0, 10, 127) AND a < 224 AND NOT (a = 172 AND b BETWEEN 16 AND 31) AND NOT (a = 192 AND b = 168) AND NOT (a = 169 AND b = 254) AND NOT (a = 100 AND b BETWEEN 64 AND 127) GROUP BY doc_id, address",
    "operand_split": ", p AS (SELECT page_id, unnest(generate_series(0, len(regexp_split_to_array(url, '[/?&]')) - 1))::INT AS pos, unnest(regexp_split_to_array(url, '[/?&]')) AS operand FROM pages) SELECT page_id, pos, split_part(operand, '=', 1) AS k, CASE WHEN contains(operand, '=') THEN split_part(operand, '=', -1) END AS v FROM p WHERE operand <> ''",
    "must_bit_and": """, nodes AS (SELECT src AS node FROM graph UNION SELECT dst FROM graph), f(node, bits) USING KEY (node) AS (SELECT node, 255::BIGINT FROM nodes UNION
 SELECT n.node, n.bits FROM (SELECT n.node, coalesce(bit_and((p.bits & (255 - (1 << (g.src % 8)))) | (1 << (g.dst % 8))), 0)::BIGINT AS bits FROM nodes n LEFT JOIN graph g ON g.dst = n.node LEFT JOIN recurring.f p ON p.node = g.src GROUP BY n.node) n JOIN recurring.f o ON o.node = n.node WHERE o.bits <> n.bits) SELECT node, bits FROM f""",
}
_FRAMES = (first_match_join, nearest_match_join, multilevel_pairing, entry_reach, shortest_trace, reverse_reach, dead_nodes, all_routes, refusal_walk, taint_walk, context_reach, summary_reach, pin_extract, tokenize_count, ipv4_routable, operand_split, must_bit_and)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _declared(body) for name, body in Q.items()} | {f.__name__: f for f in _FRAMES} | rule_queries.queries()


def oracle_sql() -> dict[str, str]:
    declared = {name: with_relations(body, "duck") for name, body in Q.items()}
    return declared | {name: with_relations(body, "duck").replace("WITH ", "WITH RECURSIVE ", 1) for name, body in _DUCK.items()} | rule_queries.oracle_sql()
