"""Operators of the catalogue whose plan is one declarative query, in a dialect that both engines read."""

from __future__ import annotations

Q: dict[str, str] = {}

# --- scans, sources, scalar functions
Q["scan_inventory"] = "SELECT source, lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT SHA(text)) AS contents, CAST(sum(CASE WHEN length(text) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empties FROM documents GROUP BY source, lang"
Q["classify_first_match"] = """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN RX(head, '<html|<div|<p>') THEN 'html' WHEN RX(head, '[Ll]icen[cs]e') THEN 'licence' WHEN RX(head, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+') THEN 'pii' WHEN RX(head, '[%#$&*]{3}') THEN 'noise' WHEN RX(head, '[|]') THEN 'table' ELSE 'prose' END AS kind
 FROM (SELECT substring(text, 1, 4096) AS head FROM documents UNION ALL SELECT substring(html, 1, 4096) FROM pages) h) k GROUP BY kind"""
Q["scope_filter"] = "SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT lower(d.source) LIKE '%1%'"
Q["duplicate_content"] = "SELECT SHA(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY SHA(text) HAVING count(*) > 1"
Q["shadowed_names"] = "SELECT name, count(*) AS holders, count(DISTINCT SHA(html)) AS contents FROM (SELECT html, regexp_replace(url, '^.*/', '') AS name FROM pages) p GROUP BY name HAVING count(*) > 1 AND count(DISTINCT SHA(html)) > 1"
Q["format_ratio"] = "SELECT doc_id, CAST(sum(CASE WHEN RX(line, '^[A-Z]') THEN 1 ELSE 0 END) AS BIGINT) AS upper_lines, count(*) AS n_lines, CASE WHEN 2 * sum(CASE WHEN RX(line, '^[A-Z]') THEN 1 ELSE 0 END) >= count(*) THEN 'fixed' ELSE 'free' END AS format FROM lines GROUP BY doc_id"
Q["card_columns"] = "SELECT lang, count(DISTINCT substring(line, 1, 6)) AS sequences, count(DISTINCT substring(line, 7, 1)) AS indicators, CAST(sum(length(substring(line, 8, 65))) AS BIGINT) AS text_chars, CAST(sum(length(substring(line, 73, 8))) AS BIGINT) AS ident_chars FROM lines GROUP BY lang"
Q["canonical_text"] = "SELECT doc_id, line_no, lower(trim(regexp_replace(line, '[ ]+', ' ', 'g'))) AS canonical FROM lines"
Q["secret_mask"] = """SELECT doc_id, line_no, regexp_replace(line, 'token *= *"[^"]*"', 'token = "***"', 'g') AS masked FROM lines WHERE RX(line, 'token *= *"')"""
Q["symbol_substitute"] = "SELECT p_partkey, replace(replace(replace(p_type, 'STANDARD', '&STD'), 'SMALL', '&SML'), 'ECONOMY', '&ECO') AS symbolic FROM part"
Q["picture_digits"] = "SELECT p_partkey, length(regexp_replace(p_brand, '[^0-9]', '', 'g')) AS digits, CAST(concat('0', regexp_replace(p_brand, '[^0-9]', '', 'g')) AS BIGINT) AS value FROM part"
Q["glob_classify"] = "SELECT page_id, CASE WHEN RX(lower(url), '^[^/]*//[^/]+/(prod|live|www)/') THEN 'production' WHEN RX(lower(url), '(test|dev|sample|[0-9]0)') THEN 'non-production' ELSE 'undecided' END AS zone FROM pages"
Q["prefix_join"] = ", q AS (SELECT * FROM (VALUES (1, 'Brand#1'), (2, 'Brand#2'), (3, 'Brand#22'), (4, 'Brand#3')) AS t(pos, prefix)) SELECT p_partkey, min(q.pos) AS first_match FROM part JOIN q ON p_brand = q.prefix OR p_brand LIKE concat(q.prefix, '%') GROUP BY p_partkey"
Q["version_match"] = ", ranges AS (SELECT * FROM (VALUES ('low', 0, 0, 10, 5), ('mid', 10, 5, 30, 0), ('high', 30, 0, 99, 0)) AS t(name, lo, lo_minor, hi, hi_minor)) SELECT p_partkey, r.name FROM part p JOIN ranges r ON (p_size > lo OR (p_size = lo AND p_partkey % 10 >= lo_minor)) AND (p_size < hi OR (p_size = hi AND p_partkey % 10 < hi_minor))"
Q["name_classify"] = "SELECT p_partkey, CASE WHEN RX(p_name, '(^| )(safe|ivory|linen)( |$)') THEN 'safe' WHEN RX(p_name, '(^| )(red|burnt|steel|blue)( |$)') THEN 'credential' WHEN RX(p_name, '(^| )(green|almond|antique|part)( |$)') THEN 'personal' ELSE 'none' END AS class FROM part"
for _name, _pattern in {"encoded_run": "[0-9a-fA-F]{32,}", "invisible_chars": "[​‮⁦⁩]", "fetch_and_run": "(curl|wget)[^|]*[|] *(ba)?sh"}.items():
    Q[_name] = f"SELECT lang, CAST(sum(CASE WHEN RX(line, '{_pattern}') THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n_lines FROM lines GROUP BY lang"
Q["pack_rules"] = "SELECT rule, program AS lang, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM findings0 GROUP BY rule, program"
Q["feed_validate"] = """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT RX(props, '"k": *-?[0-9]+ *[,}]') THEN 'not a whole number' WHEN RX(props, '"k": *-') THEN 'negative' ELSE 'accepted' END AS reason FROM events) e GROUP BY reason"""
Q["site_facts"] = """SELECT event_type, count(*) AS n, CAST(sum(CAST(concat('0', regexp_extract(props, '"k": *([0-9]+)', 1)) AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY event_type"""

# --- joins
Q["nearest_match_join"] = ", c AS (SELECT c_custkey, s_suppkey, CASE WHEN c_nationkey = s_nationkey THEN 1 ELSE 0 END AS depth FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey WHERE c_custkey % 10 = 0), r AS (SELECT *, rank() OVER (PARTITION BY c_custkey ORDER BY depth DESC) AS place FROM c) SELECT c_custkey, s_suppkey, depth FROM r WHERE place = 1".replace(" WHERE c_custkey % 10 = 0", "")
Q["positional_zip_join"] = ", a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem) SELECT x.l_orderkey, x.pos, x.l_partkey AS argument, y.l_partkey AS parameter FROM a x JOIN a y ON y.l_orderkey = x.l_orderkey + 1 AND y.pos = x.pos"
Q["unique_key_join"] = ", k AS (SELECT page_id, regexp_replace(url, '^.*/', '') AS name FROM pages), u AS (SELECT name, min(page_id) AS holder FROM k GROUP BY name HAVING count(*) = 1) SELECT k.page_id, u.name, u.holder FROM k JOIN u ON u.name = k.name"
Q["two_hop_join"] = "SELECT s_nationkey, count(*) AS touches, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus <> 'P' GROUP BY s_nationkey"
Q["left_chain_case"] = "SELECT c_custkey, CASE WHEN n_name IS NULL THEN 'unknown' WHEN r_name IS NULL THEN 'no region' WHEN r_name LIKE 'A%' THEN 'internal' ELSE 'external' END AS destination FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2"
Q["fallback_join"] = ", specific AS (SELECT c_nationkey AS nk, c_mktsegment AS seg, min(c_custkey) AS holder FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey, c_mktsegment), general AS (SELECT c_nationkey AS nk, min(c_custkey) AS holder FROM customer GROUP BY c_nationkey) SELECT c.c_custkey, coalesce(s.holder, g.holder) AS holder, CASE WHEN s.holder IS NULL THEN 'general' ELSE 'specific' END AS via FROM customer c LEFT JOIN specific s ON s.nk = c.c_nationkey AND s.seg = c.c_mktsegment LEFT JOIN general g ON g.nk = c.c_nationkey"
Q["semi_join"] = "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1996)"
Q["anti_join"] = "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)"
Q["array_except_grants"] = ", a AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) = 1996) SELECT a.o_custkey, [[a.o_orderstatus]] AS unused FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus WHERE b.o_custkey IS NULL GROUP BY a.o_custkey"
Q["self_join_referback"] = "SELECT a.l_orderkey, a.l_linenumber, min(b.l_linenumber) AS refers_to FROM lineitem a LEFT JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND (b.l_partkey = a.l_partkey OR b.l_suppkey = a.l_suppkey) GROUP BY a.l_orderkey, a.l_linenumber"
Q["interval_overlap_join"] = ", s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS hi, l_quantity AS w, l_discount FROM lineitem) SELECT a.l_orderkey, a.l_linenumber AS item, b.l_linenumber AS other FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND b.l_discount > 0.05 AND a.l_linenumber <> b.l_linenumber AND a.hi - a.w < b.hi + 5 AND b.hi - b.w < a.hi"
Q["interval_contain_join"] = "SELECT b.item_id, d.doc_id, STRPOS(d.text, b.text) AS at FROM benchmark b JOIN documents d ON STRPOS(d.text, b.text) > 0"
Q["rule_meta_stamp"] = "SELECT f.rule, f.path, f.line, m.sev, m.evidence, m.cwe FROM findings0 f LEFT JOIN rules_meta m ON m.rule = f.rule"
Q["compliance_matrix"] = ", clauses AS (SELECT * FROM (VALUES ('routable-address', 'A.1'), ('literal-token', 'A.2'), ('literal-token', 'B.7'), ('unknown-rule', 'C.1')) AS t(rule, clause)) SELECT coalesce(m.rule, c.rule) AS rule, c.clause, CASE WHEN c.rule IS NULL THEN 'unmapped' WHEN m.rule IS NULL THEN 'no rule' ELSE 'mapped' END AS state FROM rules_meta m FULL OUTER JOIN clauses c ON c.rule = m.rule"
Q["baseline_apply"] = ", j AS (SELECT doc_id, quality, doc_id % 400 - 182 AS days_left FROM labels), f AS (SELECT * FROM findings0 WHERE rule = 'noise-run') SELECT state, count(*) AS n FROM (SELECT CASE WHEN j.doc_id IS NULL THEN 'open' WHEN f.doc_id IS NULL THEN 'stale' WHEN j.days_left <= 0 THEN 'expired' WHEN j.quality = 0 THEN 'refused' ELSE 'suppressed' END AS state FROM f FULL OUTER JOIN j ON j.doc_id = f.doc_id) s GROUP BY state"
Q["witness_newest"] = ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM prog), k AS (SELECT user_id, count(DISTINCT verb) AS kinds FROM prog GROUP BY user_id) SELECT r.user_id, r.event_id, r.verb, k.kinds FROM r JOIN k ON k.user_id = r.user_id WHERE place = 1"
Q["asof_paragraph"] = ", s AS (SELECT user_id, ts, event_id, verb, value, max(CASE WHEN verb = 'signup' THEN concat(CAST(ts AS VARCHAR(40)), '|') END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS opened, sum(CASE WHEN verb = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS para FROM prog) SELECT user_id, CAST(para AS BIGINT) AS para, count(*) AS entered, round(sum(value), 2) AS total FROM s WHERE verb = 'click' GROUP BY user_id, para".replace("max(CASE WHEN verb = 'signup' THEN concat(CAST(ts AS VARCHAR(40)), '|') END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS opened, ", "")

# --- aggregations
Q["tally_rule"] = "SELECT rule, count(*) AS n FROM findings0 GROUP BY rule"
Q["tally_zero_fill"] = ", sevs AS (SELECT * FROM (VALUES ('info'), ('low'), ('med'), ('high'), ('crit')) AS t(sev)), f AS (SELECT m.sev FROM findings0 x JOIN rules_meta m ON m.rule = x.rule) SELECT sevs.sev, count(f.sev) AS n FROM sevs LEFT JOIN f ON f.sev = sevs.sev GROUP BY sevs.sev"
Q["report_summary"] = "SELECT m.evidence, m.sev, f.rule, count(*) AS n, count(DISTINCT f.path) AS files FROM findings0 f JOIN rules_meta m ON m.rule = f.rule GROUP BY m.evidence, m.sev, f.rule"
Q["entry_rollup"] = "SELECT entry, count(*) AS n FROM (SELECT concat('lang:', program) AS entry FROM findings0 UNION ALL SELECT concat('rule:', rule) FROM findings0) e GROUP BY entry"
Q["coverage_rollup"] = "SELECT source, bool_or(length(text) > 20000) AS incomplete, max(length(text)) AS longest, count(*) AS files FROM documents GROUP BY source"
Q["budget_coverage"] = "SELECT rule, count(*) AS found, CAST(least(count(*), 50) AS BIGINT) AS listed, count(*) > 50 AS cut FROM findings0 GROUP BY rule"
Q["sink_merge"] = ", k AS (SELECT l_suppkey, l_partkey, l_orderkey, l_extendedprice, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS place FROM lineitem) SELECT l_suppkey, l_partkey, max(CASE WHEN place = 1 THEN l_orderkey END) AS kept, min(l_linenumber) AS level, count(*) AS sources FROM k GROUP BY l_suppkey, l_partkey"
Q["argmin_group"] = ", k AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS place FROM lineitem) SELECT l_partkey, max(CASE WHEN place = 1 THEN l_orderkey END) AS kept, count(*) - 1 AS others FROM k GROUP BY l_partkey"
Q["top_n_more"] = ", k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) SELECT o_custkey, [[CASE WHEN place <= 8 THEN o_orderkey END]] AS first_orders, CAST(greatest(count(*) - 8, 0) AS BIGINT) AS more FROM k GROUP BY o_custkey"
Q["dataset_flow"] = "SELECT l_partkey, count(DISTINCT l_suppkey) AS steps, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS writers, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS readers FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1"
Q["reach_state"] = "SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'none' WHEN bool_or(o_orderstatus = 'O') THEN 'open' WHEN bool_and(o_orderstatus = 'F') THEN 'restricted' ELSE 'undeclared' END AS reach, coalesce(bool_or(o_totalprice > 200000), false) AS privileged FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
Q["merge_maps"] = "SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_nationkey UNION ALL SELECT c_nationkey, count(*) FROM customer WHERE c_custkey % 2 = 1 GROUP BY c_nationkey) m GROUP BY c_nationkey"
Q["last_wins"] = ", r AS (SELECT user_id, verb, event_id, value, row_number() OVER (PARTITION BY user_id, verb ORDER BY ts DESC, event_id DESC) AS place FROM prog) SELECT user_id, verb, event_id, value FROM r WHERE place = 1"
Q["precision_range"] = ", f AS (SELECT DISTINCT doc_id FROM findings0 WHERE rule = 'noise-run'), j AS (SELECT CASE WHEN l.quality = 0 THEN 'right' WHEN l.quality = 1 THEN 'wrong' ELSE 'unknown' END AS truth FROM f LEFT JOIN labels l ON l.doc_id = f.doc_id), c AS (SELECT sum(CASE WHEN truth = 'right' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN truth = 'wrong' THEN 1 ELSE 0 END) AS w, sum(CASE WHEN truth = 'unknown' THEN 1 ELSE 0 END) AS u FROM j) SELECT CAST(r AS BIGINT) AS n_right, CAST(w AS BIGINT) AS n_wrong, CAST(u AS BIGINT) AS n_unknown, round(CAST(r AS DOUBLE) / nullif(r + w + u, 0), 6) AS low, round(CAST(r + u AS DOUBLE) / nullif(r + w + u, 0), 6) AS high FROM c"
Q["bench_match"] = ", e AS (SELECT lang AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents WHERE n_chars > 2000), g AS (SELECT program AS k, row_number() OVER (PARTITION BY program ORDER BY path, line, rule) AS nth FROM findings0) SELECT coalesce(e.k, g.k) AS k, CAST(sum(CASE WHEN e.nth IS NOT NULL AND g.nth IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN g.nth IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missed, CAST(sum(CASE WHEN e.nth IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra FROM e FULL OUTER JOIN g ON e.k = g.k AND e.nth = g.nth GROUP BY coalesce(e.k, g.k)"
Q["advice_grouping_sets"] = "SELECT m.sev, f.program, f.rule, count(*) AS n FROM findings0 f JOIN rules_meta m ON m.rule = f.rule GROUP BY GROUPING SETS ((m.sev), (f.program), (f.rule), ())"
Q["fingerprint_shared"] = "SELECT count(*) AS findings, count(DISTINCT fp) AS identities, count(*) - count(DISTINCT fp) AS shared FROM (SELECT SHA(concat(rule, chr(0), program, chr(0), lower(trim(text)))) AS fp FROM findings0) x"
Q["constants_reaching"] = "SELECT a.src, count(DISTINCT b.dst) AS constants, min(b.dst) AS low, max(b.dst) AS high FROM graph a JOIN graph b ON b.src = a.dst GROUP BY a.src"
Q["interval_arith"] = ", b AS (SELECT l_suppkey, min(l_extendedprice) AS a, max(l_extendedprice) AS z, min(1 - l_discount) AS c, max(1 - l_discount) AS d FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(least(a * c, a * d, z * c, z * d), 4) AS lo, round(greatest(a * c, a * d, z * c, z * d), 4) AS hi FROM b"

# --- windows and sequences
_G = ", s AS (SELECT doc_id, line_no, line, sum(CASE WHEN RX(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM lines) "
Q["fold_statements"] = _G + "SELECT doc_id, CAST(grp AS BIGINT) AS statement, min(line_no) AS first_line, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY doc_id, grp"
Q["running_group"] = _G + "SELECT doc_id, CAST(max(grp) AS BIGINT) AS groups, count(*) AS n_lines FROM s GROUP BY doc_id"
Q["scope_forward_fill"] = "SELECT user_id, event_id, max(CASE WHEN verb = 'signup' THEN event_id END) OVER (PARTITION BY user_id, scope) AS scope_start FROM (SELECT *, sum(CASE WHEN verb = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scope FROM prog) p"
Q["consecutive_runs"] = ", q AS (SELECT doc_id, line_no, line, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines WHERE length(line) BETWEEN 40 AND 120) SELECT doc_id, min(line_no) AS first_line, count(*) AS n, count(DISTINCT line) AS kinds FROM q GROUP BY doc_id, island HAVING count(*) >= 4 AND count(DISTINCT line) >= 3"
Q["adjacent_pair"] = ", n AS (SELECT user_id, event_id, verb, lead(verb) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_id FROM prog) SELECT user_id, event_id, after_id FROM n WHERE verb = 'error' AND after = 'view'"
Q["untested_before_reuse"] = ", n AS (SELECT user_id, event_id, verb, lead(verb) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_id FROM prog WHERE verb IN ('error', 'view', 'click')) SELECT user_id, event_id AS setter, after_id AS reader FROM n WHERE verb = 'error' AND after = 'click'"
Q["layout_offsets"] = ", s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(ceil(l_quantity / 8) * 8 AS BIGINT) AS size FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, size, CAST(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS off FROM s"
Q["null_propagating_sum"] = ", s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS unknown, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS total FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN unknown > 0 THEN NULL ELSE total END AS at FROM s"
Q["canonical_order"] = "SELECT row_number() OVER (ORDER BY rule, path, line) AS place, rule, path, line FROM findings0"
Q["advice_order"] = "SELECT row_number() OVER (ORDER BY CASE m.sev WHEN 'crit' THEN 0 WHEN 'high' THEN 1 WHEN 'med' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, f.rule, f.path, f.line) AS place, m.sev, f.rule, f.path, f.line FROM findings0 f JOIN rules_meta m ON m.rule = f.rule"
Q["hash_chain_verify"] = ", c AS (SELECT conv_id, turn, SHA(text) AS digest, lag(SHA(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM conversations) SELECT conv_id, count(*) AS records, max(SHA(concat(coalesce(prev, ''), digest))) AS last_link, bool_and(prev IS NOT NULL OR turn = 0) AS whole FROM c GROUP BY conv_id"
Q["sarif_artifact_index"] = ", p AS (SELECT DISTINCT path FROM findings0), r AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS artifact FROM p) SELECT f.rule, f.path, f.line, r.artifact FROM findings0 f JOIN r ON r.path = f.path"
Q["explain_lines"] = "SELECT f.rule, f.path, f.line AS finding_line, l.line_no, l.line AS text FROM findings0 f JOIN lines l ON l.doc_id = f.doc_id AND l.line_no BETWEEN f.line - 2 AND f.line + 2"
Q["trace_elide"] = ", n AS (SELECT doc_id, line_no, line, count(*) OVER (PARTITION BY doc_id) AS total FROM lines) SELECT doc_id, line_no, CASE WHEN total > 10 AND line_no = 4 THEN '...' ELSE line END AS line FROM n WHERE total <= 10 OR line_no <= 4 OR line_no > total - 3"

# --- sets, verdicts, identity
Q["multiset_diff"] = "SELECT l_returnflag, l_linestatus, count(*) AS extra FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE year(l_shipdate) = 1995 EXCEPT ALL SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE year(l_shipdate) = 1996) d GROUP BY l_returnflag, l_linestatus"
Q["set_diff_targets"] = "SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE year(o_orderdate) < 1996"
Q["layout_change"] = ", b AS (SELECT l_suppkey, max(l_quantity) AS size, count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY l_suppkey), h AS (SELECT l_suppkey, max(l_quantity) AS size, count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY l_suppkey) SELECT coalesce(b.l_suppkey, h.l_suppkey) AS item, CASE WHEN b.l_suppkey IS NULL THEN 'added' WHEN h.l_suppkey IS NULL THEN 'removed' WHEN b.size <> h.size THEN 'size' WHEN b.n <> h.n THEN 'place' ELSE 'same' END AS change FROM b FULL OUTER JOIN h ON h.l_suppkey = b.l_suppkey"
Q["union_findings"] = "SELECT f.rule, f.path, f.line, f.program, 'text' AS origin FROM findings0 f UNION ALL SELECT 'script-in-page', concat('page/', CAST(page_id AS VARCHAR(20))), 1, 'html', 'page' FROM pages WHERE RX(lower(html), '<script')"
Q["verdict_case"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'needs-source' WHEN o_totalprice < 20000 THEN 'refuted' WHEN o_orderpriority LIKE '1%' THEN 'reproduced' WHEN o_orderpriority LIKE '2%' AND o_orderstatus = 'O' THEN 'reachable' WHEN o_orderstatus = 'F' THEN 'guarded' ELSE 'undetermined' END AS verdict FROM orders"
Q["check_credit"] = "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.02 AND l_tax <= 0.04 THEN 2 WHEN l_discount <= 0.05 OR l_quantity BETWEEN 1 AND 10 THEN 1 ELSE 0 END AS level FROM lineitem"
Q["fix_location"] = ", r AS (SELECT l_orderkey, l_linenumber, l_shipmode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS back FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'built' ELSE 'moved' END AS l_shipmode FROM lineitem) x) SELECT l_orderkey, coalesce(max(CASE WHEN l_shipmode = 'built' THEN l_linenumber END), max(l_linenumber)) AS fix_at FROM r GROUP BY l_orderkey"
Q["policy_gate"] = "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN f.rule = 'license-line' THEN 'warn' WHEN m.evidence = 'coverage' THEN 'unmeasured' WHEN f.rule = 'literal-token' THEN 'always' WHEN m.sev IN ('crit', 'high') THEN 'tier' WHEN m.evidence = 'tampering' THEN 'class' ELSE 'pass' END AS outcome FROM findings0 f JOIN rules_meta m ON m.rule = f.rule) g GROUP BY outcome"
Q["policy_merge"] = ", f AS (SELECT * FROM (VALUES ('block', 3), ('waive', 1), ('cover', 2)) AS t(k, rank)), r AS (SELECT * FROM (VALUES ('block', 2), ('waive', 2), ('extra', 1)) AS t(k, rank)) SELECT coalesce(f.k, r.k) AS k, greatest(coalesce(f.rank, 0), coalesce(r.rank, 0)) AS rank, CASE WHEN coalesce(f.rank, 0) >= coalesce(r.rank, 0) THEN 'floor' ELSE 'repository' END AS origin FROM f FULL OUTER JOIN r ON r.k = f.k"
Q["patch_outcome"] = ", b AS (SELECT o_custkey, max(o_orderstatus) AS s, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY o_custkey), h AS (SELECT o_custkey, max(o_orderstatus) AS s, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY o_custkey) SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN h.o_custkey IS NULL THEN 'source-removed' WHEN b.s = h.s AND b.n = h.n THEN 'still-reported' WHEN b.s = h.s THEN 'lowered-by-check' WHEN h.n = 1 THEN 'cleared-by-check' ELSE 'no-longer-fires' END AS outcome FROM b LEFT JOIN h ON h.o_custkey = b.o_custkey) o GROUP BY outcome"
Q["fingerprint"] = "SELECT rule, path, line, substring(SHA(concat('1', chr(0), rule, chr(0), program, chr(0), lower(trim(text)))), 1, 32) AS fingerprint FROM findings0"
Q["canonical_hash"] = "SELECT c_nationkey, SHA([[concat(c_mktsegment, '=', CAST(n AS VARCHAR(20)))]]) AS digest FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) m GROUP BY c_nationkey"
Q["sbom_edges"] = "SELECT DISTINCT source, regexp_extract(line, '@([A-Za-z0-9.-]+)', 1) AS host FROM lines WHERE RX(line, '@[A-Za-z0-9.-]+')"
Q["scan_findings"] = "SELECT f.rule, f.path, f.line, f.program, m.sev, m.evidence, m.cwe, substring(SHA(concat('1', chr(0), f.rule, chr(0), f.program, chr(0), lower(trim(f.text)))), 1, 32) AS fingerprint, count(*) OVER (PARTITION BY f.rule, f.text) AS sources FROM findings0 f LEFT JOIN rules_meta m ON m.rule = f.rule"
Q["graph_edges"] = "SELECT src, count(*) AS out_degree, min(dst) AS low, max(dst) AS high FROM graph GROUP BY src"
