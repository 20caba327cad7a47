"""Graph queries over the whole of lineitem, on a long chain against brute force and DuckDB."""

from __future__ import annotations

import os

import pytest

from loomstead import catalogue
from loomstead.sources.tables import TABLES
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"
#: (src, dst, line number, order key): a chain of 35 edges from node 20, with side ways, and no order key divisible by 300.
ROWS = [(20 + i, 21 + i, 3, 301 + i) for i in range(35)] + [(20, 30, 1, 1), (30, 22, 2, 6), (45, 20, 1, 2), (72, 73, 3, 4), (33, 70, 1, 13), (70, 34, 2, 13)]
QUERIES = ("reverse_reach", "entry_reach", "dead_nodes", "shortest_trace", "all_routes", "refusal_walk", "taint_walk", "must_bit_and", "constants_reaching", "graph_edges", "context_reach", "summary_reach")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("graph")
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{SF}/{t}.parquet", d / f"{t}.parquet")
    items = spark.createDataFrame([(o, (dst - 1) % 100, src, line) for src, dst, line, o in ROWS], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    items.toPandas().to_parquet(d / "lineitem.parquet")
    return str(d)


def closure(first, step):
    seen, frontier, level = {s: 0 for s in first}, set(first), 0
    while frontier:
        level += 1
        frontier = {n for s in frontier for n in step(s)} - seen.keys()
        seen |= dict.fromkeys(frontier, level)
    return seen


def brute(name):
    edges = {(s, d) for s, d, _, _ in ROWS}
    starts = {s for s, _ in edges if s % 20 == 0}
    if name == "shortest_trace":
        return {(*k, n) for k, n in closure({(s, s) for s in starts}, lambda k: [(k[0], d) for s, d in edges if s == k[1]]).items()}
    if name == "taint_walk":
        clip = lambda k: [(d, max(k[1], d % 8), min(k[2], s % 8 + 8)) for s, d in edges if s == k[0]]
        return set(closure({(s, 0, 16) for s in starts}, lambda k: [x for x in clip(k) if x[1] < x[2]]))
    if name == "context_reach":
        calls = {(s, d, ("plain", "call", "return")[line % 3], o % 5) for s, d, line, o in ROWS}

        def hop(k):
            for s, d, kind, site in calls:
                if s == k[1] and (kind != "return" or not k[2] or k[2][-1] == site):
                    yield k[0], d, {"plain": k[2], "call": (*k[2], site)[-4:], "return": k[2][:-1]}[kind]

        return {(a, b, ",".join(map(str, c)), n) for (a, b, c), n in closure({(s, s, ()) for s in starts}, hop).items()}
    bits = {n: 255 for e in edges for n in e}
    while True:
        new = dict.fromkeys(bits, 0)
        for n in bits:
            met = [bits[s] & ~(1 << s % 8) | 1 << d % 8 for s, d in edges if d == n]
            for k, m in enumerate(met):
                new[n] = m if k == 0 else new[n] & m
        if new == bits:
            return set(bits.items())
        bits = new


@pytest.mark.parametrize("name", QUERIES)
def test_whole_graph_agrees_with_duckdb(spark, folder, name):
    assert differs(catalogue.queries()[name](spark, folder), connect(folder), catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["shortest_trace", "taint_walk", "context_reach", "must_bit_and"])
def test_walks_end_at_their_fixpoint(spark, folder, name):
    got = [tuple(r) for r in catalogue.queries()[name](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(name)


def test_every_edge_is_there(spark, folder):
    rows = {r["src"]: r["out_degree"] for r in catalogue.queries()["graph_edges"](spark, folder).collect()}
    assert sum(rows.values()) == len({r[:2] for r in ROWS}) and rows[20] == 2
