"""Work that must not grow with the product of its inputs."""

from __future__ import annotations

from loomstead import catalogue
from loomstead.operators import contexts as C
from loomstead.operators import graph as G
from loomstead.operators import joins as J
from tests.oracle import connect, differs


def held(monkeypatch, run):
    """(rows of the result, most rows that were kept on the way)."""
    most = [0]

    def counted(df, hold=G.hold):
        out = hold(df)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(G, "hold", counted)
    return run().count(), most[0]


def calls(spark, starts, others=0):
    body = [(n, (n + 1) % 4, kind, site) for n in range(4) for kind, site in (("call", 0), ("call", 1), ("return", 0), ("plain", 0))]
    edges = [(100 + s, 0, "plain", 0) for s in range(starts)] + [(9000 + s, 0, "call", 0) for s in range(others)]
    return spark.createDataFrame(body + edges, "src long, dst long, kind string, site long"), spark.range(100, 100 + starts).withColumnRenamed("id", "node")


def test_states_are_kept_once_for_many_starts(spark, monkeypatch):
    rows, most = held(monkeypatch, lambda: C.context_reach(*calls(spark, 40), depth=3))
    assert rows == 40 * (1 + 4 * 15) and most < 200


def test_calls_out_of_reach_are_not_kept(spark, monkeypatch):
    rows, most = held(monkeypatch, lambda: C.summary_reach(*calls(spark, 5, others=300)))
    assert rows == 5 * 5 and most < 100


def test_packed_starts_come_back(spark):
    starts = spark.range(0, 1300).selectExpr("if(id = 7, null, id) as node")
    packed = G.Packed(starts)
    rows = starts.selectExpr("node as start", "coalesce(node, 7) % 3 as k").unionByName(starts.selectExpr("node as start", "9L as k"))
    tight = packed.pack(rows, ["k"])
    assert tight.count() == 12 and sorted(map(tuple, packed.unpack(tight, ["k"]).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def nearest(spark, tmp_path):
    tables = {
        "nation": ([(1, 1), (2, 1), (3, 2), (4, None), (5, 3), (6, 3), (6, 3)], "n_nationkey long, n_regionkey long"),
        "customer": ([(k, 1 + k % 7) for k in range(60)] + [(3, 1), (4, 2), (None, 2), (None, 5), (70, None), (8, 2), (8, 2)], "c_custkey long, c_nationkey long"),
        "supplier": ([(k, (1, 1, 3, 4, 6, None, 9)[k % 7]) for k in range(35)] + [(3, 1)], "s_suppkey long, s_nationkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).toPandas().astype("Int64").to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_nearest_match_of_odd_rows(spark, tmp_path, monkeypatch):
    import os

    from loomstead.sources.tables import TABLES

    monkeypatch.setattr(J, "GROUP_ROWS", 3)
    folder = nearest(spark, tmp_path)
    for t in TABLES:
        if not os.path.exists(f"{folder}/{t}.parquet"):
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{folder}/{t}.parquet")
    found = catalogue.queries()["nearest_match_join"](spark, folder)
    assert differs(found, connect(folder), catalogue.oracle_sql()["nearest_match_join"]) == ""
    # Ranking all pairs of a region would need a sort of them; only ids of customers are ranked here.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "s_suppkey" not in "".join(x for x in plan.split("\n") if "Window" in x)
