"""Queries without SQL against brute force on a small fixture."""

import pandas as pd

import __spark_entry__ as entry


def fixture(tmp_path):
    orders = [(1, 1, "1997-01-02"), (2, 2, "1995-05-05"), (3, 3, "1998-03-03"), (4, 1, "1996-06-06")]
    lines = [(1, 1, "1998-01-05"), (2, 2, "1995-06-01"), (3, 2, "1998-04-01"), (3, 4, "1998-04-01"), (4, 3, "1996-07-01")]
    pd.DataFrame([(k, c, pd.Timestamp(t)) for k, c, t in orders], columns=["o_orderkey", "o_custkey", "o_orderdate"]).astype({"o_orderdate": "datetime64[us]"}).to_parquet(f"{tmp_path}/orders.parquet")
    pd.DataFrame([(o, p, pd.Timestamp(t)) for o, p, t in lines], columns=["l_orderkey", "l_partkey", "l_shipdate"]).astype({"l_shipdate": "datetime64[us]"}).to_parquet(f"{tmp_path}/lineitem.parquet")
    pd.DataFrame([(p, f"part {p}") for p in range(1, 7)], columns=["p_partkey", "p_name"]).to_parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_components_and_dead_nodes(spark, tmp_path):
    d, q = fixture(tmp_path), entry.queries()
    got = {tuple(r) for r in q["weak_components"](spark, d).collect()}
    assert got == {(x, "customer:1") for x in ("customer:1", "part:1", "part:3")} | {(x, "customer:2") for x in ("customer:2", "customer:3", "part:2", "part:4")}
    assert [tuple(r) for r in q["connectivity_communities"](spark, d).collect()] == [("customer:2", 4), ("customer:1", 3)]
    assert {r["p_partkey"] for r in q["dead_nodes"](spark, d).collect()} == {5, 6}
