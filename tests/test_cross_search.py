"""Linked searches for tables of queries against plain ones, in blocks, with filters of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import vectors as V

SCHEMA = "vec_id long, collection string, link string, machine string, embedding array<double>"


def data():
    rng = np.random.default_rng(8)
    names = ["a", "b", "c", "other"]
    rows = [(i, names[i % 4], None if i % 11 == 0 else f"k{i % 7}", [None, "m1", "m2"][i % 3], rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]
    queries = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), [None, "m1", "fehlt"][i % 3]) for i in range(23)]
    return rows, queries


def by_hand(rows, queries, k=3):
    def score(v, q):
        n = np.linalg.norm(v) * np.linalg.norm(q)
        return round(float(np.dot(v, q) / n), 6) if n else 0.0

    out = {}
    for qid, q, machine in queries:
        hits = sorted((-score(r[4], q), r[0], r[2]) for r in rows if r[1] == "a" and (machine is None or r[3] == machine))[:k]
        for rank, (s, i, key) in enumerate(hits, 1):
            best = []
            for c in ("b", "c"):
                found = sorted((-score(r[4], q), r[0]) for r in rows if r[1] == c and r[2] == key and key is not None)
                best += [found[0][1], -found[0][0]] if found else [None, None]
            out[qid, rank] = (i, -s, *best)
    return out


@pytest.mark.parametrize("block", [1000, 5])
def test_cross_search(spark, monkeypatch, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    rows, queries = data()
    p = spark.createDataFrame(rows, SCHEMA).repartition(5)
    q = spark.createDataFrame(queries, "query_id long, qv array<double>, wanted string")
    got = {(r.query_id, r.rank): (r.primary_id, r.primary_score, r.b_id, r.b_score, r.c_id, r.c_score) for r in V.cross_search_batch(p, q, "a", ["b", "c"], "link", 3, match=("machine", "wanted")).collect()}
    want = by_hand(rows, queries)
    assert set(got) == set(want) and {q for q, _ in want} == {i for i, _, m in queries if m != "fehlt"}
    for k, v in want.items():
        assert got[k][0::2] == v[0::2] and np.allclose(*(np.array([x[i] or 0 for i in (1, 3, 5)], float) for x in (got[k], v)), atol=2e-6)
    assert V.cross_search_batch(p, q.where("false"), "a", ["b"], "link").count() == 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rows, queries = data()
    p, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, "query_id long, qv array<double>, wanted string")
    both = []
    for block in (1000, 4):
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        both.append(sorted(map(tuple, V.top_k_batch(p, q, 3, "query_id", "qv", per=["collection"], match=("machine", "wanted")).collect())))
    assert both[0] == both[1] and both[0]


def test_cnc_observations(spark):
    p = spark.createDataFrame(
        [("s1", V.CNC_STEPS, [1.0, 0.0], "x", "R1", "Bohren", 800, "t"), ("s2", V.CNC_STEPS, [0.9, 0.1], "y", "R2", None, None, "t"), ("r1", "gw_ruest_data", [1.0, 0.0], "x", None, None, None, "Spanner " * 20), ("m1", "gw_material_info", [0.0, 1.0], "x", None, None, None, "Stahl")],
        "collection2 string, collection string, vector array<double>, cnc_step_id string, ruest_map_id string, operation_type string, cutting_speed int, text string",
    ).withColumn("point_id", F.xxhash64("collection2"))
    asked = spark.createDataFrame([(1, "R1", ""), (2, "", "Fräser"), (3, "R9", None), (4, None, None)], "query_id long, ruest_id string, missing_tool string")
    got = {r.query_id: r.observation for r in V.cnc_observations(p, asked, lambda c: F.array(F.lit(1.0), F.lit(0.0))).collect()}
    first = "[1] Op: Bohren, Speed: 800 | Rüst: " + ("Spanner " * 20)[:80] + " | Material: Stahl"
    assert got[1] == "Gefunden: 1 ähnliche CNC-Schritte\n" + first
    assert got[2] == got[4] == "Gefunden: 2 ähnliche CNC-Schritte\n" + first + "\n[2] Op: ?, Speed: ?"
    assert got[3] == V.CNC_NONE
