"""Decompositions on hand-computed graphs, and invariances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import graphlet as G
from weftgraph.operators import shortest_path as S
from weftgraph.operators import walks as W
from weftgraph.operators import wl as L


def counts(df, graph):
    return {r["pattern"]: r["cnt"] for r in df.where(F.col("graph_id") == graph).collect()}


def test_wl_counts_and_classes(f1):
    states = L.wl_states(*f1, 1)
    zero = counts(L.wl_counts(states.where("it = 0")), 1)
    assert zero == {"0+A": 5, "0+B": 6}
    assert counts(L.wl_counts(states.where("it = 0"), "centre"), 1) == {"0+A": 2, "0+B": 2}
    one = states.where("it = 1 and graph_id = 1").select("node_id", "label").collect()
    labels = {r["node_id"]: r["label"] for r in one}
    assert labels[1] == labels[2] and len(set(labels.values())) == 3
    assert states.where("it = 1 and graph_id < 3").select("label").distinct().count() == 5


def test_wl_isolated_and_unlabelled(spark, f1):
    docs = L.wl_docs(L.wl_states(*f1, 0)).where("graph_id = 3").collect()
    assert ["0+C"] in [list(r["tokens"]) for r in docs]
    nodes = f1[0].withColumn("label", F.lit(None).cast("string"))
    assert counts(L.wl_counts(L.wl_states(nodes, f1[1], 0), "centre"), 2) == {"0+0": 2}


def test_wl_dense_numbers(f1):
    rows = L.wl_dense_labels(L.wl_states(*f1, 1)).orderBy("it", "label").collect()
    zero = [r["pattern"] for r in rows if r["it"] == 0]
    assert zero == ["0+0", "0+1", "0+2"]
    assert [r["pattern"] for r in rows if r["it"] == 1][0] == "1+0"


def test_wl_is_invariant_under_renumbering(spark, f1):
    nodes, edges = f1
    turn = F.col("node_id") * -1 + 5
    moved = nodes.withColumn("node_id", turn.cast("int"))
    flipped = edges.select("graph_id", (5 - F.col("src")).cast("int").alias("src"), (5 - F.col("dst")).cast("int").alias("dst"), "weight")
    a = L.wl_counts(L.wl_states(nodes, edges, 2)).collect()
    b = L.wl_counts(L.wl_states(moved, flipped, 2)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("dense", [2048, 0])
def test_shortest_paths(f1, dense):
    made = S.sp_corpus(*f1, dense_nodes=dense)
    assert counts(made.counts, 1) == {"A_A_0": 2, "B_B_0": 2, "A_A_1": 2, "A_B_1": 4, "B_B_1": 2, "A_B_2": 4}
    assert counts(made.counts, 2) == {"A_A_0": 1, "B_B_0": 1, "A_B_1": 2}
    assert counts(made.counts, 3)["C_C_0"] == 1
    assert abs(made.prob.where("graph_id = 1").agg(F.sum("prob")).first()[0] - 1) < 1e-9


def test_shortest_path_string_lookup(spark):
    nodes = spark.createDataFrame([(1, i, str(i)) for i in range(1, 13)], "graph_id long, node_id int, label string")
    moved = {r["node_id"]: r["label"] for r in S.shifted_labels(nodes).collect()}
    assert moved[2] == "10" and moved[1] == "1" and len(set(moved.values())) == 12


def test_graphlet_numbers():
    assert [G.base(n) for n in range(1, 8)] == [1, 2, 4, 8, 19, 53, 209]
    assert [len(G.canonical_masks(n)) for n in range(1, 7)] == [1, 2, 4, 11, 34, 156]
    assert G.graphlet_numbers([0b111, 0b110, 0b100, 0], 3) == ["7", "6", "5", "4"]
    # Degree sequence 3221: a triangle with a tail.
    assert G.graphlet_numbers([0b110101], 4) == ["15"]
    assert [G.star_number(k, 4) for k in range(4)] == ["8", "9", "10", "12"]


def test_graphlet_corpus(f1):
    made = G.graphlet_corpus(*f1, 4, 6, 3)
    main = {r["tokens"][0] for r in made.docs.where("graph_id = 1").collect()}
    assert main == {"15"}
    assert counts(G.graphlet_corpus(*f1, 3, 6, 3).counts, 2) == {"4": 6}
    assert set(counts(G.graphlet_corpus(*f1, 3, 40, 3).counts, 1)) >= {"5", "6", "7"}


def test_transitions(f1):
    p = {(r["src"], r["dst"]): r["p"] for r in W.transitions(f1[1]).where("graph_id = 1").collect()}
    assert p[1, 2] == p[2, 3] == 0.5 and p[4, 3] == 1.0 and abs(p[3, 4] - 1 / 3) < 1e-12 and len(p) == 8


def test_walks_follow_edges(f1):
    nodes, edges = f1
    allowed = {(r["graph_id"], a, b) for r in edges.collect() for a, b in ((r["src"], r["dst"]), (r["dst"], r["src"]))}
    rows = W.walk(nodes, edges, 3, 4, 1).collect()
    assert {(r["graph_id"], r["start"]) for r in rows} == {(g, s) for g, s, _ in allowed}
    for r in rows:
        assert len(r["path"]) == 4 and all((r["graph_id"], a, b) in allowed for a, b in zip(r["path"], r["path"][1:], strict=False))


@pytest.mark.parametrize("setting", [None, "nodes", "edges", "edges_nodes"])
def test_anonymous_walks_are_in_the_enumeration(spark, f1, setting):
    made = W.awe_corpus(*f1, 3, setting, 5, 2)
    known = {r["pattern"] for r in W.enumerate_walks(spark, 3, setting).collect()}
    assert {r["pattern"] for r in made.counts.collect()} <= known


def test_enumeration_sizes(spark):
    assert [W.enumerate_walks(spark, n).count() for n in (2, 4, 8)] == [2, 15, 4140]
    assert [W.enumerate_walks(spark, n, "nodes").count() for n in (2, 4)] == [5, 52]
    assert [tuple(r) for r in W.enumerate_walks(spark, 2).collect()] == [(0, "0_1_0"), (1, "0_1_2")]


def test_canonical_is_the_smallest():
    rng = np.random.default_rng(0)
    masks = rng.integers(0, 1 << 10, 50)
    assert (G.canonical(masks, 5) <= masks).all()
    assert (G.canonical(G.canonical(masks, 5), 5) == G.canonical(masks, 5)).all()
