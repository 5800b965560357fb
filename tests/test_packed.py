"""Small graphs whole against the relational forms, and how much the plans shuffle."""

import pytest

from weftgraph.operators import packed
from weftgraph.operators.graphlet import graphlet_corpus
from weftgraph.operators.shortest_path import sp_corpus
from weftgraph.operators.walks import awe_corpus, rw_corpus
from weftgraph.operators.wl import wl_docs, wl_graph_counts, wl_states
from weftgraph.plans.catalogue import QUERIES
from weftgraph.sources.derive import customer_suppliers, user_events


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def exchanges(df):
    """Shuffles of the plan as it was written, before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


@pytest.fixture(scope="module")
def odd(spark):
    """Six graphs: plain, one with an edge twice, one with an unknown end, one with a broken weight, one without edges, one with a loop and no labels."""
    nodes = [(1, 5, "B"), (1, 2, "A"), (1, 9, None), (2, 1, "A"), (2, 2, "B"), (2, 3, "é"), (3, 1, "A"), (3, 2, "B"), (4, 1, "A"), (4, 2, "B"), (4, 3, "A"), (5, 1, "A"), (5, 2, "A"), (6, 1, None), (6, 2, None)]
    edges = [(1, 2, 5, 3.0), (1, 5, 9, None), (1, 9, 2, 2.0), (2, 1, 2, 1.0), (2, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 1, 2, 1.0), (3, 2, 7, 1.0), (4, 1, 2, 0.3), (4, 2, 3, 0.6), (6, 1, 1, 1.0), (6, 1, 2, 4.0)]
    return spark.createDataFrame(nodes, "graph_id long, node_id int, label string"), spark.createDataFrame(edges, "graph_id long, src int, dst int, weight double")


CASES = {
    "wl": lambda n, e: [wl_docs(wl_states(n, e, 1)), wl_graph_counts(n, e, 2)],
    "rw": lambda n, e: [rw_corpus(n, e, 3, 3, 5).docs],
    "graphlets": lambda n, e: [graphlet_corpus(n, e, 3, 2, 4).docs, graphlet_corpus(n, e, 3, 2, 4).counts],
    "stars": lambda n, e: [graphlet_corpus(n, e, 3, 2, 4, True).counts],
    "awe": lambda n, e: [awe_corpus(n, e, 3, None, 2, 2).docs, awe_corpus(n, e, 3, "edges_nodes", 2, 2).counts],
}


@pytest.mark.parametrize("name", CASES)
def test_whole_graphs_as_the_relational_form(spark, odd, monkeypatch, name):
    monkeypatch.setattr(packed, "MAX_ROWS", 0)
    want = [rows(x) for x in CASES[name](*odd)]
    monkeypatch.setattr(packed, "MAX_ROWS", 1 << 18)
    assert [rows(x) for x in CASES[name](*odd)] == want


@pytest.mark.parametrize("compat", [False, True])
def test_paths_of_whole_graphs_as_by_levels(odd, compat):
    plain = [x.where("graph_id in (1, 4, 5, 6)") for x in odd]
    got, want = sp_corpus(*plain, compat), sp_corpus(*plain, compat, dense_nodes=0)
    assert rows(got.counts) == rows(want.counts) and rows(got.docs) == rows(want.docs)


def test_graphs_are_put_together_from_blocks_of_any_size():
    import pyarrow as pa

    table = pa.table({"graph_id": pa.array([1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5], pa.int64())})
    for size in (1, 2, 3, 11):
        for at_least in (1, 2, 4, 100):
            got = [t["graph_id"].to_pylist() for t, _ in packed._whole(iter(table.to_batches(size)), at_least, 100)]
            assert sum(got, []) == table["graph_id"].to_pylist() and all(a[-1] < b[0] for a, b in zip(got, got[1:]))
        cut = list(packed._whole(iter(table.to_batches(size)), 2, 3))
        kept = [x for t, _ in cut if t is not None for x in t["graph_id"].to_pylist()]
        assert [x for x in kept if x != 3] == [1, 1, 2, 4, 5, 5] and (3 in [g for _, g in cut] or 3 in kept)


def test_graphs_that_are_too_large_or_odd_are_left_to_the_relational_form(odd):
    made = packed.pack(*odd, max_rows=5)
    assert {r.graph_id for r in made.nodes.select("graph_id").distinct().collect()} == {1, 2, 3, 4}
    assert packed.pack(*(x.where("graph_id in (1, 5, 6)") for x in odd)).nodes is None


@pytest.mark.parametrize("name", ["sp_counts", "sp_docs", "sp_counts_compat", "graphlet3_counts", "graphlet_star_compat", "graphlet_docs", "wl_counts_doc", "wl_counts_centre", "wl_labels", "wl_docs", "random_walk_counts", "random_walk_docs", "anon_walk_counts_none", "anon_walk_counts_nodes", "anon_walk_counts_edges", "anon_walk_counts_edges_nodes"])
def test_nothing_is_shuffled_after_the_graphs_are_packed(spark, data, name):
    assert exchanges(QUERIES[name](spark, data)) == 0


def test_datasets_are_shuffled_by_graph_once(spark, data):
    g = customer_suppliers(spark, data)
    # Orders and lines by order, the served rows by graph; the labels' join adds one at most where it is not a broadcast.
    assert exchanges(g.edges) <= 3 and exchanges(g.nodes) <= 4
    g = user_events(spark, data)
    assert exchanges(g.edges) == 1 and exchanges(g.nodes) == 1


def test_orders_of_two_customers_count_for_both(spark, tmp_path):
    spark.createDataFrame([(1, 7), (1, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3), (1, 4), (1, 4)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3, 0), (4, 0)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 2)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(7, "A")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert rows(customer_suppliers(spark, str(tmp_path)).edges) == ["(7, 1, 2, 2.0)", "(8, 1, 2, 2.0)"]
