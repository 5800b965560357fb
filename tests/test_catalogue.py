"""Queries against DuckDB's SQL on the smallest tables; the entry module with and without its optional parts."""

import os
import subprocess
import sys

import duckdb
import pytest

from weftgraph.plans.catalogue import ORACLE_SQL, QUERIES

SOME = ["edge_dedup", "node_renumber", "kernel_row_index", "wl_counts_doc", "wl_prob", "sp_counts", "sp_counts_compat", "graphlet4_counts", "graphlet_star_compat", "random_walk_counts", "anon_walk_counts_edges_nodes", "vocab_window", "negative_slots", "negative_draws", "cbow_examples", "pvdm_loss", "mle_kernel", "precision_recall_f1"]


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, data)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert a == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_every_query_has_a_name_and_sql_refers_to_one():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; assert 'mle_kernel' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); e.oracle_sql()"
    subprocess.run(["cp", "-r", f"{root}/weftgraph", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/weftgraph/llm"], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
