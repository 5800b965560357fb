"""What grew faster than its input: the same results by both forms, no shuffle where none is needed, no error beyond a count."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import corpus as C
from weftgraph.operators import evaluate as E
from weftgraph.operators import kernels as K
from weftgraph.operators import objectives as O
from weftgraph.operators import trainer
from weftgraph.operators.relational import valid_edges
from weftgraph.plans import pipelines as P


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange")


def test_valid_edges_broadcasts_no_nodes(spark):
    raw = spark.createDataFrame([(1, 2), (2, 3), (3, 9)], "x long, y long")
    members = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "node long, graph_id long")
    got = valid_edges(raw, members)
    assert rows(got) == ["(7, 1, 2)"] and "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    vocab = spark.createDataFrame([(0, 0, 10), (1, 10, 10), (2, 10, 60), (3, 60, 100)], "pattern_id long, neg_lo long, neg_hi long")
    examples = spark.createDataFrame([(g, i, (g + i) % 5, g % 4, [(i + k) % 4 for k in range(3)]) for g in range(6) for i in range(9)], "graph_id long, line_no int, target long, graph long, contexts array<long>")
    return vocab, examples.withColumn("context", F.col("target") % 4)


def test_negatives_are_those_of_the_join_and_shuffle_nothing(small, monkeypatch):
    vocab, examples = small
    keys = ["graph_id", "line_no"]
    got = C.with_negatives(examples, vocab, keys, "target", 6, 3)
    assert exchanges(got) == 0
    monkeypatch.setattr(C, "MAX_SLOTS", 1)
    assert rows(got.select(*keys, "negatives")) == rows(C.negatives(examples, vocab, keys, "target", 6, 3))
    only = vocab.where("pattern_id = 0")
    assert C.with_negatives(examples, only, keys, "target").where("target = 0").isEmpty()


@pytest.mark.parametrize("model", ["skipgram", "cbow", "pvdm"])
def test_losses_are_those_of_the_joins_and_shuffle_nothing(small, monkeypatch, model):
    vocab, examples = small
    keys = ["graph_id", "line_no"]
    full = C.with_negatives(examples, vocab, keys, "target", 4, 3)
    ids = vocab.select(F.col("pattern_id").alias("id"))
    one, two, graphs = O.hash_vectors(ids, 3, 1), O.hash_vectors(ids, 6 if model == "pvdm" else 3, 2), O.hash_vectors(ids.where("id < 3"), 3, 3)
    f = {"skipgram": lambda: O.skipgram_losses(full, one, two, keys), "cbow": lambda: O.cbow_losses(full, one, two, keys, 3), "pvdm": lambda: O.pvdm_losses(full, graphs, one, two, keys, 3)}[model]
    got = f()
    assert exchanges(got) == 0
    monkeypatch.setattr(O, "MAX_CELLS", 0)
    a, b = ({tuple(r)[:2]: r.loss for r in x.collect()} for x in (got, f()))
    assert a.keys() == b.keys() and a and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_a_corpus_too_large_for_one_task_is_trained_where_it_is(spark, monkeypatch):
    docs = spark.createDataFrame([(g, "x", n, [f"p{(g + n + k) % 7}" for k in range(4)]) for g in range(5) for n in range(6)], "graph_id long, doc_kind string, line_no int, tokens array<string>")
    monkeypatch.setattr(trainer, "MAX_EXAMPLES", 10)
    for made in (P.pattern_vectors(docs, window=2, dim=3, epochs=6), P.graph2vec(docs, dim=3, epochs=6)):
        assert len(made.losses) == 6 and made.losses[-1] < made.losses[0]
        assert all(len(r.vector) == 3 and np.isfinite(r.vector).all() for r in made.embeddings.collect())


def test_sums_of_gradients():
    ids, g = trainer._summed(np.array([3, 1, 3]), np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]))
    assert ids.tolist() == [1, 3] and g.tolist() == [[3.0, 4.0], [6.0, 8.0]]


@pytest.mark.parametrize("kernel", ["rbf", "linear"])
@pytest.mark.parametrize("classes", [2, 3])
def test_machines_without_a_kernel_matrix_are_the_same(spark, monkeypatch, kernel, classes):
    rng = np.random.default_rng(1)
    y = np.arange(60) % classes
    x = rng.normal(size=(60, 3)) + y[:, None]
    want = {r.seed: tuple(r) for r in E.cross_validate(spark, x, y, kernel, 2, 3, [0.1, 1.0]).collect()}
    monkeypatch.setattr(E, "MAX_ROWS", 10)
    got = {r.seed: tuple(r) for r in E.cross_validate(spark, x, y, kernel, 2, 3, [0.1, 1.0]).collect()}
    assert got == want


def test_kernels_by_blocks_and_without_a_join_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "LARGEST", 4)
    monkeypatch.setattr(K, "LEAST", 1)
    counts = [(g, p, (g * 3 + p) % 5 + 1) for g in range(11) for p in range(8) if (g * p) % 3 == 1 or (p == 7 and g < 9)]
    made = K.mle_kernel_of_counts(spark.createDataFrame([(g, f"p{p}", n) for g, p, n in counts], "graph_id long, pattern string, cnt long"))
    total, want = {}, {}
    for g, p, n in counts:
        total[g] = total.get(g, 0) + n
        for h, q, m in counts:
            if q == p and g <= h:
                want[g, h] = want.get((g, h), 0) + n * m
    assert {(r.g1, r.g2): r.k for r in made.collect()} == {(g, h): x / (total[g] * total[h]) for (g, h), x in want.items()}
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    vectors = [(i, [float(i), 1.0, 0.5 * i]) for i in range(9)]
    got = {(r.g1, r.g2): r.k for r in K.gram(spark.createDataFrame(vectors, "graph_id long, vector array<double>")).collect()}
    assert got == {(i, j): sum(a * b for a, b in zip(v, w, strict=True)) for i, v in vectors for j, w in vectors if i <= j}
