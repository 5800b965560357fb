"""Vocabulary, negatives, examples, objectives, training, evaluation, sources, streaming."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import corpus as C
from weftgraph.operators import evaluate as E
from weftgraph.operators import kernels as K
from weftgraph.operators import relational as R
from weftgraph.operators import trainer as T
from weftgraph.plans import pipelines as P
from weftgraph.plans import sweeps
from weftgraph.sources import docs as D
from weftgraph.sources import embeddings as EM
from weftgraph.sources import gexf, labels, results, tu
from weftgraph.sources.derive import GraphDataset

DOCS = [(1, 0, ["a", "b", "c"]), (1, 1, ["b", "a"]), (2, 0, ["c", "a", "b", "a"]), (2, 1, ["d"])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "graph_id long, line_no int, tokens array<string>")


def test_vocabulary_order_and_slots(docs):
    v = C.vocabulary(C.token_frequencies(docs, 3)).orderBy("pattern_id").collect()
    assert [(r["pattern"], r["freq"]) for r in v] == [("a", 4), ("b", 3), ("c", 2), ("d", 1)]
    mass = sum(math.sqrt(r["freq"]) for r in v)
    assert all(r["neg_hi"] - r["neg_lo"] == round(math.sqrt(r["freq"]) / mass * C.SLOTS) for r in v)
    assert v[0]["neg_lo"] == 0 and all(a["neg_hi"] == b["neg_lo"] for a, b in zip(v, v[1:], strict=False))
    centre = {r["pattern"]: r["freq"] for r in C.token_frequencies(docs).collect()}
    assert centre == {"a": 1, "b": 1, "c": 1, "d": 1, "UNK": 1}
    assert C.vocabulary(C.token_frequencies(docs, 3), 3).count() == 2


def test_negatives_avoid_their_target(docs):
    vocab = C.vocabulary(C.token_frequencies(docs, 3)).cache()
    pairs = C.skipgram_pairs(docs, vocab, 3)
    keys = ["graph_id", "line_no", "i", "j"]
    rows = pairs.join(C.negatives(pairs, vocab, keys, "target", size=5, seed=1), keys).collect()
    assert rows and all(r["target"] not in r["negatives"] and len(r["negatives"]) <= 5 for r in rows)


def test_examples(docs):
    vocab = C.vocabulary(C.token_frequencies(docs, 3)).cache()
    assert C.skipgram_pairs(docs, vocab, 3).count() == 6 + 2 + 12
    assert C.skipgram_pairs(docs, vocab, 3, seed=1).count() == 3
    cbow = C.cbow_examples(docs, vocab, 3)
    assert cbow.count() == 3 + 2 + 4 and all(len(r["contexts"]) == 3 for r in cbow.collect())


def test_added_documents(docs):
    both = C.add_documents(C.token_frequencies(docs.where("graph_id = 1"), 3), docs, docs.where("graph_id = 1"), 3)
    assert {r["pattern"]: r["freq"] for r in both.collect()} == {"a": 4, "b": 3, "c": 2, "d": 1}


@pytest.mark.parametrize("model", ["skipgram", "cbow", "pvdm"])
def test_gradients_are_those_of_the_loss(model):
    rng = np.random.default_rng(1)
    p = {k: rng.normal(0, 0.5, v.shape) for k, v in T.init_parameters(model, 4, 6, 3, 0).items()}
    batch = {"target": np.array([0, 2]), "context": np.array([1, 3]), "graph": np.array([1, 3]), "contexts": np.array([[1, 4], [5, 0]]), "negatives": np.array([[2, 3, 4], [0, 1, 5]])}
    batch = {k: batch[k] for k in T.ARRAYS[model]}
    _, grads = T.gradients(model, p, batch)
    for name, (ids, rows) in grads.items():
        full = np.zeros_like(p[name])
        np.add.at(full, ids, rows)
        at = (int(ids[0]), 1)
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-6
        assert abs((T.gradients(model, moved, batch)[0] - T.gradients(model, p, batch)[0]) / 1e-6 - full[at]) < 1e-3


def test_training_lowers_the_loss(docs):
    out = P.graph2vec(docs, dim=4, epochs=30, seed=1)
    assert out.losses[-1] < out.losses[0] and out.embeddings.count() == 2
    far = P.graph2vec(docs, dim=4, epochs=4, seed=1, distributed=True, optimizer=T.Optimizer("adam", rate=0.1))
    assert far.losses[-1] < far.losses[0]


def test_kernels(spark):
    prob = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)], "graph_id long, pattern string, prob double")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "pattern string, vector array<double>")
    mle = {(r["g1"], r["g2"]): r["k"] for r in K.mle_kernel(prob).collect()}
    assert mle == {(1, 1): 0.5, (1, 2): 0.5, (2, 2): 1.0}
    e = np.array([[1.0, 0.0], [0.0, 2.0]])
    p = np.array([[0.5, 0.5], [1.0, 0.0]])
    deep = {(r["g1"], r["g2"]): r["k"] for r in K.deep_kernel(prob, vec).collect()}
    full = p @ (e @ e.T) @ p.T
    assert all(abs(deep[i + 1, j + 1] - full[i, j]) < 1e-12 for i in range(2) for j in range(i, 2))
    assert K.dense_rows(prob, ["a", "b"]).where("graph_id = 2").first()["b"] == 0.0


def test_machines(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(4, 1, (30, 2))])
    y = np.repeat([0, 1], 30)
    for kernel in ("rbf", "linear"):
        runs = E.cross_validate(spark, x, y, kernel, cv=2, folds=3, grid=[1.0, 10.0]).collect()
        assert len(runs) == 2 and min(r["accuracy"] for r in runs) > 0.8
    assert E.evaluate_run(x @ x.T, y, 0, "precomputed", 3, [1.0])["accuracy"] > 0.8


def test_split_metrics_and_sweeps(spark):
    rows = spark.range(95).withColumnRenamed("id", "graph_id")
    assert E.train_test_split(rows, seed=3).where("is_test").count() == 10
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    m = {r["label"]: r for r in E.class_metrics(pred).collect()}
    assert m[0]["precision"] == 1.0 and m[0]["recall"] == 0.5 and abs(m[1]["f1"] - 0.8) < 1e-9
    work = sweeps.work(spark, "dgk_graphlet")
    assert work.count() == 250 and sweeps.work(spark, "dgk_graphlet", work.limit(50)).count() == 200


def test_relational(spark):
    member = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "node long, graph_id long")
    raw = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "x long, y long")
    kept = R.valid_edges(raw, member)
    assert kept.count() == 2
    assert R.simple_edges(kept.select("graph_id", F.col("x").alias("src"), F.col("y").alias("dst"))).count() == 1


def test_files(spark, f1, tmp_path):
    nodes, edges = f1
    graphs = spark.createDataFrame([(1, "1.gexf", 1), (2, "2.gexf", -1)], "graph_id long, graph_name string, class_label int")
    data = GraphDataset(graphs, nodes.where("graph_id < 3"), edges.where("graph_id < 3"))
    folder = tmp_path / "gexf"
    folder.mkdir()
    for r in gexf.gexf_rows(data).collect():
        (folder / f"{r['graph_id']}.gexf").write_text(r["text"])
    labels.write_class_labels(graphs, str(tmp_path / "labels"))
    back = gexf.read_gexf(spark, str(folder), labels_file=str(tmp_path / "labels"))
    assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, data.nodes.collect()))
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, data.edges.collect()))
    assert {r["graph_id"]: r["class_label"] for r in back.graphs.collect()} == {1: 1, 2: -1}
    assert gexf.read_gexf(spark, str(folder), max_files=1).graphs.count() == 1


def test_tu_format(spark, tmp_path):
    at = tmp_path / "DS"
    at.mkdir()
    (at / "DS_A.txt").write_text("1, 2\n2, 1\n2, 3\n3, 2\n5, 6\n6, 5\n3, 5\n")
    (at / "DS_graph_indicator.txt").write_text("1\n1\n1\n1\n2\n2\n")
    (at / "DS_graph_labels.txt").write_text("1\n-1\n")
    data = tu.format_dataset(spark, str(at), "DS", str(tmp_path / "out"))
    assert sorted((r["graph_id"], r["src"], r["dst"]) for r in data.edges.collect()) == [(1, 1, 2), (1, 2, 3), (2, 1, 2)]
    assert {(r["graph_id"], r["node_id"]): r["label"] for r in data.nodes.collect()}[1, 2] == "2"
    assert data.graphs.count() == 2 and data.nodes.count() == 5
    again = tu.format_dataset(spark, str(at), "DS", str(tmp_path / "out"))
    assert again.edges.count() == 3
    (at / "DS_node_labels.txt").write_text("x\ny\nx\nz\nx\ny\n")
    assert tu.read_tu(spark, str(at), "DS", keep_isolated=True).nodes.where("label = 'z'").count() == 1


def test_documents_embeddings_results(spark, docs, tmp_path):
    (tmp_path / "1.gexf.wld2").write_text("a b\nb\n")
    (tmp_path / "2.gexf.wld2").write_text("c a\n")
    got = D.read_documents(spark, str(tmp_path), D.suffix("wl", depth=2))
    assert sorted((r["graph_id"], r["line_no"], list(r["tokens"])) for r in got.collect()) == [(1, 0, ["a", "b"]), (1, 1, ["b"]), (2, 0, ["c", "a"])]
    assert D.list_files(spark, str(tmp_path), ".wld2", 1).count() == 1
    D.write_documents(docs.withColumn("doc_kind", F.lit("wl")), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() == 4
    emb = spark.createDataFrame([("x/1.gexf.wld2", [1.0, 2.0]), ("x/2.gexf.wld2", [0.0, 1.0])], "name string, vector array<float>")
    EM.write_embeddings(emb, str(tmp_path / "emb"))
    assert sorted(map(str, EM.read_embeddings(spark, str(tmp_path / "emb")).collect())) == sorted(map(str, emb.collect()))
    os.makedirs(tmp_path / "res")
    (tmp_path / "res" / "MUTAG_2_128_0.txt").write_text("0.85,0.02")
    r = results.read_results(spark, str(tmp_path / "res"), ["dataset", "depth", "dim", "run"]).first()
    assert (r["dataset"], r["dim"], r["accuracy"]) == ("MUTAG", "128", 0.85)


def test_stream_of_documents(spark, docs, tmp_path):
    from weftgraph.streaming import ingest as I

    src, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    docs.where("graph_id = 1").write.mode("append").parquet(src)
    I.ingest(I.read_sentences(spark, src), store, check, 3).awaitTermination()
    docs.write.mode("append").parquet(src)
    I.ingest(I.read_sentences(spark, src), store, check, 3).awaitTermination()
    assert {r["pattern"]: r["freq"] for r in I.latest(spark, store).collect()} == {"a": 4, "b": 3, "c": 2, "d": 1}


def test_negatives_are_always_as_many_as_asked(spark):
    """One pattern holds nearly all slots: rows that avoid it, and rows that avoid another or none."""
    vocab = spark.createDataFrame([(0, 0, 99_000_000), (1, 99_000_000, 99_999_990), (2, 99_999_990, 100_000_000)], "pattern_id long, neg_lo long, neg_hi long")
    targets = spark.createDataFrame([(i, i % 4) for i in range(60)], "i long, avoid long")
    got = {r["i"]: r["negatives"] for r in C.negatives(targets, vocab, ["i"], "avoid").collect()}
    assert len(got) == 60 and all(len(x) == 10 and i % 4 not in x for i, x in got.items())
    assert {x for i, v in got.items() if i % 4 == 0 for x in v} >= {1} and {x for i, v in got.items() if i % 4 == 1 for x in v} >= {0}
    alone = vocab.where("pattern_id = 0")
    assert C.negatives(targets.where("avoid = 0"), alone, ["i"], "avoid").count() == 0


def test_gexf_labels_with_special_characters(spark, tmp_path):
    names = ['a&b', 'a"b', "a'b", "<x>", "a\"b'c&amp;", "plain"]
    (tmp_path / "7.gexf").write_text(gexf.gexf_text(list(enumerate(names, 1)), [(1, 2, 1.0), (2, 3, 2.0)]))
    back = gexf.read_gexf(spark, str(tmp_path))
    assert {r["node_id"]: r["label"] for r in back.nodes.collect()} == dict(enumerate(names, 1))
    assert {(r["src"], r["dst"], r["weight"]) for r in back.edges.collect()} == {(1, 2, 1.0), (2, 3, 2.0)}
