"""The pipelines: graphs -> patterns -> (kernel | corpus -> training) -> evaluation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators.evaluate import cross_validate, feature_matrix
from ..operators.graphlet import graphlet_corpus
from ..operators.kernels import deep_features, graph_vectors, mle_kernel
from ..operators.patterns import Decomposition
from ..operators.shortest_path import sp_corpus
from ..operators.trainer import Optimizer, Trained, embedding_table, train, train_distributed
from ..operators.walks import awe_corpus, rw_corpus
from ..operators.wl import wl_corpus
from ..session import settle
from ..sources.derive import GraphDataset


def decompose(data: GraphDataset, kind: str, **p) -> Decomposition:
    """``kind``: wl (max_h, mode), sp (compat), graphlet (n, samples, seed), rw (walk_length, neighborhood_size, seed), awe (awe_length, label_setting, ...)."""
    made = {"wl": wl_corpus, "sp": sp_corpus, "graphlet": graphlet_corpus, "rw": rw_corpus, "awe": awe_corpus}
    if kind not in made:
        raise ValueError(f"no such decomposition: {kind}")
    return made[kind](data.nodes, data.edges, **p)


@dataclass
class Embedded:
    """Embeddings of graphs or patterns, the vocabulary they belong to, and the losses of the epochs."""

    embeddings: DataFrame
    vocab: DataFrame
    losses: list[float]
    trained: Trained


def _train(examples: DataFrame, model: str, n_targets: int, n_vocab: int, distributed: bool, **p) -> Trained:
    """``count``: the number of the examples before those without negatives are left out."""
    if distributed:
        p.pop("count", None)
        return train_distributed(examples, model, n_targets, n_vocab, **p)
    return train(examples, model, n_targets, n_vocab, **p)


def graph2vec(docs: DataFrame, min_count: int = 0, seed: int = 0, distributed: bool = False, **training) -> Embedded:
    """PV-DBOW: a vector for each graph that predicts the patterns of its document."""
    docs = settle(docs)
    vocab = settle(C.vocabulary(C.token_frequencies(docs), min_count))
    graphs = settle(C.graph_rows(docs))
    pairs = settle(C.pvdbow_pairs(docs, vocab, graphs))
    examples = C.with_negatives(pairs, vocab, ["graph_id", "line_no"], "context", seed=seed)
    training.setdefault("optimizer", Optimizer("adam", rate=0.1))
    trained = _train(examples, "skipgram", graphs.count(), vocab.count(), distributed, seed=seed, count=pairs.count(), **training)
    names = graphs.select(F.col("graph_row").alias("entity_id"), F.col("graph_id").cast("string").alias("name"))
    return Embedded(embedding_table(docs.sparkSession, trained.parameters["input"], names), vocab, trained.losses, trained)


def pattern_vectors(docs: DataFrame, model: str = "skipgram", window: int = 4, min_count: int = 0, seed: int = 0, distributed: bool = False, raw: bool = False, **training) -> Embedded:
    """Skip-gram or CBOW vectors of patterns. ``raw``: for CBOW, the side that training does not touch (zeros stay zeros of no use)."""
    docs = settle(docs)
    vocab = settle(C.vocabulary(C.token_frequencies(docs, window), min_count))
    if model == "skipgram":
        keys, examples = ["graph_id", "line_no", "i", "j"], C.skipgram_pairs(docs, vocab, window)
    else:
        keys, examples = ["graph_id", "line_no", "i"], C.cbow_examples(docs, vocab, window)
    full = C.with_negatives(examples, vocab, keys, "target", seed=seed)
    n = vocab.count()
    trained = _train(full, model, n, n, distributed, seed=seed, count=examples.count(), **training)
    matrix = trained.parameters["input"]
    if raw and model == "cbow":
        matrix = np.random.default_rng(seed).uniform(-1 / matrix.shape[1], 1 / matrix.shape[1], matrix.shape)
    names = vocab.select(F.col("pattern_id").alias("entity_id"), F.col("pattern").alias("name"))
    return Embedded(embedding_table(docs.sparkSession, matrix, names), vocab, trained.losses, trained)


def pvdm_vectors(docs: DataFrame, window: int = 4, min_count: int = 0, seed: int = 0, distributed: bool = False, **training) -> Embedded:
    """PV-DM: vectors of graphs that, with the contexts, predict the patterns."""
    docs = settle(docs)
    vocab = settle(C.vocabulary(C.token_frequencies(docs, window), min_count))
    graphs = settle(C.graph_rows(docs))
    examples = C.pvdm_examples(docs, vocab, graphs, window)
    keys = ["graph_id", "line_no", "i"]
    full = C.with_negatives(examples, vocab, keys, "target", seed=seed)
    trained = _train(full, "pvdm", graphs.count(), vocab.count(), distributed, seed=seed, count=examples.count(), **training)
    names = graphs.select(F.col("graph_row").alias("entity_id"), F.col("graph_id").cast("string").alias("name"))
    return Embedded(embedding_table(docs.sparkSession, trained.parameters["graph"], names), vocab, trained.losses, trained)


def awe_dd(data: GraphDataset, awe_length: int = 10, label_setting: str | None = "nodes", neighborhood_size: int = 10, window: int = 16, seed: int = 0, **training) -> Embedded:
    """Anonymous-walk documents with PV-DM."""
    return pvdm_vectors(decompose(data, "awe", awe_length=awe_length, label_setting=label_setting, neighborhood_size=neighborhood_size, seed=seed).docs, window=window, seed=seed, **training)


def deep_graph_kernel(data: GraphDataset, kind: str, window: int = 10, model: str = "skipgram", seed: int = 0, params: dict | None = None, **training) -> tuple[DataFrame, DataFrame, Embedded]:
    """Kernel P M P' (as vectors P E of the graphs), features P M, and the pattern vectors."""
    made = decompose(data, kind, **(params or {}))
    embedded = pattern_vectors(made.docs, model=model, window=window, seed=seed, **training)
    vectors = embedded.embeddings.select(F.col("name").alias("pattern"), F.col("vector").cast("array<double>").alias("vector"))
    prob = settle(made.prob)
    return graph_vectors(prob, vectors), deep_features(prob, vectors), embedded


def mle_graph_kernel(data: GraphDataset, kind: str, **p) -> DataFrame:
    """g1 <= g2, k: P P' of the pattern probabilities."""
    return mle_kernel(settle(decompose(data, kind, **p).prob))


def kernel_matrix(kernel: DataFrame, graphs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A kernel of a few thousand graphs as a matrix, with the graphs' classes, in order of their ids."""
    from ..operators.evaluate import MAX_ROWS

    known = graphs.where("class_label is not null")
    if known.count() > MAX_ROWS:
        raise ValueError("too many graphs for a kernel matrix on one machine")
    y = known.select("graph_id", "class_label").orderBy("graph_id").toPandas()
    at = {g: i for i, g in enumerate(y["graph_id"])}
    ids = known.select("graph_id")
    cells = kernel.join(ids.withColumnRenamed("graph_id", "g1"), "g1").join(ids.withColumnRenamed("graph_id", "g2"), "g2").toPandas()
    k = np.zeros((len(at), len(at)))
    i, j = cells["g1"].map(at).to_numpy(), cells["g2"].map(at).to_numpy()
    k[i, j] = k[j, i] = cells["k"].to_numpy()
    return k, y["class_label"].to_numpy()


def classify_kernel(kernel: DataFrame, graphs: DataFrame, cv: int = 10, **p) -> DataFrame:
    """Cross-validated accuracy of a machine on a precomputed kernel."""
    return cross_validate(kernel.sparkSession, *kernel_matrix(kernel, graphs), kernel="precomputed", cv=cv, **p)


def classify_embeddings(embedded: DataFrame, graphs: DataFrame, kernel: str = "rbf", cv: int = 10, **p) -> DataFrame:
    """Cross-validated accuracy on graph vectors (entity names are graph ids)."""
    vectors = embedded.select(F.col("name").cast("bigint").alias("graph_id"), "vector")
    return cross_validate(embedded.sparkSession, *feature_matrix(vectors, graphs.where("class_label is not null")), kernel=kernel, cv=cv, **p)
