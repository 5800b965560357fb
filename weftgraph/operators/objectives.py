"""Negative-sampling objectives as column expressions: skip-gram and PV-DBOW, CBOW, PV-DM.

Scores are clamped to [-10, 10]; the loss of an example is -log s(positive) - sum log s(-negative).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import uniform
from ..functions.vectors import clamp, dot, log_sigmoid, vector_sum


#: Numbers of the vector tables of a loss that are broadcast at most (128 MB); larger tables are joined.
MAX_CELLS = 16_000_000


def _matrix(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a vector table in order, and their vectors."""
    table = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    ids = table["id"].to_numpy()
    flat = table["vector"].combine_chunks()
    cells = np.asarray(pa.concat_arrays(flat.chunks).flatten() if isinstance(flat, pa.ChunkedArray) else flat.flatten())
    order = np.argsort(ids)
    return ids[order], cells.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 1))


def _small(*tables: DataFrame) -> bool:
    """Whether vector tables hold at most MAX_CELLS numbers together, by a count."""
    cells = 0
    for t in tables:
        cells += t.agg(F.sum(F.size("vector")).alias("n")).first()["n"] or 0
    return cells <= MAX_CELLS


def _losses(examples: DataFrame, keys: list[str], tables: dict[str, DataFrame], hidden, positive: str, output: str) -> DataFrame:
    """keys, loss of rows that hold their negatives, with all vectors broadcast: no shuffle. ``hidden`` gives the hidden vectors of a batch.

    A row with an id that has no vector is left out, as a join leaves it out.
    """
    shared = examples.sparkSession.sparkContext.broadcast({name: _matrix(t) for name, t in tables.items()})
    fields = [f for f in examples.schema.fields if f.name in keys]
    fields.sort(key=lambda f: keys.index(f.name))

    def run(batches):
        matrices = shared.value

        def vectors(name: str, wanted: np.ndarray):
            ids, m = matrices[name]
            at = np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
            ok = ids[at] == wanted if len(ids) else np.zeros(wanted.shape, bool)
            return (m[at] if len(ids) else np.zeros((*wanted.shape, m.shape[1]))), ok

        def column(batch, name: str) -> np.ndarray:
            x = batch.column(name)
            if pa.types.is_list(x.type):
                return np.asarray(x.flatten()).reshape(len(x), -1)
            return x.to_numpy(zero_copy_only=False)

        for batch in batches:
            if not len(batch):
                continue
            h, ok = hidden(lambda table, name: vectors(table, column(batch, name)))  # noqa: B023
            c, found = vectors(output, column(batch, positive))
            n, every = vectors(output, column(batch, "negatives"))
            ok = ok & found & every.all(axis=1)
            s, t = np.clip((h * c).sum(axis=1), -10, 10), np.clip(-(h[:, None, :] * n).sum(axis=2), -10, 10)
            loss = np.log1p(np.exp(-s)) + np.log1p(np.exp(-t)).sum(axis=1)
            out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(loss)], names=[*keys, "loss"])
            yield out if ok.all() else out.filter(pa.array(ok))

    return examples.mapInArrow(run, T.StructType([*fields, T.StructField("loss", T.DoubleType())]))


def hash_vectors(ids: DataFrame, dim: int, seed: int, spread: float = 1.0) -> DataFrame:
    """id, vector: vectors made from hashes, uniform in (-spread / dim, spread / dim)."""
    parts = F.array(*[(uniform(seed, F.col("id"), F.lit(j)) * 2 - 1) * (spread / dim) for j in range(dim)])
    return ids.select("id", parts.alias("vector"))


def example_loss(hidden: Column, positive: Column, negatives: Column) -> Column:
    """Loss of one example; ``negatives`` is an array of vectors."""
    lost = F.aggregate(negatives, F.lit(0.0), lambda acc, n: acc - log_sigmoid(-clamp(dot(hidden, n))))
    return -log_sigmoid(clamp(dot(hidden, positive))) + lost


def attach(df: DataFrame, vectors: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the vector of the id in ``column``."""
    return df.join(vectors.select(F.col("id").alias(column), F.col("vector").alias(name)), column)


def attach_many(df: DataFrame, vectors: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``df`` with the array of the vectors of the ids in the array ``column``, in order."""
    each = df.select(*keys, F.posexplode(column).alias("_k", "id")).join(vectors, "id")
    grouped = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "vector"))), lambda x: x["vector"]).alias(name))
    return df.join(grouped, keys)


def skipgram_losses(pairs: DataFrame, targets: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, loss. pairs: keys, target, context, negatives."""
    if _small(targets, contexts):
        return _losses(pairs, keys, {"t": targets, "c": contexts}, lambda at: at("t", "target"), "context", "c")
    full = attach_many(attach(attach(pairs, targets, "target", "_t"), contexts, "context", "_c"), contexts, keys, "negatives", "_n")
    return full.select(*keys, example_loss(F.col("_t"), F.col("_c"), F.col("_n")).alias("loss"))


def cbow_losses(examples: DataFrame, contexts: DataFrame, output: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """keys, loss. examples: keys, target, contexts, negatives. The hidden layer is the sum of the contexts."""
    if _small(contexts, output):

        def hidden(at):
            v, ok = at("c", "contexts")
            return v.sum(axis=1), ok.all(axis=1)

        return _losses(examples, keys, {"c": contexts, "o": output}, hidden, "target", "o")
    full = attach_many(attach_many(attach(examples, output, "target", "_t"), contexts, keys, "contexts", "_c"), output, keys, "negatives", "_n")
    return full.select(*keys, example_loss(vector_sum(F.col("_c"), dim), F.col("_t"), F.col("_n")).alias("loss"))


def pvdm_losses(examples: DataFrame, graphs: DataFrame, contexts: DataFrame, output: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """As :func:`cbow_losses`, the graph's vector before the sum; ``output`` has vectors of 2 * dim."""
    if _small(graphs, contexts, output):

        def hidden(at):
            (v, ok), (g, known) = at("c", "contexts"), at("g", "graph")
            return np.hstack([g, v.sum(axis=1)]), ok.all(axis=1) & known

        return _losses(examples, keys, {"c": contexts, "o": output, "g": graphs}, hidden, "target", "o")
    full = attach(attach(examples, output, "target", "_t"), graphs, "graph", "_g")
    full = attach_many(attach_many(full, contexts, keys, "contexts", "_c"), output, keys, "negatives", "_n")
    return full.select(*keys, example_loss(F.concat("_g", vector_sum(F.col("_c"), dim)), F.col("_t"), F.col("_n")).alias("loss"))


def smoothed(losses: list[float], keep: float = 0.9) -> float:
    """Exponentially smoothed loss of a training run."""
    value = 0.0
    for x in losses:
        value = keep * value + (1 - keep) * x
    return value


def smoothed_column(losses: Column, keep: float = 0.9) -> Column:
    return F.aggregate(losses, F.lit(0.0), lambda acc, x: acc * keep + x * (1 - keep))
