"""Weisfeiler-Lehman rooted-subtree patterns.

A node's label at iteration i + 1 is the digest of its own label and its neighbours' sorted labels at
iteration i, so labels need no dictionary and no order over the dataset. Small graphs are relabelled whole
(:mod:`.packed`) after one shuffle by graph. Large ones take one join and one aggregation per iteration, keyed by
(graph, node): each row of the table of neighbours (which holds every node itself as well) meets the label of
one node, and only labels travel; every iteration is written to the shared checkpoint folder.

Nodes without a label have the pattern ``0+0`` at iteration 0; isolated nodes have no neighbours.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import dense_index
from ..session import settle
from .packed import Chunk, Packed, codes, counted, listed, pack
from .patterns import Decomposition, count_patterns
from .relational import both_ways

UNLABELLED = "0"
#: A node has at most so many lines, one for each iteration.
LINES = 16


def _pattern(it, label):
    return F.concat(it.cast("string"), F.lit("+"), label)


STATES = "graph_id long, node_id int, it int, label string, neighbours array<string>"


def _large_states(nodes: DataFrame, edges: DataFrame, iterations: int) -> DataFrame:
    me = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(True).alias("self"))
    near = me.unionByName(both_ways(edges.where("src <> dst")).select("graph_id", "src", "dst", F.lit(False).alias("self")))
    state = nodes.select("graph_id", F.col("node_id").alias("dst"), F.coalesce("label", F.lit(UNLABELLED)).alias("label"))
    found = []
    for it in range(iterations + 1):
        met = near.join(state, ["graph_id", "dst"])
        own = met.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.max(F.when(F.col("self"), F.col("label"))).alias("label"), F.array_sort(F.collect_list(F.when(~F.col("self"), F.col("label")))).alias("neighbours"))
        found.append(settle(own.select("graph_id", "node_id", F.lit(it).alias("it"), "label", "neighbours")))
        state = found[-1].select("graph_id", F.col("node_id").alias("dst"), F.md5(F.concat_ws("|", "label", F.array_join("neighbours", ","))).alias("label"))
    return reduce(DataFrame.unionByName, found)


def _rounds(c: Chunk, iterations: int):
    """For each iteration: its distinct labels in order, the code of each node, and the codes around each node (sorted) with their offsets."""
    u, v = c.both_ways()
    ends = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(c.node_id)))]).astype(np.int64)
    labels = [UNLABELLED if x is None else x for x in c.labels]
    for it in range(iterations + 1):
        names, own = codes(labels)
        around = own[v][np.lexsort((own[v], u))]
        yield it, names, own, around, ends
        if it < iterations:
            near, at = [names[k] for k in around.tolist()], ends.tolist()
            labels = [md5(f"{x}|{','.join(near[i:j])}".encode()).hexdigest() for x, i, j in zip(labels, at[:-1], at[1:], strict=True)]


def _states(c: Chunk, iterations: int):
    for it, names, own, around, ends in _rounds(c, iterations):
        table = pa.array(names, pa.string())
        n = len(own)
        yield pa.RecordBatch.from_arrays([pa.array(c.graph_ids[c.node_graph], pa.int64()), pa.array(c.node_id, pa.int32()), pa.array(np.full(n, it), pa.int32()), table.take(pa.array(own)), listed(table.take(pa.array(around)), ends)], names=["graph_id", "node_id", "it", "label", "neighbours"])


def _counts(c: Chunk, iterations: int, mode: str):
    for it, names, own, around, ends in _rounds(c, iterations):
        g, code = c.node_graph, own
        if mode == "doc":
            centre = np.repeat(np.arange(len(own)), np.diff(ends))
            new = np.ones(len(around), bool)
            new[1:] = (around[1:] != around[:-1]) | (centre[1:] != centre[:-1])
            g, code = np.concatenate([g, c.node_graph[centre[new]]]), np.concatenate([code, around[new]])
        yield counted(c.graph_ids, g, code, [f"{it}+{x}" for x in names])


def _packed_states(packed: Packed, iterations: int) -> DataFrame:
    small = packed.run(lambda c: _states(c, iterations), STATES)
    return small if packed.nodes is None else small.unionByName(_large_states(packed.nodes, packed.edges, iterations))


def _packed_counts(packed: Packed, iterations: int, mode: str) -> DataFrame:
    small = packed.run(lambda c: _counts(c, iterations, mode), "graph_id long, pattern string, cnt long")
    return small if packed.nodes is None else small.unionByName(wl_counts(_large_states(packed.nodes, packed.edges, iterations), mode))


def wl_states(nodes: DataFrame, edges: DataFrame, iterations: int) -> DataFrame:
    """graph_id, node_id, it, label, neighbours (their sorted labels) for it = 0..iterations."""
    return _packed_states(pack(nodes, edges), iterations)


def wl_graph_counts(nodes: DataFrame, edges: DataFrame, iterations: int, mode: str = "doc") -> DataFrame:
    """:func:`wl_counts` of :func:`wl_states`, with small graphs counted where they are relabelled."""
    return _packed_counts(pack(nodes, edges), iterations, mode)


def wl_docs(states: DataFrame) -> DataFrame:
    """A sentence for each node and iteration: its pattern, then its neighbours' distinct patterns in order."""
    around = F.transform(F.array_distinct("neighbours"), lambda n: _pattern(F.col("it"), n))
    return states.select("graph_id", F.lit("wl").alias("doc_kind"), (F.col("node_id") * LINES + F.col("it")).alias("line_no"), F.concat(F.array(_pattern(F.col("it"), F.col("label"))), around).alias("tokens"))


def wl_counts(states: DataFrame, mode: str = "doc") -> DataFrame:
    """Pattern counts: of every token of the documents (``doc``) or of the centres alone (``centre``)."""
    if mode == "centre":
        return count_patterns(states.select("graph_id", _pattern(F.col("it"), F.col("label")).alias("pattern")))
    return count_patterns(wl_docs(states).select("graph_id", F.explode("tokens").alias("pattern")))


def wl_dense_labels(states: DataFrame) -> DataFrame:
    """it, label, pattern: the patterns with numbers, ``it+k``, k from 0 in each iteration in order of the labels."""
    distinct = states.select("it", "label").distinct()
    ranked = dense_index(distinct, ["it", "label"], "place")
    first = ranked.groupBy("it").agg(F.min("place").alias("first"))
    return ranked.join(F.broadcast(first), "it").select("it", "label", F.concat_ws("+", F.col("it").cast("string"), (F.col("place") - F.col("first")).cast("string")).alias("pattern"))


def label_number(pattern):
    """The number in ``it+k``."""
    return F.element_at(F.split(pattern, r"\+"), -1).cast("int")


def wl_corpus(nodes: DataFrame, edges: DataFrame, max_h: int = 2, mode: str = "doc") -> Decomposition:
    packed = pack(nodes, edges)
    return Decomposition(wl_docs(_packed_states(packed, max_h)), _packed_counts(packed, max_h, mode))


def wl_sql(dataset: str, iterations: int) -> str:
    """Common table expressions wl_0..wl_h (graph_id, node_id, label, neighbours) and wl in DuckDB's SQL."""
    out = [
        f"wl_adj AS (SELECT graph_id, src, dst FROM {dataset}_edges WHERE src <> dst UNION ALL SELECT graph_id, dst, src FROM {dataset}_edges WHERE src <> dst)",
        f"wl_label_0 AS (SELECT graph_id, node_id, coalesce(label, '{UNLABELLED}') AS label FROM {dataset}_nodes)",
    ]
    for i in range(iterations + 1):
        out.append(
            f"wl_{i} AS (SELECT l.graph_id, l.node_id, l.label, coalesce(list_sort(list(n.label) FILTER (n.label IS NOT NULL)), []) AS neighbours FROM wl_label_{i} l LEFT JOIN wl_adj a ON a.graph_id = l.graph_id AND a.src = l.node_id"
            f" LEFT JOIN wl_label_{i} n ON n.graph_id = a.graph_id AND n.node_id = a.dst GROUP BY ALL)"
        )
        out.append(f"wl_label_{i + 1} AS (SELECT graph_id, node_id, md5(concat_ws('|', label, array_to_string(neighbours, ','))) AS label FROM wl_{i})")
    every = " UNION ALL ".join(f"SELECT graph_id, node_id, {i} AS it, label, neighbours FROM wl_{i}" for i in range(iterations + 1))
    return ",\n".join([*out, f"wl AS ({every})"])
