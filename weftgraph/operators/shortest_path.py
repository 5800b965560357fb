"""Shortest-path patterns: label, label and distance of every ordered pair of connected nodes, self pairs too.

Graphs of at most DENSE_NODES nodes are searched whole (:mod:`.packed`), one graph after another, breadth first over
boolean matrices, and named and counted where they are searched, so that pairs are never shuffled; larger ones by
a frontier of rows, a level at a time, so that no graph has to fit in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .packed import Chunk, Packed, codes, counted, listed, pack
from .patterns import Decomposition, count_patterns
from .relational import both_ways

DENSE_NODES = 2048
#: Rows of a graph of DENSE_NODES nodes with every edge.
MAX_EDGES = 1 << 22


#: Cells of the distance matrices that are handled at once, beyond one graph.
CELLS = 1 << 20


def _search(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances within one graph of n nodes, -1 where there is no path."""
    adj = np.zeros((n, n), np.float32)
    adj[u, v] = adj[v, u] = 1
    dist = np.full(adj.shape, -1, np.int32)
    front, level = np.eye(n, dtype=bool), 0
    while front.any():
        dist[front] = level
        front, level = (front.astype(np.float32) @ adj > 0) & (dist < 0), level + 1
    return dist


def _pairs(c: Chunk):
    """Places of the ends and distances of all connected pairs, in order of the source and the target; a few graphs at a time."""
    first = np.searchsorted(c.node_graph, np.arange(len(c.graph_ids) + 1))
    order = np.argsort(c.edge_graph, kind="stable")
    u, v = c.u[order], c.v[order]
    ends = np.searchsorted(c.edge_graph[order], np.arange(len(c.graph_ids) + 1))
    held, cells = [], 0
    for k in range(len(c.graph_ids)):
        n = int(first[k + 1] - first[k])
        if not n:
            continue
        at = slice(ends[k], ends[k + 1])
        dist = _search(n, u[at] - first[k], v[at] - first[k])
        i, j = np.nonzero(dist >= 0)
        held.append((i + first[k], j + first[k], dist[i, j].astype(np.int64)))
        cells += len(i)
        if cells >= CELLS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, cells = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _seen_labels(c: Chunk, compat: bool) -> list:
    """The label each node is seen with; None for a node without a place in the shifted list (:func:`shifted_labels`)."""
    own = ["0" if x is None else x for x in c.labels]
    if not compat:
        return own
    order = np.lexsort((c.node_id.astype("U11"), c.node_graph))
    first = np.searchsorted(c.node_graph, np.arange(len(c.graph_ids) + 1))
    size = np.diff(first)[c.node_graph]
    return [own[order[f + i - 1]] if 1 <= i <= n else None for f, i, n in zip(first[c.node_graph].tolist(), c.node_id.tolist(), size.tolist(), strict=True)]


def _named(c: Chunk, compat: bool):
    """Ends, distinct patterns and the pattern of each pair."""
    labels = _seen_labels(c, compat)
    gone = np.array([x is None for x in labels], bool)
    names, code = codes(["" if x is None else x for x in labels])
    for i, j, d in _pairs(c):
        if gone.any():
            kept = ~(gone[i] | gone[j])
            i, j, d = i[kept], j[kept], d[kept]
        wide = int(d.max(initial=0)) + 1
        key = (np.minimum(code[i], code[j]) * len(names) + np.maximum(code[i], code[j])) * wide + d
        keys, own = np.unique(key, return_inverse=True)
        yield i, j, [f"{names[k // wide // len(names)]}_{names[k // wide % len(names)]}_{k % wide}" for k in keys.tolist()], own


def _sp_docs(c: Chunk, compat: bool):
    for i, _, names, own in _named(c, compat):
        source, first = np.unique(i, return_index=True)
        tokens = listed(pa.array(names, pa.string()).take(pa.array(own)), np.append(first, len(i)))
        yield pa.RecordBatch.from_arrays([pa.array(c.graph_ids[c.node_graph[source]], pa.int64()), pa.array(["sp"] * len(source), pa.string()), pa.array(c.node_id[source], pa.int32()), tokens], names=["graph_id", "doc_kind", "line_no", "tokens"])


def _sp_counts(c: Chunk, compat: bool):
    for i, _, names, own in _named(c, compat):
        yield counted(c.graph_ids, c.node_graph[i], own, names)


def _found(c: Chunk):
    for i, j, d in _pairs(c):
        yield pa.RecordBatch.from_arrays([pa.array(c.graph_ids[c.node_graph[i]], pa.int64()), pa.array(c.node_id[i], pa.int32()), pa.array(c.node_id[j], pa.int32()), pa.array(d.astype(np.int32))], names=["graph_id", "src", "dst", "d"])


def _frontier(nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Distances by levels: what a level reaches for the first time is the next frontier."""
    reached = settle(nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0).alias("d")))
    front, level = reached, 0
    step = adjacency.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
    while not front.isEmpty():
        level += 1
        new = front.join(step, ["graph_id", "dst"]).select("graph_id", "src", F.col("to").alias("dst")).distinct().join(reached.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")
        front = settle(new.withColumn("d", F.lit(level)))
        reached = reached.unionByName(front)
    return reached


def _large_distances(packed: Packed) -> DataFrame:
    return _frontier(packed.nodes.select("graph_id", "node_id").distinct(), both_ways(packed.edges.where("src <> dst").select("graph_id", "src", "dst")))


def distances(nodes: DataFrame, edges: DataFrame, dense_nodes: int = DENSE_NODES) -> DataFrame:
    """graph_id, src, dst, d of all ordered connected pairs, self pairs at 0."""
    packed = pack(nodes, edges, MAX_EDGES, dense_nodes)
    small = packed.run(_found, "graph_id long, src int, dst int, d int")
    return small if packed.nodes is None else small.unionByName(_large_distances(packed))


def shifted_labels(nodes: DataFrame) -> DataFrame:
    """Labels as a reader gets them that looks node k up in the list of nodes sorted as strings (compatibility)."""
    names = Window.partitionBy("graph_id").orderBy(F.col("node_id").cast("string"))
    listed = nodes.select("graph_id", "label", F.row_number().over(names).alias("place"))
    return nodes.select("graph_id", "node_id").join(listed.withColumnRenamed("place", "node_id"), ["graph_id", "node_id"]).select("graph_id", "node_id", "label")


def sp_tokens(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph_id, src, dst, pattern ``a_b_d`` with the two labels in string order."""
    labels = nodes.select("graph_id", "node_id", F.coalesce("label", F.lit("0")).alias("label"))
    a = labels.select("graph_id", F.col("node_id").alias("src"), F.col("label").alias("a"))
    b = labels.select("graph_id", F.col("node_id").alias("dst"), F.col("label").alias("b"))
    found = pairs.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return found.select("graph_id", "src", "dst", F.concat_ws("_", F.least("a", "b"), F.greatest("a", "b"), F.col("d").cast("string")).alias("pattern"))


def sp_docs(tokens: DataFrame) -> DataFrame:
    """A sentence for each source node, its pairs in order of the target."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("dst", "pattern"))), lambda x: x["pattern"])
    return tokens.groupBy("graph_id", F.col("src").alias("line_no")).agg(line.alias("tokens")).select("graph_id", F.lit("sp").alias("doc_kind"), "line_no", "tokens")


def sp_corpus(nodes: DataFrame, edges: DataFrame, compat: bool = False, dense_nodes: int = DENSE_NODES) -> Decomposition:
    """``compat``: labels looked up by string-sorted node ids (see :func:`shifted_labels`)."""
    packed = pack(nodes, edges, MAX_EDGES, dense_nodes)
    docs = packed.run(lambda c: _sp_docs(c, compat), "graph_id long, doc_kind string, line_no int, tokens array<string>")
    counts = packed.run(lambda c: _sp_counts(c, compat), "graph_id long, pattern string, cnt long")
    if packed.nodes is None:
        return Decomposition(docs, counts)
    tokens = sp_tokens(shifted_labels(packed.nodes) if compat else packed.nodes, _large_distances(packed))
    return Decomposition(docs.unionByName(sp_docs(tokens)), counts.unionByName(count_patterns(tokens)))


def sp_sql(dataset: str, longest: int, compat: bool = False) -> str:
    """Common table expressions ending in sp (graph_id, src, dst, pattern). ``longest``: a bound of all distances."""
    place = "row_number() OVER (PARTITION BY graph_id ORDER BY cast(node_id AS varchar))" if compat else "node_id"
    levels = [f"sp_adj AS (SELECT graph_id, src, dst FROM {dataset}_edges WHERE src <> dst UNION ALL SELECT graph_id, dst, src FROM {dataset}_edges WHERE src <> dst)"]
    levels.append(
        f"sp_walk(graph_id, src, dst, d) AS (SELECT graph_id, node_id, node_id, 0 FROM {dataset}_nodes UNION SELECT w.graph_id, w.src, a.dst, w.d + 1 FROM sp_walk w JOIN sp_adj a ON a.graph_id = w.graph_id AND a.src = w.dst WHERE w.d < {longest})"
    )
    levels.append("sp_dist AS (SELECT graph_id, src, dst, min(d) AS d FROM sp_walk GROUP BY ALL)")
    levels.append(f"sp_label AS (SELECT graph_id, {place} AS node_id, coalesce(label, '0') AS label FROM {dataset}_nodes)")
    levels.append("sp AS (SELECT p.graph_id, src, dst, concat_ws('_', least(x.label, y.label), greatest(x.label, y.label), d) AS pattern FROM sp_dist p JOIN sp_label x ON x.graph_id = p.graph_id AND x.node_id = src JOIN sp_label y ON y.graph_id = p.graph_id AND y.node_id = dst)")
    return ",\n".join(levels)
