"""Random walks, and the anonymous patterns that they leave.

Every draw is a hash of (graph, start, walk, step), looked up in the cumulative transition probabilities
of the node. Small graphs are walked whole (:mod:`.packed`) after one shuffle by graph; in large ones a step is an
equality join on (graph, node) with an interval as the residual condition, and the state is the walk so far, as arrays.

Isolated nodes start no walk; self-loops are left out; the last interval of a node ends at 1.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import SCALE, uniform, uniform_sql
from .packed import Chunk, Packed, codes, counted, listed, pack
from .patterns import Decomposition, count_patterns
from .relational import both_ways


def transitions(edges: DataFrame) -> DataFrame:
    """graph_id, src, dst, p, cum_lo, cum_hi, edge_label: steps with probabilities in proportion to the weights."""
    label = F.col("label") if "label" in edges.columns else F.coalesce("weight", F.lit(1.0)).cast("string")
    weighted = edges.where("src <> dst").select("graph_id", "src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w"), label.alias("edge_label"))
    both = both_ways(weighted, "w", "edge_label")
    at = Window.partitionBy("graph_id", "src")
    run = at.orderBy("dst").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumn("total", F.sum("w").over(at)).withColumn("upto", F.sum("w").over(run)).withColumn("last", F.max("dst").over(at))
    hi = F.when(F.col("dst") == F.col("last"), F.lit(1.0)).otherwise(F.col("upto") / F.col("total"))
    return summed.select("graph_id", "src", "dst", (F.col("w") / F.col("total")).alias("p"), ((F.col("upto") - F.col("w")) / F.col("total")).alias("cum_lo"), hi.alias("cum_hi"), "edge_label")


def walk(nodes: DataFrame, edges: DataFrame, steps: int, walks: int, seed: int = 0) -> DataFrame:
    """graph_id, start, walk, path (node ids), labels (of the nodes), edge_labels."""
    moves = transitions(edges)
    named = nodes.select("graph_id", "node_id", F.coalesce("label", F.lit("0")).alias("label"))
    reach = moves.join(named.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("here"), F.col("dst").alias("to"), "cum_lo", "cum_hi", "edge_label", F.col("label").alias("to_label"))
    starts = moves.select("graph_id", F.col("src").alias("node_id")).distinct().join(named, ["graph_id", "node_id"])
    state = starts.select("graph_id", F.col("node_id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("node_id").alias("here"), F.array("node_id").alias("path"), F.array("label").alias("labels"), F.array().cast("array<string>").alias("edge_labels"))
    for step in range(steps):
        drawn = state.withColumn("u", uniform(seed, F.col("graph_id"), F.col("start"), F.col("walk"), F.lit(step)))
        met = drawn.join(reach, ["graph_id", "here"]).where((F.col("u") >= F.col("cum_lo")) & (F.col("u") < F.col("cum_hi")))
        state = met.select("graph_id", "start", "walk", F.col("to").alias("here"), F.concat("path", F.array("to")).alias("path"), F.concat("labels", F.array("to_label")).alias("labels"), F.concat("edge_labels", F.array("edge_label")).alias("edge_labels"))
    return state.drop("here")


def anonymous(values: Column) -> Column:
    """Each value as the place of its first occurrence among the distinct values."""
    seen = F.array_distinct(values)
    return F.transform(values, lambda v: (F.array_position(seen, v) - 1).cast("int"))


def anonymous_pattern(setting: str | None) -> Column:
    """The anonymous walk of a row of :func:`walk`: by node identity (None), node, edge, or edge and node labels."""
    if setting is None:
        return anonymous(F.col("path"))
    if setting == "nodes":
        return anonymous(F.col("labels"))
    if setting == "edges":
        return anonymous(F.col("edge_labels"))
    if setting == "edges_nodes":
        rest = F.slice(anonymous(F.col("labels")), 2, F.size("edge_labels"))
        pairs = F.zip_with(anonymous(F.col("edge_labels")), rest, lambda e, n: F.array(e, n))
        return F.concat(F.array(F.lit(0)), F.flatten(pairs))
    raise ValueError(f"no such label setting: {setting}")


def as_token(pattern: Column) -> Column:
    return F.array_join(F.transform(pattern, lambda x: x.cast("string")), "_")


def _corpus(walked: DataFrame, pattern: Column, kind: str) -> Decomposition:
    tokens = walked.select("graph_id", "start", "walk", as_token(pattern).alias("pattern"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("walk", "pattern"))), lambda x: x["pattern"])
    docs = tokens.groupBy("graph_id", F.col("start").alias("line_no")).agg(line.alias("tokens")).select("graph_id", F.lit(kind).alias("doc_kind"), "line_no", "tokens")
    return Decomposition(docs, count_patterns(tokens))


#: Draws of a chunk at once.
DRAWS = 1 << 16


def _steps(c: Chunk):
    """The moves of a chunk, sorted by (start, end): first move of each node, end, cumulative bounds, edge (its place)."""
    edge = np.arange(len(c.u))
    u, v, w, e = c.both_ways(c.weight, edge)
    order = np.lexsort((v, u))
    u, v, w, e = u[order], v[order], w[order], e[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(c.node_id)))])
    summed = np.concatenate([[0.0], np.cumsum(w)])
    upto, total = summed[1:] - summed[first[u]], (summed[first[1:]] - summed[first[:-1]])[u]
    hi = upto / total
    hi[first[1:][first[1:] > first[:-1]] - 1] = 1.0
    return u, first, v, (upto - w) / total, hi, e


def _walks(c: Chunk, steps: int, walks: int, seed: int):
    """Place of the start of each walk and its number, the places of its nodes, and the edges it takes; a part of the starts at a time."""
    u, first, v, lo, hi, e = _steps(c)
    every = np.unique(u)
    for k in range(0, len(every), max(1, DRAWS // walks)):
        start = np.repeat(every[k : k + max(1, DRAWS // walks)], walks)
        number = np.tile(np.arange(walks), len(start) // walks)
        keys = [f"{seed}|{g}|{s}|{n}|" for g, s, n in zip(c.graph_ids[c.node_graph[start]].tolist(), c.node_id[start].tolist(), number.tolist(), strict=True)]
        path, taken, here = [start], [], start
        for step in range(steps):
            drawn = b"".join([md5(f"{x}{step}".encode()).digest() for x in keys])
            x = (np.frombuffer(drawn, ">u4")[::4] >> 4) / SCALE
            at = np.searchsorted(u + hi, here + x, "right")
            # The sum of place and bound may round: the bounds themselves decide.
            at = np.clip(at, first[here], first[here + 1] - 1)
            while (wrong := x >= hi[at]).any():
                at[wrong] += 1
            while (wrong := x < lo[at]).any():
                at[wrong] -= 1
            here = v[at]
            path.append(here)
            taken.append(e[at])
        yield start, number, np.stack(path, 1), np.stack(taken, 1) if taken else np.zeros((len(start), 0), np.int64)


def _ranked(values: np.ndarray) -> np.ndarray:
    """:func:`anonymous` of every row."""
    width = values.shape[1]
    same = np.full(values.shape, width, np.int64)
    for t in range(width - 1, -1, -1):
        same[:, t] = t
        for s in range(t - 1, -1, -1):
            same[:, t] = np.where(values[:, s] == values[:, t], s, same[:, t])
    rank = np.cumsum(same == np.arange(width), axis=1) - 1
    return np.take_along_axis(rank, same, axis=1) if width else same


def _tokens(c: Chunk, path: np.ndarray, taken: np.ndarray, setting: str | None) -> tuple[list[str], np.ndarray]:
    """The distinct anonymous walks as tokens, and the one of each row."""
    if setting is None:
        k = _ranked(path)
    elif setting == "nodes":
        k = _ranked(codes(["0" if x is None else x for x in c.labels])[1][path])
    else:
        edge = np.unique(c.weight, return_inverse=True)[1] if c.edge_labels is None else codes(["" if x is None else f"={x}" for x in c.edge_labels])[1]
        k = _ranked(edge[taken])
        if setting == "edges_nodes":
            nodes = _ranked(codes(["0" if x is None else x for x in c.labels])[1][path])
            k = np.concatenate([nodes[:, :1], np.stack([k, nodes[:, 1:]], 2).reshape(len(k), -1)], 1)
        elif setting != "edges":
            raise ValueError(f"no such label setting: {setting}")
    width = k.shape[1]
    if not width:
        return [""], np.zeros(len(k), np.int64)
    rows = np.ascontiguousarray((k + 1).astype(">u4")).view(f"S{4 * width}").ravel()
    _, at, code = np.unique(rows, return_index=True, return_inverse=True)
    return ["_".join(map(str, x)) for x in k[at].tolist()], code


def _walk_docs(c: Chunk, steps: int, setting: str | None, walks: int, seed: int, kind: str):
    for start, _, path, taken in _walks(c, steps, walks, seed):
        names, code = _tokens(c, path, taken, setting)
        own = start[::walks]
        tokens = listed(pa.array(names, pa.string()).take(pa.array(code)), np.arange(0, len(code) + 1, walks))
        yield pa.RecordBatch.from_arrays([pa.array(c.graph_ids[c.node_graph[own]], pa.int64()), pa.array([kind] * len(own), pa.string()), pa.array(c.node_id[own], pa.int32()), tokens], names=["graph_id", "doc_kind", "line_no", "tokens"])


def _walk_counts(c: Chunk, steps: int, setting: str | None, walks: int, seed: int):
    at: dict[str, int] = {}
    g, code = [], []
    for start, _, path, taken in _walks(c, steps, walks, seed):
        names, own = _tokens(c, path, taken, setting)
        place = np.array([at.setdefault(x, len(at)) for x in names], np.int64)
        # A graph has few patterns: what is kept of a part is one row for each of them and graph.
        key, n = np.unique(c.node_graph[start] * np.int64(1 << 32) + place[own], return_counts=True)
        g.append(np.repeat(key >> 32, n))
        code.append(np.repeat(key & 0xFFFFFFFF, n))
    if g:
        yield counted(c.graph_ids, np.concatenate(g), np.concatenate(code), list(at))


def _walk_corpus(nodes: DataFrame, edges: DataFrame, steps: int, setting: str | None, walks: int, seed: int, kind: str) -> Decomposition:
    anonymous_pattern(setting)
    packed: Packed = pack(nodes, edges)
    docs = packed.run(lambda c: _walk_docs(c, steps, setting, walks, seed, kind), "graph_id long, doc_kind string, line_no int, tokens array<string>")
    counts = packed.run(lambda c: _walk_counts(c, steps, setting, walks, seed), "graph_id long, pattern string, cnt long")
    if packed.nodes is None:
        return Decomposition(docs, counts)
    large = _corpus(walk(packed.nodes, packed.edges, steps, walks, seed), anonymous_pattern(setting), kind)
    return Decomposition(docs.unionByName(large.docs), counts.unionByName(large.counts))


def rw_corpus(nodes: DataFrame, edges: DataFrame, walk_length: int, neighborhood_size: int, seed: int = 0) -> Decomposition:
    """Label-anonymised random walks from every node that has an edge."""
    if neighborhood_size < 1:
        raise ValueError("at least one walk a node")
    return _walk_corpus(nodes, edges, walk_length, "nodes", neighborhood_size, seed, "rw")


def awe_corpus(nodes: DataFrame, edges: DataFrame, awe_length: int, label_setting: str | None = None, neighborhood_size: int = 10, seed: int = 0) -> Decomposition:
    """Anonymous walks; tokens are the walks themselves (numbers: :func:`walk_numbers`)."""
    return _walk_corpus(nodes, edges, awe_length, label_setting, neighborhood_size, seed, "awe")


def _strings(length: int, repeats: bool) -> list[tuple[int, ...]]:
    """Restricted-growth strings in order of their reversals; without ``repeats`` no value follows itself."""
    found: list[tuple[int, ...]] = [(0,)] if length else [()]
    for _ in range(length - 1):
        found = [(*w, j) for w in found for j in range(max(w) + 2) if repeats or j != w[-1]]
    return sorted(found, key=lambda w: w[::-1])


def enumerate_walks(spark: SparkSession, steps: int, setting: str | None = None) -> DataFrame:
    """walk_id, pattern of all anonymous walks of ``steps`` steps (their number is a Bell number: 115975 at 10)."""
    if setting is None:
        every = _strings(steps + 1, False)
    elif setting == "nodes":
        every = _strings(steps + 1, True)
    elif setting == "edges":
        every = _strings(steps, True)
    else:
        every = [(n[0], *(x for pair in zip(e, n[1:], strict=True) for x in pair)) for e in _strings(steps, True) for n in _strings(steps + 1, True)]
    return spark.createDataFrame([(i, "_".join(map(str, w))) for i, w in enumerate(every)], "walk_id int, pattern string")


def walk_numbers(counts: DataFrame, steps: int, setting: str | None = None) -> DataFrame:
    """Counts with the walks' numbers in the enumeration as patterns."""
    ids = enumerate_walks(counts.sparkSession, steps, setting)
    return counts.join(ids, "pattern").select("graph_id", F.col("walk_id").cast("string").alias("pattern"), "cnt")


def transitions_sql(dataset: str) -> str:
    return f"""
rw_both AS (SELECT graph_id, src, dst, coalesce(weight, 1.0) AS w FROM {dataset}_edges WHERE src <> dst UNION ALL SELECT graph_id, dst, src, coalesce(weight, 1.0) FROM {dataset}_edges WHERE src <> dst),
rw_sum AS (SELECT *, sum(w) OVER (PARTITION BY graph_id, src) AS total, sum(w) OVER (PARTITION BY graph_id, src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, max(dst) OVER (PARTITION BY graph_id, src) AS last FROM rw_both),
rw AS (SELECT graph_id, src, dst, w / total AS p, (upto - w) / total AS cum_lo, CASE WHEN dst = last THEN 1.0 ELSE upto / total END AS cum_hi, w AS weight FROM rw_sum)"""


def walk_sql(dataset: str, steps: int, walks: int, seed: int) -> str:
    """Common table expressions ending in rw_step (graph_id, start, walk, step, node, label, edge_label; step 0 is the start)."""
    u = uniform_sql(seed, "s.graph_id", "s.start", "s.walk", "s.step")
    return f"""{transitions_sql(dataset)},
rw_walk(graph_id, start, walk, step, node, edge_label) AS (
  SELECT graph_id, src, walk, 0, src, cast(NULL AS double) FROM (SELECT DISTINCT graph_id, src FROM rw), (SELECT unnest(range({walks})) AS walk)
  UNION ALL
  SELECT s.graph_id, s.start, s.walk, s.step + 1, t.dst, t.weight FROM (SELECT * FROM rw_walk WHERE step < {steps}) s JOIN rw t ON t.graph_id = s.graph_id AND t.src = s.node AND {u} >= t.cum_lo AND {u} < t.cum_hi),
rw_step AS (SELECT w.*, coalesce(n.label, '0') AS label FROM rw_walk w JOIN {dataset}_nodes n ON n.graph_id = w.graph_id AND n.node_id = w.node)"""


def anonymous_sql(setting: str | None) -> str:
    """Common table expressions ending in rw_pattern (graph_id, start, walk, pattern), after :func:`walk_sql`."""

    def ranked(name: str, value: str, where: str) -> str:
        return f"""
{name}_first AS (SELECT graph_id, start, walk, {value} AS v, min(step) AS f FROM rw_step WHERE {where} GROUP BY ALL),
{name}_rank AS (SELECT *, dense_rank() OVER (PARTITION BY graph_id, start, walk ORDER BY f) - 1 AS k FROM {name}_first),
{name} AS (SELECT s.graph_id, s.start, s.walk, s.step, r.k FROM rw_step s JOIN {name}_rank r ON r.graph_id = s.graph_id AND r.start = s.start AND r.walk = s.walk AND r.v = s.{value} WHERE {where.replace('step', 's.step')})"""

    join = "string_agg(cast(k AS varchar), '_' ORDER BY step)"
    if setting == "edges_nodes":
        return f"""{ranked("aw_n", "label", "step >= 0")},{ranked("aw_e", "edge_label", "step > 0")},
rw_pattern AS (SELECT graph_id, start, walk, string_agg(cast(k AS varchar), '_' ORDER BY o) AS pattern FROM
  (SELECT graph_id, start, walk, 2 * step AS o, k FROM aw_n UNION ALL SELECT graph_id, start, walk, 2 * step - 1, k FROM aw_e) GROUP BY ALL)"""
    value, where = {None: ("node", "step >= 0"), "nodes": ("label", "step >= 0"), "edges": ("edge_label", "step > 0")}[setting]
    return f"""{ranked("aw", value, where)},
rw_pattern AS (SELECT graph_id, start, walk, {join} AS pattern FROM aw GROUP BY ALL)"""
