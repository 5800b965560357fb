"""Graphlet patterns from sampled windows of nodes.

The graph of a window is a bit mask over its upper triangle, row by row. Its canonical form is the
smallest bit string over all orders of the nodes, and its number is ``base(n)`` plus the rank of that
string among the canonical strings of n nodes, where ``base`` counts the graphs of fewer nodes (one empty
graph of no node included). So the numbers follow from a rule; no table is stored.

A sample orders the nodes of a graph by a hash; its first n nodes are the main window, and each of them
with the next n - 1 nodes is a co-occurring window (missing nodes are isolated ones). A graph of fewer
than n nodes counts as ``samples`` empty graphlets.

Small graphs are sampled whole (:mod:`.packed`) after one shuffle by graph; large ones by joins on (graph, sample).
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import draw
from .packed import Chunk, codes, counted, listed, pack
from .patterns import Decomposition, count_patterns
from .relational import both_ways

#: Sizes whose masks all fit a lookup table; larger ones are canonicalised as they are observed.
TABLE_SIZE = 6


def bit_of(i: int, j: int, n: int) -> int:
    """Place of the pair i < j in the bit string, 0 for its first (most significant) bit."""
    return i * n - i * (i + 1) // 2 + j - i - 1


@lru_cache(maxsize=8)
def _orders(n: int) -> np.ndarray:
    """For every order of n nodes and every place of the bit string, the place that moves there."""
    pairs = list(combinations(range(n), 2))
    return np.array([[bit_of(min(p[i], p[j]), max(p[i], p[j]), n) for i, j in pairs] for p in permutations(range(n))], np.int64).reshape(-1, len(pairs))


def canonical(masks, n: int) -> np.ndarray:
    """Smallest mask over all orders of the nodes, for each mask."""
    masks = np.asarray(masks, np.int64)
    width = n * (n - 1) // 2
    best = np.full(len(masks), np.iinfo(np.int64).max)
    bits = (masks[:, None] >> (width - 1 - np.arange(width))) & 1
    weights = np.int64(1) << (width - 1 - np.arange(width))
    for order in _orders(n):
        np.minimum(best, bits[:, order] @ weights, out=best)
    return best


@lru_cache(maxsize=8)
def canonical_masks(n: int) -> np.ndarray:
    """All canonical masks of n nodes in order: those of n - 1 nodes with one node more."""
    if n <= 1:
        return np.zeros(1, np.int64)
    if n > 7:
        raise ValueError("all graphs of more than 7 nodes are not listed; their pattern is the canonical bit string")
    grown = []
    for small in canonical_masks(n - 1).tolist():
        for ties in range(1 << (n - 1)):
            mask = 0
            for i, j in combinations(range(n), 2):
                bit = (small >> ((n - 1) * (n - 2) // 2 - 1 - bit_of(i, j, n - 1))) & 1 if j < n - 1 else (ties >> i) & 1
                mask = mask << 1 | bit
            grown.append(mask)
    return np.unique(canonical(np.unique(grown), n))


@lru_cache(maxsize=8)
def base(n: int) -> int:
    """Number of the empty graphlet of n nodes: one more than all graphs of 1..n-1 nodes."""
    return 1 + sum(len(canonical_masks(k)) for k in range(1, n))


def graphlet_numbers(masks, n: int) -> list[str]:
    form = canonical(masks, n)
    if n > 7:
        return [format(m, f"0{n * (n - 1) // 2}b") for m in form.tolist()]
    return [str(base(n) + r) for r in np.searchsorted(canonical_masks(n), form).tolist()]


def star_number(k: int, n: int) -> str:
    """Number of the star with k leaves and isolated nodes."""
    return graphlet_numbers([sum(1 << (n * (n - 1) // 2 - 1 - bit_of(0, j, n)) for j in range(1, k + 1))], n)[0]


def lookup_table(spark: SparkSession, n: int) -> DataFrame:
    """mask, idx of every mask of n nodes (n <= 6: at most 32768 rows, a bound that allows a broadcast)."""
    if n > TABLE_SIZE:
        raise ValueError("too many masks")
    masks = np.arange(1 << (n * (n - 1) // 2))
    return spark.createDataFrame(pd.DataFrame({"mask": masks, "idx": graphlet_numbers(masks, n)}), "mask long, idx string")


def numbered(windows: DataFrame, n: int) -> DataFrame:
    """Windows (column mask) with their graphlet number idx."""
    if n <= TABLE_SIZE:
        return windows.join(F.broadcast(lookup_table(windows.sparkSession, n)), "mask")
    seen = windows.select("mask").distinct()

    def run(batches):
        for pdf in batches:
            yield pdf.assign(idx=graphlet_numbers(pdf["mask"].to_numpy(), n))

    return windows.join(seen.mapInPandas(run, "mask long, idx string"), "mask")


def sample_places(nodes: DataFrame, n: int, samples: int, seed: int) -> DataFrame:
    """graph_id, sample, node_id, place for the first 2n - 1 places of every sample of the graphs that are large enough."""
    sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= n).select("graph_id")
    drawn = nodes.join(sizes, "graph_id").select("graph_id", "node_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    order = Window.partitionBy("graph_id", "sample").orderBy(draw(seed, F.col("graph_id"), F.col("sample"), F.col("node_id")), "node_id")
    return drawn.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < 2 * n - 1)


def window_edges(places: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, sample, p < q of the edges between places of a sample."""
    a = places.select("graph_id", "sample", F.col("node_id").alias("src"), F.col("place").alias("p"))
    b = places.select("graph_id", "sample", F.col("node_id").alias("dst"), F.col("place").alias("q"))
    pairs = a.join(b, ["graph_id", "sample"]).where("p < q")
    return pairs.join(both_ways(edges.where("src <> dst")).select("graph_id", "src", "dst").distinct(), ["graph_id", "src", "dst"]).select("graph_id", "sample", "p", "q")


def graphlet_windows(nodes: DataFrame, edges: DataFrame, n: int, samples: int, seed: int = 0, star_compat: bool = False) -> DataFrame:
    """graph_id, sample, window (0 main, 1..n co-occurring), idx.

    ``star_compat``: only edges at the window's first node are seen, all to that node, so every graphlet is
    a star with isolated nodes (how a reader counts that takes row numbers for neighbours).
    """
    places = sample_places(nodes, n, samples, seed)
    found = window_edges(places, edges)
    # Seats within a window: main, place = seat; co-occurring w, the places n..2n-2 first and then node w - 1.
    size = places.groupBy("graph_id", "sample").agg(F.max("place").alias("last"))
    windows = size.select("graph_id", "sample", "last", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("window"))
    extra = F.least(F.col("last") - n + 1, F.lit(n - 1))
    seat = lambda c: F.when(F.col("window") == 0, F.when(F.col(c) < n, F.col(c))).when(F.col(c) >= n, F.col(c) - n).when(F.col(c) == F.col("window") - 1, F.greatest(extra, F.lit(0)))
    held = windows.join(found, ["graph_id", "sample"], "left").select("graph_id", "sample", "window", seat("p").alias("i"), seat("q").alias("j"))
    held = held.select("graph_id", "sample", "window", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("i").isNotNull() & F.col("j").isNotNull()).alias("in"))
    width = n * (n - 1) // 2
    place = F.col("i") * n - (F.col("i") * (F.col("i") + 1) / 2).cast("int") + F.col("j") - F.col("i") - 1
    if star_compat:
        touched = F.array(*[F.max(F.when(F.col("in") & ((F.col("i") == s) | (F.col("j") == s)), 1).otherwise(0)) for s in range(1, n)])
        stars = held.groupBy("graph_id", "sample", "window").agg(F.aggregate(touched, F.lit(0), lambda a, x: a + x).alias("leaves"))
        names = F.array(*[F.lit(star_number(k, n)) for k in range(n)])
        return stars.select("graph_id", "sample", "window", F.element_at(names, F.col("leaves") + 1).alias("idx"))
    power = F.element_at(F.array(*[F.lit(1 << (width - 1 - b)).cast("bigint") for b in range(width)]), (place + 1).cast("int"))
    masks = held.groupBy("graph_id", "sample", "window").agg(F.coalesce(F.sum(F.when(F.col("in"), power)), F.lit(0)).cast("bigint").alias("mask"))
    return numbered(masks, n).select("graph_id", "sample", "window", "idx")


def _places(c: Chunk, n: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Graph, sample and the node at each of the 2n - 1 places (-1: none) of the samples of the graphs of n nodes or more."""
    size = np.bincount(c.node_graph, minlength=len(c.graph_ids))
    node = np.flatnonzero(size[c.node_graph] >= n)
    g, out = c.node_graph[node], []
    names = [f"|{x}" for x in c.node_id[node].tolist()]
    first = np.searchsorted(g, np.unique(g))
    for k in range(samples):
        heads = [f"{seed}|{x}|{k}" for x in c.graph_ids.tolist()]
        drawn = b"".join([md5((heads[a] + b).encode()).digest() for a, b in zip(g.tolist(), names, strict=True)])
        order = np.lexsort((c.node_id[node], np.frombuffer(drawn, ">u4")[::4] >> 4, g))
        own = first[:, None] + np.arange(2 * n - 1)
        here = np.minimum(own, max(0, len(node) - 1))
        inside = (own < len(node)) & (g[here] == g[first][:, None]) if len(node) else np.zeros(own.shape, bool)
        out.append(np.where(inside, node[order][here], -1) if len(node) else own)
    graphs = g[first]
    return np.repeat(graphs, samples), np.tile(np.arange(samples), len(graphs)), np.stack(out, 1).reshape(-1, 2 * n - 1)


def _masks(c: Chunk, n: int, samples: int, seed: int, star: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Graph, sample, and the mask of each window 0..n of it; with ``star``, the number of seats after the first that have an edge."""
    g, sample, place = _places(c, n, samples, seed)
    edges = np.unique(np.concatenate([c.u * len(c.node_id) + c.v, c.v * len(c.node_id) + c.u]))
    last = (place >= 0).sum(axis=1) - 1
    moved = np.maximum(np.minimum(last - n + 1, n - 1), 0)
    width = n * (n - 1) // 2
    bits = np.zeros((len(g), n + 1, n, n), bool)
    rows = np.arange(len(g))
    for p, q in combinations(range(2 * n - 1), 2):
        key = place[:, p] * len(c.node_id) + place[:, q]
        at = np.minimum(np.searchsorted(edges, key), max(0, len(edges) - 1))
        met = (place[:, p] >= 0) & (place[:, q] >= 0) & (edges[at] == key) if len(edges) else np.zeros(len(g), bool)
        if q < n:
            bits[met, 0, p, q] = True
        for w in range(1, n + 1):
            i, j = (x - n if x >= n else moved if x == w - 1 else None for x in (p, q))
            if i is not None and j is not None:
                i, j = np.broadcast_to(i, len(g)), np.broadcast_to(j, len(g))
                bits[rows[met], w, np.minimum(i, j)[met], np.maximum(i, j)[met]] = True
    if star:
        return g, sample, (bits.any(axis=2) | bits.any(axis=3))[:, :, 1:].sum(axis=2)
    power = np.zeros((n, n), np.int64)
    for i, j in combinations(range(n), 2):
        power[i, j] = 1 << (width - 1 - bit_of(i, j, n))
    return g, sample, (bits * power).sum(axis=(2, 3))


def _graphlet_counts(c: Chunk, n: int, samples: int, seed: int, star: bool, names: list[str], of: np.ndarray):
    """``names``: the distinct numbers; ``of``: the one of each mask."""
    g, _, code = _masks(c, n, samples, seed, star)
    yield counted(c.graph_ids, np.repeat(g, n + 1), of[code.ravel()], names)


def _graphlet_lines(c: Chunk, n: int, samples: int, seed: int, star: bool, names: list[str]):
    g, sample, code = _masks(c, n, samples, seed, star)
    tokens = listed(pa.array(names, pa.string()).take(pa.array(code.ravel())), np.arange(len(g) + 1) * (n + 1))
    yield pa.RecordBatch.from_arrays([pa.array(c.graph_ids[g], pa.int64()), pa.array(["graphlet"] * len(g), pa.string()), pa.array(sample.astype(np.int32)), tokens], names=["graph_id", "doc_kind", "line_no", "tokens"])


def _few(c: Chunk, n: int, samples: int, empty: str):
    left = c.graph_ids[(lambda size: (size > 0) & (size < n))(np.bincount(c.node_graph, minlength=len(c.graph_ids)))]
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array([empty] * len(left), pa.string()), pa.array(np.full(len(left), samples), pa.int64())], names=["graph_id", "pattern", "cnt"])


def _empty(n: int) -> str:
    return str(base(n)) if n <= 8 else "0" * (n * (n - 1) // 2)


def graphlet_docs(windows: DataFrame) -> DataFrame:
    """A sentence for each sample: the main graphlet, then the co-occurring ones."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("window", "idx"))), lambda x: x["idx"])
    return windows.groupBy("graph_id", F.col("sample").cast("int").alias("line_no")).agg(line.alias("tokens")).select("graph_id", F.lit("graphlet").alias("doc_kind"), "line_no", "tokens")


def small_graph_counts(nodes: DataFrame, n: int, samples: int) -> DataFrame:
    """Counts of the graphs of fewer than n nodes: all samples are the empty graphlet."""
    few = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") < n)
    return few.select("graph_id", F.lit(_empty(n)).alias("pattern"), F.lit(samples).cast("bigint").alias("cnt"))


def _joined_corpus(nodes: DataFrame, edges: DataFrame, n: int, samples: int, seed: int, star_compat: bool) -> Decomposition:
    windows = graphlet_windows(nodes, edges, n, samples, seed, star_compat)
    counts = count_patterns(windows.select("graph_id", F.col("idx").alias("pattern")))
    return Decomposition(graphlet_docs(windows), counts.unionByName(small_graph_counts(nodes, n, samples)))


def graphlet_corpus(nodes: DataFrame, edges: DataFrame, n: int = 4, samples: int = 10, seed: int = 0, star_compat: bool = False) -> Decomposition:
    """Windows of sizes whose masks all have a number in a table are numbered where they are drawn; larger ones take the joins."""
    if n > TABLE_SIZE:
        return _joined_corpus(nodes, edges, n, samples, seed, star_compat)
    packed = pack(nodes, edges)
    names = [star_number(k, n) for k in range(n)] if star_compat else graphlet_numbers(np.arange(1 << (n * (n - 1) // 2)), n)
    (distinct, of), empty = codes(names), _empty(n)

    def counts(c: Chunk):
        yield from _graphlet_counts(c, n, samples, seed, star_compat, distinct, of)
        yield from _few(c, n, samples, empty)

    made = Decomposition(packed.run(lambda c: _graphlet_lines(c, n, samples, seed, star_compat, names), "graph_id long, doc_kind string, line_no int, tokens array<string>"), packed.run(counts, "graph_id long, pattern string, cnt long"))
    if packed.nodes is None:
        return made
    large = _joined_corpus(packed.nodes, packed.edges, n, samples, seed, star_compat)
    return Decomposition(made.docs.unionByName(large.docs), made.counts.unionByName(large.counts))


def graphlet_sql(dataset: str, n: int, samples: int, seed: int, star_compat: bool = False) -> str:
    """Common table expressions ending in gl (graph_id, pattern, cnt) in DuckDB's SQL, for n of 3 to 5."""
    from ..functions.rng import uniform_sql

    width = n * (n - 1) // 2
    if star_compat:
        names = ", ".join(f"'{star_number(k, n)}'" for k in range(n))
        touched = " + ".join(f"max(CASE WHEN i IS NOT NULL AND j IS NOT NULL AND (i = {s} OR j = {s}) THEN 1 ELSE 0 END)" for s in range(1, n))
        code = f"([{names}])[cast({touched} AS integer) + 1]"
        final = f"gl_idx AS (SELECT graph_id, sample, w, {code} AS idx FROM gl_held GROUP BY ALL)"
    else:
        rows = ", ".join(f"({m}, '{x}')" for m, x in enumerate(graphlet_numbers(np.arange(1 << width), n)))
        place = f"(least(i, j) * {n} - least(i, j) * (least(i, j) + 1) // 2 + greatest(i, j) - least(i, j) - 1)"
        final = (
            f"gl_mask AS (SELECT graph_id, sample, w, coalesce(sum(CASE WHEN i IS NOT NULL AND j IS NOT NULL THEN 1 << cast({width} - 1 - {place} AS integer) END), 0) AS mask FROM gl_held GROUP BY ALL),\n"
            f"gl_lut(mask, idx) AS (VALUES {rows}),\ngl_idx AS (SELECT graph_id, sample, w, idx FROM gl_mask JOIN gl_lut USING (mask))"
        )
    seat = lambda c: f"CASE WHEN w = 0 THEN CASE WHEN {c} < {n} THEN {c} END WHEN {c} >= {n} THEN {c} - {n} WHEN {c} = w - 1 THEN greatest(least(last - {n} + 1, {n - 1}), 0) END"
    u = uniform_sql(seed, "graph_id", "sample", "node_id")
    return f"""
gl_size AS (SELECT graph_id, count(*) AS size FROM {dataset}_nodes GROUP BY 1),
gl_place AS (SELECT graph_id, sample, node_id, row_number() OVER (PARTITION BY graph_id, sample ORDER BY {u}, node_id) - 1 AS place
  FROM {dataset}_nodes JOIN gl_size USING (graph_id), (SELECT unnest(range({samples})) AS sample) WHERE size >= {n}),
gl_first AS (SELECT * FROM gl_place WHERE place < {2 * n - 1}),
gl_adj AS (SELECT graph_id, src, dst FROM {dataset}_edges WHERE src <> dst UNION SELECT graph_id, dst, src FROM {dataset}_edges WHERE src <> dst),
gl_found AS (SELECT a.graph_id, a.sample, a.place AS p, b.place AS q FROM gl_first a JOIN gl_first b ON a.graph_id = b.graph_id AND a.sample = b.sample AND a.place < b.place
  JOIN gl_adj e ON e.graph_id = a.graph_id AND e.src = a.node_id AND e.dst = b.node_id),
gl_win AS (SELECT graph_id, sample, last, w FROM (SELECT graph_id, sample, max(place) AS last FROM gl_first GROUP BY ALL), (SELECT unnest(range({n + 1})) AS w)),
gl_held AS (SELECT graph_id, sample, w, {seat("p")} AS i, {seat("q")} AS j FROM gl_win LEFT JOIN gl_found USING (graph_id, sample)),
{final},
gl AS (SELECT graph_id, idx AS pattern, count(*) AS cnt FROM gl_idx GROUP BY ALL
  UNION ALL SELECT graph_id, '{base(n)}', {samples} FROM gl_size WHERE size < {n})"""
