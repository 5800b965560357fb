"""Small graphs whole: rows of nodes and edges, sorted by graph, pass through numpy a few thousand at a time.

One shuffle by graph brings the rows of a graph together; they are packed into compressed blocks, checkpointed
once, and every decomposition after that reads blocks and shuffles nothing. Graphs of more than
``max_rows`` rows (or ``max_nodes`` nodes), and graphs that the vectorised forms do not cover (repeated nodes or
edges, edges to unknown nodes, weights that are no positive whole numbers), are left to the relational forms, whose
keys are (graph, node), so that no graph has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Rows (nodes and edges) of a graph that is still handled whole, of the chunk handled at once, and of a packed block.
MAX_ROWS, CHUNK, BLOCK = 1 << 18, 1 << 15, 1 << 12
#: Sums of weights below this are exact.
EXACT = float(1 << 50)


@dataclass
class Chunk:
    """Whole graphs. Nodes are sorted by (graph, node id); edges refer to their places, each once, u < v as node ids."""

    graph_ids: np.ndarray
    node_graph: np.ndarray
    node_id: np.ndarray
    labels: list
    edge_graph: np.ndarray
    u: np.ndarray
    v: np.ndarray
    weight: np.ndarray
    edge_labels: list | None

    def both_ways(self, *extra: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([self.u, self.v]), np.concatenate([self.v, self.u]), *(np.concatenate([x, x]) for x in extra)]


def _chunk(table: pa.Table, labelled: bool) -> tuple[Chunk, np.ndarray]:
    """A table of whole graphs as a chunk, and which of its graphs are irregular (their rows in it are of no use)."""
    table = table.combine_chunks()
    gid = table["graph_id"].to_numpy()
    is_edge = table["dst"].is_valid().to_numpy()
    graph_ids, g = np.unique(gid, return_inverse=True)
    odd = np.zeros(len(graph_ids), bool)
    node_at, edge_at = np.flatnonzero(~is_edge), np.flatnonzero(is_edge)
    a = table["src"].fill_null(-1).to_numpy().astype(np.int64)
    odd[g[table["src"].is_null().to_numpy()]] = True
    order = np.lexsort((a[node_at], g[node_at]))
    node_at = node_at[order]
    key = (g[node_at] << 32) + (a[node_at] + (1 << 31))
    twice = np.flatnonzero(key[1:] == key[:-1])
    odd[g[node_at[twice]]] = True
    eg, src, dst = g[edge_at], a[edge_at], table["dst"].fill_null(0).to_numpy().astype(np.int64)[edge_at]
    weight = table["weight"].fill_null(1.0).to_numpy()[edge_at]
    lo, hi = np.minimum(src, dst), np.maximum(src, dst)
    ends = []
    for x in (lo, hi):
        wanted = (eg << 32) + (x + (1 << 31))
        place = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
        odd[eg[key[place] != wanted] if len(key) else eg] = True
        ends.append(place)
    with np.errstate(invalid="ignore"):
        odd[eg[~((weight > 0) & (weight < EXACT) & (weight == np.floor(weight)))]] = True
    same = np.lexsort((hi, lo, eg))
    again = np.flatnonzero((eg[same][1:] == eg[same][:-1]) & (lo[same][1:] == lo[same][:-1]) & (hi[same][1:] == hi[same][:-1]))
    odd[eg[same[again]]] = True
    if len(weight):
        odd[np.bincount(eg, np.where(np.isfinite(weight), weight, 0), len(graph_ids)) >= EXACT] = True
    labels = table["label"].take(pa.array(node_at)).to_pylist()
    edge_labels = table["label"].take(pa.array(edge_at)).to_pylist() if labelled else None
    return Chunk(graph_ids, g[node_at], a[node_at], labels, eg, ends[0], ends[1], weight, edge_labels), odd


def _whole(batches: Iterator[pa.RecordBatch], rows: int, max_rows: int) -> Iterator[tuple[pa.Table | None, int | None]]:
    """Tables of whole graphs, of about ``rows`` rows or more, from batches sorted by graph; a graph beyond ``max_rows`` as its id alone."""
    held: list[pa.Table] = []
    size, skip = 0, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if skip is not None:
            gid = table["graph_id"].to_numpy()
            table = table.slice(int(np.searchsorted(gid, skip, "right")))
            if not len(table):
                continue
            skip = None
        if not len(table):
            continue
        held.append(table)
        size += len(table)
        while size >= rows:
            merged = pa.concat_tables(held).combine_chunks()
            gid = merged["graph_id"].to_numpy()
            cut = int(np.searchsorted(gid, gid[-1], "left"))
            if cut:
                yield merged.slice(0, cut), None
                held, size = [merged.slice(cut)], size - cut
                if size >= rows:
                    continue
            else:
                held = [merged]
            if size > max_rows:
                skip, held, size = int(gid[-1]), [], 0
                yield None, skip
            break
    if size:
        yield pa.concat_tables(held), None


@dataclass
class Packed:
    """Blocks of small graphs, and the nodes and edges of the others (None where there are none)."""

    blocks: DataFrame
    labelled: bool
    nodes: DataFrame | None
    edges: DataFrame | None

    def run(self, f: Callable[[Chunk], Iterator[pa.RecordBatch] | list], schema: str, chunk: int = CHUNK) -> DataFrame:
        """``f`` over chunks of the small graphs."""
        labelled = self.labelled

        def batches(rows):
            for batch in rows:
                for data in batch.column("data"):
                    if data.is_valid:
                        yield from pa.ipc.open_stream(data.as_buffer())

        def run(rows):
            for table, _ in _whole(batches(rows), chunk, 1 << 62):
                yield from f(_chunk(table, labelled)[0])

        return self.blocks.select("data").mapInArrow(run, schema)


def pack(nodes: DataFrame, edges: DataFrame, max_rows: int | None = None, max_nodes: int | None = None) -> Packed:
    max_rows = MAX_ROWS if max_rows is None else max_rows
    labelled = "label" in edges.columns
    label = F.col("label").cast("string") if labelled else F.lit(None).cast("string")
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    rows = nodes.select(F.col("graph_id").cast("bigint").alias("graph_id"), F.col("node_id").cast("int").alias("src"), F.lit(None).cast("int").alias("dst"), F.lit(None).cast("double").alias("weight"), F.col("label").cast("string").alias("label"))
    rows = rows.unionByName(edges.where("src <> dst").select(F.col("graph_id").cast("bigint").alias("graph_id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), weight.alias("weight"), label.alias("label"))).where("graph_id is not null")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "graph_id").sortWithinPartitions("graph_id")
    out = pa.schema([("graph_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for table, large in _whole(batches, BLOCK, max_rows):
            if table is None:
                yield pa.RecordBatch.from_arrays([pa.array([large], pa.int64()), pa.array([None], pa.binary())], schema=out)
                continue
            chunk, odd = _chunk(table, labelled)
            sizes = np.bincount(np.searchsorted(chunk.graph_ids, table["graph_id"].to_numpy()), minlength=len(chunk.graph_ids))
            odd |= sizes > max_rows
            if max_nodes is not None:
                odd |= np.bincount(chunk.node_graph, minlength=len(chunk.graph_ids)) > max_nodes
            if odd.any():
                left = chunk.graph_ids[odd]
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.nulls(len(left), pa.binary())], schema=out)
                table = table.filter(pa.array(~np.isin(table["graph_id"].to_numpy(), left)))
            # Pieces of one size: a batch of blocks stays small, whatever the graphs are; readers put graphs together again.
            for k in range(0, len(table), BLOCK):
                sink = pa.BufferOutputStream()
                piece = table.slice(k, BLOCK).combine_chunks()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(piece)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=out)

    blocks = settle(rows.mapInArrow(run, "graph_id long, data binary"))
    others = blocks.where("graph_id is not null").select("graph_id")
    if others.isEmpty():
        return Packed(blocks, labelled, None, None)
    others = settle(others)
    return Packed(blocks, labelled, nodes.join(others, "graph_id", "left_semi"), edges.join(others, "graph_id", "left_semi"))


def codes(values: list) -> tuple[list, np.ndarray]:
    """The distinct strings in order, and the place of each value among them."""
    found = sorted(set(values))
    at = {x: i for i, x in enumerate(found)}
    return found, np.fromiter(map(at.__getitem__, values), np.int64, len(values))


def counted(graph_ids: np.ndarray, g: np.ndarray, code: np.ndarray, names: list) -> pa.RecordBatch:
    """graph_id, pattern, cnt of occurrences (graph place, pattern code)."""
    key, cnt = np.unique(g * np.int64(max(1, len(names))) + code, return_counts=True)
    pattern = pa.array(names, pa.string()).take(pa.array(key % max(1, len(names))))
    return pa.RecordBatch.from_arrays([pa.array(graph_ids[key // max(1, len(names))], pa.int64()), pattern, pa.array(cnt, pa.int64())], names=["graph_id", "pattern", "cnt"])


def listed(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
