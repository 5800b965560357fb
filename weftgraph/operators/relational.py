"""Relational building blocks: from raw edge and label tables to graphs, and from graphs to classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_edges(raw: DataFrame, membership: DataFrame) -> DataFrame:
    """graph_id, x, y of the edges whose ends lie in one graph. raw: x, y; membership: node, graph_id.

    Merge joins at every size: the size of compressed files says little about that of a broadcast table of all nodes.
    """
    x = membership.select(F.col("node").alias("x"), F.col("graph_id").alias("gx"))
    y = membership.select(F.col("node").alias("y"), F.col("graph_id").alias("gy"))
    return raw.join(x.hint("merge"), "x").join(y.hint("merge"), "y").where("gx = gy").select(F.col("gx").alias("graph_id"), "x", "y")


def simple_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row for each undirected edge, smaller end first: mirrored and repeated rows fall together."""
    return edges.select("graph_id", F.least(src, dst).alias(src), F.greatest(src, dst).alias(dst)).distinct()


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Every edge in both directions; a self-loop once."""
    mirrored = edges.where("src <> dst").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), *extra)
    return edges.select("graph_id", "src", "dst", *extra).unionByName(mirrored)


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, degree; a self-loop counts twice."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))


def label_or_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose missing labels are their degrees."""
    return nodes.join(degrees(edges), ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("label", F.coalesce("degree", F.lit(0)).cast("string")).alias("label"))


def renumber(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """graph_id, node, node_id: node numbers 1.. in each graph, in order of first appearance (ties by node).

    ``edges`` has graph_id, src, dst and row_no (the place of the edge in its file).
    """
    ends = edges.select("graph_id", F.posexplode(F.array("src", "dst")).alias("side", "node"), "row_no")
    first = ends.groupBy("graph_id", "node").agg(F.min(F.struct("row_no", "side")).alias("first"))
    by = [order] if order is not None else ["first", "node"]
    return first.select("graph_id", "node", F.row_number().over(Window.partitionBy("graph_id").orderBy(*by)).cast("int").alias("node_id"))


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that have an edge (a dataset read from edges alone has no others)."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(ends, ["graph_id", "node_id"], "left_semi")


def with_class(graphs: DataFrame, class_labels: DataFrame) -> DataFrame:
    """graph_id, class_label of every graph that has a class."""
    return graphs.select("graph_id").join(class_labels.select("graph_id", "class_label"), "graph_id")


def kernel_rows(graphs: DataFrame) -> DataFrame:
    """graph_id, row_id (0-based place of the graph's file in path order), class_label."""
    from ..functions.ranks import dense_index

    rows = dense_index(graphs.select("graph_name", "graph_id", "class_label").where("class_label is not null"), ["graph_name"], "row_id")
    return rows.select("graph_id", "row_id", "class_label")


def first_files(files: DataFrame, max_files: int = 0, column: str = "path") -> DataFrame:
    """Distinct paths in order; the first ``max_files`` (0: all)."""
    ordered = files.select(column).distinct().orderBy(column)
    return ordered.limit(max_files) if max_files else ordered


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``work`` that have no result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def grid(spark, **values) -> DataFrame:
    """All combinations of parameter values (a few thousand at most, by construction)."""
    out = None
    for name, options in values.items():
        one = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, options))).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
