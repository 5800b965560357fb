"""TU-format graph datasets: parallel text files whose line numbers are the keys.

``<name>_A.txt`` (edges), ``_graph_indicator.txt`` (graph of each node), ``_graph_labels.txt`` (class of
each graph) and, where there is one, ``_node_labels.txt``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import degrees, renumber, simple_edges, valid_edges
from .derive import GraphDataset


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """line_no (from 1, dense), and the trimmed line: the only place where row order is a key."""
    lines = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0][0]))
    return spark.createDataFrame(lines, f"line_no long, {name} string").withColumn(name, F.trim(name))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system it names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_tu(spark: SparkSession, folder: str, name: str, keep_isolated: bool = False) -> GraphDataset:
    """Graphs, nodes and edges of a dataset.

    Edges between graphs are left out and mirrored rows fall together. Node numbers start at 1 in each
    graph in order of the edges; missing labels are degrees. Nodes without an edge go unless
    ``keep_isolated`` is set (they are then numbered last); graphs keep their class either way.
    """
    at = f"{folder}/{name}"
    member = numbered_lines(spark, f"{at}_graph_indicator.txt", "g").select(F.col("line_no").alias("node"), F.col("g").cast("bigint").alias("graph_id"))
    ends = F.split("e", r"\s*,\s*")
    raw = numbered_lines(spark, f"{at}_A.txt", "e").select(F.col("line_no").alias("row_no"), ends[0].cast("bigint").alias("x"), ends[1].cast("bigint").alias("y"))
    kept = valid_edges(raw.select("x", "y").distinct(), member)
    rows = raw.join(kept, ["x", "y"]).select("graph_id", F.col("x").alias("src"), F.col("y").alias("dst"), "row_no")
    ids = renumber(rows)
    if keep_isolated:
        used = ids.groupBy("graph_id").agg(F.max("node_id").alias("top"))
        rest = member.join(ids, ["graph_id", "node"], "left_anti").join(used, "graph_id", "left")
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("graph_id").orderBy("node"))
        ids = ids.unionByName(rest.select("graph_id", "node", (F.coalesce("top", F.lit(0)) + place).cast("int").alias("node_id")))
    pair = simple_edges(rows)
    edges = pair.join(ids.select("graph_id", F.col("node").alias("src"), F.col("node_id").alias("a")), ["graph_id", "src"]).join(ids.select("graph_id", F.col("node").alias("dst"), F.col("node_id").alias("b")), ["graph_id", "dst"])
    edges = edges.select("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit(1.0).alias("weight"))
    if exists(spark, f"{at}_node_labels.txt"):
        labels = numbered_lines(spark, f"{at}_node_labels.txt", "label").withColumnRenamed("line_no", "node")
        nodes = ids.join(labels, "node", "left").select("graph_id", "node_id", "label")
    else:
        nodes = ids.join(degrees(edges), ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("degree", F.lit(0)).cast("string").alias("label"))
    classes = numbered_lines(spark, f"{at}_graph_labels.txt", "c").select(F.col("line_no").alias("graph_id"), F.col("c").cast("int").alias("class_label"))
    graphs = classes.select("graph_id", F.concat(F.col("graph_id").cast("string"), F.lit(".gexf")).alias("graph_name"), "class_label")
    return GraphDataset(graphs, nodes, edges)


def format_dataset(spark: SparkSession, folder: str, name: str, out: str) -> GraphDataset:
    """Write a TU dataset as tables under ``out``; a second call finds them and changes nothing."""
    data = read_tu(spark, folder, name)
    for part in ("graphs", "nodes", "edges"):
        getattr(data, part).write.mode("ignore").parquet(f"{out}/{part}")
    return read_tables(spark, out)


def read_tables(spark: SparkSession, folder: str) -> GraphDataset:
    return GraphDataset(*(spark.read.parquet(f"{folder}/{p}") for p in ("graphs", "nodes", "edges")))
