"""GEXF files, one graph each; the file's stem is the graph's number."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .derive import GraphDataset
from .labels import read_class_labels


def _files(spark: SparkSession, folder: str, max_files: int) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gexf").text(folder, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value")
    if max_files:
        files = files.join(F.broadcast(files.select("path").distinct().orderBy("path").limit(max_files)), "path", "left_semi")
    return files.select(F.regexp_extract("path", r"([0-9]+)\.gexf$", 1).cast("bigint").alias("graph_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("graph_name"), "value")


def _attribute(element, name: str):
    """The value of an attribute in either kind of quotes, with its character references read; empty without it."""
    pattern = rf"""\b{name}=(?:"([^"]*)"|'([^']*)')"""
    value = F.concat(F.regexp_extract(element, pattern, 1), F.regexp_extract(element, pattern, 2))
    for reference, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#9;", "\t"), ("&#10;", "\n"), ("&#13;", "\r"), ("&amp;", "&")):
        value = F.replace(value, F.lit(reference), F.lit(character))
    return value


def read_gexf(spark: SparkSession, folder: str, label: str = "Label", labels_file: str | None = None, max_files: int = 0) -> GraphDataset:
    """Graphs, nodes and edges of all files below ``folder`` (the first ``max_files`` in path order, 0: all).

    ``label``: title of the node attribute that holds the label. Node numbers are the files' own ids when
    these are whole numbers, else their places.
    """
    files = _files(spark, folder, max_files)
    declared = F.array_join(F.regexp_extract_all("value", F.lit(r"(?s)<attributes\b[^>]*\bclass=[\"']node[\"'][^>]*>.*?</attributes>"), F.lit(0)), "")
    titled = F.filter(F.regexp_extract_all(declared, F.lit(r"<attribute\b[^>]*>"), F.lit(0)), lambda a: _attribute(a, "title") == F.lit(label))
    for_id = _attribute(F.get(titled, F.lit(0)), "id")
    # One path for the attribute of all nodes would lose the nodes without it, so nodes are read piece by piece.
    pieces = F.regexp_extract_all("value", F.lit(r"(?s)<node\b[^>]*?(?:/>|>.*?</node>)"), F.lit(0))
    parts = files.select("graph_id", for_id.alias("attr"), F.posexplode(pieces).alias("place", "piece"))
    own = _attribute(F.regexp_extract("piece", r"<node\b[^>]*", 0), "id")
    values = F.regexp_extract_all("piece", F.lit(r"<attvalue\b[^>]*>"), F.lit(0))
    mine = F.filter(values, lambda v: _attribute(v, "for") == F.col("attr"))
    got = F.when(F.size(mine) > 0, _attribute(F.element_at(mine, 1), "value"))
    raw = parts.select("graph_id", own.alias("xml_id"), got.alias("label"), F.when(own.rlike("^[0-9]+$"), own.cast("int")).otherwise(F.col("place") + 1).alias("node_id"))
    links = files.select("graph_id", F.explode(F.regexp_extract_all("value", F.lit(r"<edge\b[^>]*>"), F.lit(0))).alias("piece"))
    attr = lambda n: _attribute(F.col("piece"), n)
    weight = F.when(attr("weight") != "", attr("weight").cast("double")).otherwise(F.lit(1.0))
    links = links.select("graph_id", attr("source").alias("s"), attr("target").alias("t"), weight.alias("weight"))
    ids = raw.select("graph_id", "xml_id", "node_id")
    edges = links.join(ids.select("graph_id", F.col("xml_id").alias("s"), F.col("node_id").alias("a")), ["graph_id", "s"]).join(ids.select("graph_id", F.col("xml_id").alias("t"), F.col("node_id").alias("b")), ["graph_id", "t"])
    edges = edges.groupBy("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("weight").alias("weight"))
    graphs = files.select("graph_id", "graph_name")
    if labels_file:
        graphs = graphs.join(read_class_labels(spark, labels_file), "graph_id", "left")
    else:
        graphs = graphs.withColumn("class_label", F.lit(None).cast("int"))
    return GraphDataset(graphs, raw.select("graph_id", "node_id", "label"), edges)


def gexf_text(nodes: list[tuple[int, str | None]], edges: list[tuple[int, int, float]]) -> str:
    """One graph as a GEXF document."""
    own = lambda n, v: f"      <node id={quoteattr(str(n))} label={quoteattr(str(n))}>" + (f"<attvalues><attvalue for=\"0\" value={quoteattr(v)} /></attvalues>" if v is not None else "") + "</node>"
    link = lambda i, s, t, w: f'      <edge id="{i}" source={quoteattr(str(s))} target={quoteattr(str(t))} weight="{w}" />'
    return "\n".join(
        ["<?xml version='1.0' encoding='utf-8'?>", '<gexf version="1.1" xmlns="http://www.gexf.net/1.1draft">', '  <graph defaultedgetype="undirected" mode="static">', '    <attributes class="node" mode="static"><attribute id="0" title="Label" type="string" /></attributes>', "    <nodes>"]
        + [own(n, v) for n, v in sorted(nodes)]
        + ["    </nodes>", "    <edges>"]
        + [link(i, *e) for i, e in enumerate(sorted(edges))]
        + ["    </edges>", "  </graph>", "</gexf>", ""]
    )


def gexf_rows(data: GraphDataset) -> DataFrame:
    """graph_id, text of every graph's document."""
    nodes = data.nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "label")).alias("nodes"))
    edges = data.edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "weight")).alias("edges"))
    both = nodes.join(edges, "graph_id", "left")

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            texts = [gexf_text([(x["node_id"], x["label"]) for x in n], [(x["src"], x["dst"], x["weight"]) for x in (e if e is not None else [])]) for n, e in zip(pdf["nodes"], pdf["edges"], strict=True)]
            yield pd.DataFrame({"graph_id": pdf["graph_id"], "text": texts})

    return both.mapInPandas(run, "graph_id long, text string")


def write_gexf(data: GraphDataset, folder: str) -> None:
    """``folder``/graph_id=<n>/... : a text file for each graph, through Spark's writer."""
    gexf_rows(data).write.mode("overwrite").partitionBy("graph_id").text(folder)
