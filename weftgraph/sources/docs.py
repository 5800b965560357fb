"""Graph documents: text files of sentences, or tables of token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def suffix(kind: str, **p) -> str:
    """The file suffix that names a decomposition and its parameters."""
    if kind == "wl":
        return f".wld{p['depth']}"
    if kind == "sp":
        return ".spp"
    if kind == "graphlet":
        return f".graphlet_ng_{p['n']}_ss_{p['samples']}"
    if kind == "rw":
        return f".rw{p['length']}"
    if kind == "awe":
        return f".awe_{p['length']}_{p.get('setting') or 'allpaths'}"
    raise ValueError(f"no such kind of document: {kind}")


def list_files(spark: SparkSession, folder: str, extension: str, max_files: int = 0) -> DataFrame:
    """path of the files below ``folder`` that end so, in order; the first ``max_files`` (0: all)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(folder).select("path").distinct().orderBy("path")
    return files.limit(max_files) if max_files else files


def read_documents(spark: SparkSession, folder: str, extension: str, max_files: int = 0) -> DataFrame:
    """graph_id, line_no (from 0, in the order of the file), tokens."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if max_files:
        texts = texts.join(F.broadcast(texts.select("path").distinct().orderBy("path").limit(max_files)), "path", "left_semi")
    lines = texts.select(F.regexp_extract("path", r"([0-9]+)\.[^/]*$", 1).cast("bigint").alias("graph_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "").select("graph_id", "line_no", F.split(F.trim("line"), r"\s+").alias("tokens"))


def sentences(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """graph_id, doc_kind, line_no, tokens: a table of texts as ready-made graph documents, a sentence a line."""
    lines = texts.select(F.col(id_col).cast("bigint").alias("graph_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "").select("graph_id", F.lit("text").alias("doc_kind"), "line_no", F.split(F.trim("line"), "[ \t]+").alias("tokens"))


def write_documents(docs: DataFrame, folder: str) -> None:
    """``folder``/doc_kind=<kind>/graph_id=<n>/: the sentences of each graph, lines in order."""
    lines = docs.select("doc_kind", "graph_id", "line_no", F.array_join("tokens", " ").alias("value")).repartition("doc_kind", "graph_id").sortWithinPartitions("doc_kind", "graph_id", "line_no")
    lines.drop("line_no").write.mode("overwrite").partitionBy("doc_kind", "graph_id").text(folder)


def first_lines(docs: DataFrame, n: int) -> DataFrame:
    """The first n lines of each document (a report)."""
    w = Window.partitionBy("graph_id").orderBy("line_no")
    return docs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
