"""Embedding files: one JSON object, name -> vector; and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """name, vector."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<float>>")).alias("name", "vector"))


def embeddings_json(embeddings: DataFrame) -> DataFrame:
    """One row: the whole table as a JSON object (its size is the caller's choice; large tables stay tables)."""
    return embeddings.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "vector"))))).alias("value"))


def write_embeddings(embeddings: DataFrame, path: str, as_json: bool = True) -> None:
    if as_json:
        embeddings_json(embeddings).coalesce(1).write.mode("overwrite").text(path)
    else:
        embeddings.write.mode("overwrite").parquet(path)


def with_classes(embeddings: DataFrame, class_labels: DataFrame) -> DataFrame:
    """graph_id, vector, class_label; a graph's number is taken from the name of its document."""
    ids = embeddings.select(F.regexp_extract("name", r"([0-9]+)(?:\.[^/]*)?$", 1).cast("bigint").alias("graph_id"), "vector")
    return ids.join(class_labels.select("graph_id", "class_label"), "graph_id")
