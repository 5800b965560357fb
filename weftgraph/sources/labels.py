"""Class-label files: a graph's file name and its class on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_class_labels(spark: SparkSession, path: str) -> DataFrame:
    """graph_id, class_label."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    name, value = F.split(F.trim("value"), r"\s+")[0], F.element_at(F.split(F.trim("value"), r"\s+"), -1)
    return lines.select(F.regexp_extract(name, r"([0-9]+)(?:\.[^.]*)?$", 1).cast("bigint").alias("graph_id"), value.cast("int").alias("class_label"))


def write_class_labels(graphs: DataFrame, path: str) -> None:
    graphs.where("class_label is not null").select(F.concat_ws(" ", "graph_name", F.col("class_label").cast("string"))).write.mode("overwrite").text(path)
