"""Result files of parameter sweeps: parameters in the file's name, ``accuracy,std`` as its content; exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """The parameters in ``names`` (parts of the file's name between underscores), accuracy and std."""
    files = spark.read.option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    parts = F.split(F.regexp_replace("file", r"\.(txt|csv)$", ""), "_")
    numbers = F.split("value", r"\s*,\s*")
    return files.select(*[parts[i].alias(n) for i, n in enumerate(names)], numbers[0].cast("double").alias("accuracy"), numbers[1].cast("double").alias("std"))


def append_result(runs: DataFrame, path: str) -> None:
    """Rows of parameters, accuracy and std, added to a table; readers skip what is done by an anti-join."""
    runs.write.mode("append").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def adjacency_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_index (from 0), graph: the JSON of node -> {neighbors, label}, for tools that read nested dictionaries."""
    from ..operators.relational import both_ways

    near = both_ways(edges).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
    each = nodes.join(near, ["graph_id", "node_id"], "left")
    entry = F.struct(F.col("node_id").cast("string"), F.struct(F.coalesce("neighbors", F.array().cast("array<int>")).alias("neighbors"), "label"))
    return each.groupBy("graph_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m")).select((F.col("graph_id") - 1).alias("graph_index"), F.to_json("m").alias("graph"))
