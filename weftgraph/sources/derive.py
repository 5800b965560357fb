"""Graph datasets derived from relational tables.

G1: a graph for each customer; its nodes are suppliers (numbered 1.. by supplier key), joined when they
served one order; labels are the suppliers' regions, classes the customers' market segments.
G2: a graph for each user; its nodes are (event type, hour), joined by consecutive events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class GraphDataset:
    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_graph(df: DataFrame) -> DataFrame:
    """``df`` shuffled by graph into as many parts as shuffles have: what follows multiplies the rows, so the parts must not be merged by their size now."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "graph_id")


def customer_suppliers(spark: SparkSession, sf_dir: str) -> GraphDataset:
    """Orders and lines meet by order; everything after that stays where the one shuffle by graph has put it.

    Numbers are ranks over the served rows themselves, and an order's pairs come from the order's own list, so neither
    the numbers nor the pairs need a join.
    """
    # The customers of an order as a list: a key that came twice with different customers serves all of them.
    orders = _table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.collect_set(F.struct(F.col("o_custkey").cast("bigint").alias("graph_id"))).alias("of"))
    orders = orders.select("o_orderkey", F.size("of").alias("times"), F.explode("of.graph_id").alias("graph_id"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    served = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("graph_id", F.col("o_orderkey").alias("o"), "times", F.col("l_suppkey").alias("s"))
    number = F.dense_rank().over(Window.partitionBy("graph_id").orderBy(F.col("s").asc_nulls_last())).cast("int")
    placed = _by_graph(served).withColumn("node_id", number)
    region = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("s"), F.col("n_regionkey").cast("string").alias("label"))
    nodes = placed.select("graph_id", "s", "node_id").distinct().join(region, "s", "left")
    listed = placed.where("graph_id is not null and s is not null").groupBy("graph_id", "o").agg(F.first("times").alias("times"), F.array_sort(F.collect_set("node_id")).alias("ids"))
    first = listed.where(F.size("ids") > 1).select("graph_id", "times", "ids", F.posexplode("ids").alias("i", "src")).where(F.col("i") < F.size("ids") - 1)
    pairs = first.select("graph_id", "times", "src", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("dst"))
    edges = pairs.groupBy("graph_id", "src", "dst").agg(F.sum("times").cast("double").alias("weight"))
    segments = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("graph_id"), F.col("c_mktsegment").alias("segment"))
    # Five market segments: a window over the distinct names, not over the customers.
    names = segments.select("segment").distinct().withColumn("class_label", (F.dense_rank().over(Window.orderBy("segment")) - 1).cast("int"))
    served_graphs = served.select("graph_id").distinct()
    graphs = served_graphs.join(segments, "graph_id", "left").join(F.broadcast(names), "segment", "left").select("graph_id", F.concat(F.col("graph_id").cast("string"), F.lit(".gexf")).alias("graph_name"), "class_label")
    return GraphDataset(graphs, nodes.select("graph_id", "node_id", "label"), edges.select("graph_id", "src", "dst", "weight"))


def user_events(spark: SparkSession, sf_dir: str) -> GraphDataset:
    """One shuffle of the events by user; numbers and moves are windows over it."""
    step = Window.partitionBy("graph_id").orderBy(F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("graph_id"), "ts", "event_id", F.col("event_type").alias("label"), F.concat("event_type", F.lit("_"), F.hour("ts").cast("string")).alias("name"))
    number = F.dense_rank().over(Window.partitionBy("graph_id").orderBy(F.col("name").asc_nulls_last(), F.col("label").asc_nulls_last())).cast("int")
    placed = _by_graph(events).withColumn("node_id", number)
    nodes = placed.select("graph_id", "node_id", "label").distinct()
    at = F.when(F.col("name").isNotNull(), F.col("node_id"))
    moves = placed.where("graph_id is not null").select("graph_id", at.alias("node_id"), F.lead(at).over(step).alias("next")).where("next <> node_id")
    # Numbers stand in the order of the names, so the lesser name has the lesser number.
    edges = moves.groupBy("graph_id", F.least("node_id", "next").alias("src"), F.greatest("node_id", "next").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    graphs = nodes.select("graph_id").distinct().select("graph_id", F.concat(F.col("graph_id").cast("string"), F.lit(".gexf")).alias("graph_name"), (F.col("graph_id") % 2).cast("int").alias("class_label"))
    return GraphDataset(graphs, nodes, edges)


#: The same datasets as common table expressions of DuckDB's SQL: g1_nodes, g1_edges, g1_graphs, g2_...
G1_SQL = """
g1_served AS (SELECT DISTINCT o_orderkey AS o, cast(o_custkey AS bigint) AS graph_id, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
g1_ids AS (SELECT graph_id, s, cast(row_number() OVER (PARTITION BY graph_id ORDER BY s) AS integer) AS node_id FROM (SELECT DISTINCT graph_id, s FROM g1_served)),
g1_nodes AS (SELECT graph_id, node_id, cast(n_regionkey AS varchar) AS label FROM g1_ids LEFT JOIN supplier ON s = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey),
g1_pairs AS (SELECT a.graph_id, a.s AS s1, b.s AS s2, cast(count(*) AS double) AS weight FROM g1_served a JOIN g1_served b ON a.o = b.o AND a.s < b.s GROUP BY ALL),
g1_edges AS (SELECT p.graph_id, x.node_id AS src, y.node_id AS dst, weight FROM g1_pairs p JOIN g1_ids x ON p.graph_id = x.graph_id AND s1 = x.s JOIN g1_ids y ON p.graph_id = y.graph_id AND s2 = y.s),
g1_graphs AS (SELECT graph_id, graph_id || '.gexf' AS graph_name, cast(k AS integer) AS class_label FROM (SELECT DISTINCT graph_id FROM g1_ids) LEFT JOIN (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS k FROM customer) ON graph_id = c_custkey)
"""
G2_SQL = """
g2_events AS (SELECT cast(user_id AS bigint) AS graph_id, ts, event_id, event_type AS label, event_type || '_' || hour(ts) AS name FROM events),
g2_ids AS (SELECT graph_id, name, label, cast(row_number() OVER (PARTITION BY graph_id ORDER BY name) AS integer) AS node_id FROM (SELECT DISTINCT graph_id, name, label FROM g2_events)),
g2_nodes AS (SELECT graph_id, node_id, label FROM g2_ids),
g2_moves AS (SELECT * FROM (SELECT graph_id, name, lead(name) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS next FROM g2_events) WHERE next <> name),
g2_pairs AS (SELECT graph_id, least(name, next) AS n1, greatest(name, next) AS n2, cast(count(*) AS double) AS weight FROM g2_moves GROUP BY ALL),
g2_edges AS (SELECT p.graph_id, x.node_id AS src, y.node_id AS dst, weight FROM g2_pairs p JOIN g2_ids x ON p.graph_id = x.graph_id AND n1 = x.name JOIN g2_ids y ON p.graph_id = y.graph_id AND n2 = y.name),
g2_graphs AS (SELECT graph_id, graph_id || '.gexf' AS graph_name, cast(graph_id % 2 AS integer) AS class_label FROM (SELECT DISTINCT graph_id FROM g2_ids))
"""
