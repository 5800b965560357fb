import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def f1(spark):
    """A triangle with a tail (nodes 1:A 2:A 3:B 4:B) and a graph of two nodes, and one with an isolated node."""
    nodes = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "B"), (2, 1, "A"), (2, 2, "B"), (3, 1, "A"), (3, 2, "A"), (3, 3, "C")], "graph_id long, node_id int, label string")
    edges = spark.createDataFrame([(1, 1, 2, 1.0), (1, 1, 3, 1.0), (1, 2, 3, 1.0), (1, 3, 4, 1.0), (2, 1, 2, 1.0), (3, 1, 2, 1.0)], "graph_id long, src int, dst int, weight double")
    return nodes, edges
