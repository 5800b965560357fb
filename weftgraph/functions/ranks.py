"""Dense 0-based ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` (rows distinct in ``order``) with the rank of each row in that order, from ``start``.

    Rows are range-partitioned; each task numbers its own rows, and the sizes of the partitions before it
    (one number for each partition, broadcast) are added.
    """
    parted = settle(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parted.join(F.broadcast(offset), "_part").withColumn(name, (own + F.col("_before") + start).cast("bigint")).drop("_part", "_before")


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with each row, in that order; one task sees one range of rows."""
    parted = settle(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parted.join(F.broadcast(before), "_part").withColumn(name, (own + F.col("_before")).cast("bigint")).drop("_part", "_before")
