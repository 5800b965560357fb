"""What all decompositions share: counts, probabilities, vocabulary and documents of patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_patterns(occurrences: DataFrame, weight: str | None = None) -> DataFrame:
    """graph_id, pattern, cnt."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return occurrences.groupBy("graph_id", "pattern").agg(n.cast("bigint").alias("cnt"))


def with_probabilities(counts: DataFrame) -> DataFrame:
    """graph_id, pattern, cnt, prob: each count as a share of its graph's."""
    return counts.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("graph_id")))


def vocabulary(counts: DataFrame) -> DataFrame:
    return counts.select("pattern").distinct()


@dataclass
class Decomposition:
    """Documents and counts of one decomposition; the classical five results follow from them."""

    docs: DataFrame
    counts: DataFrame

    @property
    def prob(self) -> DataFrame:
        return with_probabilities(self.counts)

    @property
    def vocabulary(self) -> DataFrame:
        return vocabulary(self.counts)

    @property
    def num_graphs(self) -> int:
        return self.counts.select("graph_id").distinct().count()

    def nested(self) -> DataFrame:
        """graph_id, pattern -> cnt and pattern -> prob as maps (for export)."""
        entry = lambda c: F.map_from_entries(F.collect_list(F.struct("pattern", c)))
        return self.prob.groupBy("graph_id").agg(entry("cnt").alias("graph_map"), entry("prob").alias("prob_map"))
