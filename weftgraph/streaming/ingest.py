"""Documents that arrive while the corpus grows: a stream of sentences into a vocabulary table.

Every micro-batch is merged into a new version of the frequency table under ``store``/v=<n>; a batch that
is run again after a failure finds its version written and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import token_frequencies
from ..sources.tu import exists

SENTENCES = "graph_id long, line_no int, tokens array<string>"


def read_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (graph_id, line_no, tokens) from Parquet files that are added to a folder."""
    return spark.readStream.schema(SENTENCES).parquet(folder)


def _frequencies(spark: SparkSession, store: str, version: int) -> DataFrame | None:
    return spark.read.parquet(f"{store}/v={version}/freq") if version >= 0 and exists(spark, f"{store}/v={version}/_done") else None


def merge_batch(batch: DataFrame, version: int, store: str, window: int | None) -> None:
    """Frequencies of all documents up to and with this batch; graphs that are known already are ignored."""
    spark = batch.sparkSession
    if exists(spark, f"{store}/v={version}/_done"):
        return
    before = _frequencies(spark, store, version - 1)
    known = spark.read.parquet(f"{store}/v={version - 1}/graphs") if before is not None else None
    fresh = batch if known is None else batch.join(known, "graph_id", "left_anti")
    freq = token_frequencies(fresh, window)
    if before is not None:
        keep = freq.where("pattern <> 'UNK'") if window is None else freq
        freq = before.unionByName(keep).groupBy("pattern").agg(F.sum("freq").alias("freq"), F.min("first").alias("first"))
    graphs = batch.select("graph_id").distinct()
    freq.write.mode("overwrite").parquet(f"{store}/v={version}/freq")
    (graphs if known is None else graphs.union(known).distinct()).write.mode("overwrite").parquet(f"{store}/v={version}/graphs")
    spark.range(1).write.mode("overwrite").parquet(f"{store}/v={version}/_done")


def ingest(stream: DataFrame, store: str, checkpoint: str, window: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start merging the stream into ``store``; ``available_now``: stop when what is there has been read."""
    writer = stream.writeStream.foreachBatch(lambda batch, n: merge_batch(batch, n, store, window)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, store: str) -> DataFrame:
    """The newest complete frequency table."""
    n = 0
    while exists(spark, f"{store}/v={n}/_done"):
        n += 1
    return spark.read.parquet(f"{store}/v={n - 1}/freq")


def pattern_rates(stream: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Patterns a window of event time, late rows up to ``delay`` behind counted (rows: ts, pattern)."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "pattern").agg(F.count(F.lit(1)).alias("cnt"))
