"""A bounded sample of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> list[tuple[int, str, int]]:
    """(doc_id, whole text, label) of at most ``per_class`` rows for each label 0 and 1, outside the held-out fold.

    The rows with the least hash of their id are taken, so the sample does not depend on how the tables
    are stored. Only ids (bounded by 2 * per_class) are broadcast; rows with a null label or id are not used.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(crc_bucket(F.col("doc_id"), modulus) != held_out)
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.lit(label), F.col("doc_id"))
    picked = None
    for value in (0, 1):
        one = usable.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").dropDuplicates(["doc_id"])
    return sorted((r["doc_id"], r["text"], r["label"]) for r in found.toLocalIterator())
