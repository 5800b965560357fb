"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item counts as contained in a document when at least ``threshold`` of its distinct five-word
shingles occur there. Items are parted by the size of their shingle sets (powers of two). Of every item
the sketch is its bottom-k MinHash: the k smallest of its shingle hashes, k = the most shingles that an
item of that part may lack, plus one. A document that contains the item therefore holds at least one
hash of the sketch - for every document length, since the document's whole set is looked up, not its
own minima. Candidates are then verified on the item's whole set, in the same task.

The sketches and sets of the items go to every task when they are small (BROADCAST_SHINGLES, checked);
a larger benchmark is joined by hash instead, with the same result.

Shingles are 64-bit hashes: a shingle of an item is found in a document of n words by mistake with probability n / 2**64.

Defined results: items without words match nothing and items of fewer than five words are one shingle;
null and empty texts contain nothing; every row is judged by its own text, so rows that share an id, or have
none, differ as their texts do; repeated items give a match each and are counted once for each id; extra columns
are kept or ignored, whatever their names; an empty benchmark or document table gives no matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import map_arrow, materialize, rows
from .wordhash import shingle_hashes, shingle_sets, words_of

THRESHOLD, K = 0.75, 5
#: Shingles of all items up to which they are broadcast (16 bytes each: 64 MB).
BROADCAST_SHINGLES = 4_000_000

def _needed(n: int, threshold: float) -> int:
    """Least number of an item's n shingles that makes it contained."""
    return max(1, int(np.ceil(round(threshold * n, 9))))


def sketch_size(n: int, threshold: float) -> int:
    """k of an item with n shingles: that of the largest item of its size partition."""
    top = 1 << (n - 1).bit_length()
    return min(n, top - _needed(top, threshold) + 1)


class Index:
    """Sketch hashes sorted, with the items they belong to; items' whole sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.items, self.threshold = [x for x in items if len(x[1])], threshold
        parts = [s[: sketch_size(len(s), threshold)] for _, s in self.items]
        hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def search(self, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, shingles found, item's shingles) of all items contained in a document's shingles (any order)."""
        if not len(self.hashes) or not len(doc):
            return []
        lo = np.searchsorted(self.hashes, doc, "left")
        hit = (lo < len(self.hashes)) & (self.hashes[np.minimum(lo, len(self.hashes) - 1)] == doc)
        if not hit.any():
            return []
        lo = lo[hit]
        hi = np.searchsorted(self.hashes, doc[hit], "right")
        candidates = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True)]))
        whole, out = np.unique(doc), []
        for c in candidates.tolist():
            item, s = self.items[c]
            n = len(np.intersect1d(s, whole, assume_unique=True))
            if n >= _needed(len(s), self.threshold):
                out.append((item, n, len(s)))
        return out


def _item_sets(batches):
    for ids, texts in rows(batches, "item_id", "text"):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["item_id", "shingles"])


FOUND = "array<struct<item_id: bigint, n_found: bigint, n_item: bigint>>"


def with_found(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """row (a struct of the document's columns) and found: the test items that the row's text contains."""
    packed = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"))
    items = materialize(map_arrow(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), _item_sets, "item_id long, shingles binary"), "items")
    total = items.agg(F.sum(F.octet_length("shingles")).alias("b")).first()["b"] or 0
    if total // 8 > broadcast_shingles:
        return _found_by_join(packed, items, threshold)
    index = docs.sparkSession.sparkContext.broadcast([(r["item_id"], np.frombuffer(r["shingles"], np.uint64)) for r in items.collect()])
    kind = to_arrow_type(StructType.fromDDL(f"found {FOUND}")["found"].dataType)

    def run(batches):
        find = Index(index.value, threshold)
        for batch in batches:
            texts = pc.struct_field(batch.column(0), "text").to_pylist()
            found = [[{"item_id": i, "n_found": n, "n_item": m} for i, n, m in find.search(shingle_hashes(w, K))] for w in words_of(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["row", "found"])

    return map_arrow(packed, run, StructType([*packed.schema.fields, *StructType.fromDDL(f"found {FOUND}").fields]))


def _found_by_join(packed: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same for a benchmark of any size: sketches meet rows by hash, candidates are counted by hash."""

    def sketches(batches):
        for ids, sets in rows(batches, "item_id", "shingles"):
            s = [np.frombuffer(b, np.uint64) for b in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) for x in s], pa.int64()),
                    pa.array([_needed(max(1, len(x)), threshold) for x in s], pa.int64()),
                    pa.array([x[: sketch_size(len(x), threshold)].astype(np.int64) if len(x) else [] for x in s], pa.list_(pa.int64())),
                    pa.array([x.astype(np.int64) for x in s], pa.list_(pa.int64())),
                ],
                names=["item_id", "n_item", "needed", "sketch", "whole"],
            )

    def doc_sets(batches):
        for ns, texts in rows(batches, "n", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int64()), pa.array([s.astype(np.int64) for s in shingle_sets(texts)], pa.list_(pa.int64()))], names=["n", "h"])

    numbered = materialize(packed.withColumn("n", F.monotonically_increasing_id()), "numbered")
    sk = materialize(map_arrow(items, sketches, "item_id long, n_item long, needed long, sketch array<long>, whole array<long>").withColumn("item", F.monotonically_increasing_id()), "sketches")
    hashed = map_arrow(numbered.select("n", "row.text"), doc_sets, "n long, h array<long>").select("n", F.explode("h").alias("h"))
    candidates = materialize(hashed.join(sk.select("item", F.explode("sketch").alias("h")), "h").select("n", "item").distinct(), "candidates")
    met = hashed.join(candidates.select("n").distinct(), "n", "left_semi").join(sk.select("item", F.explode("whole").alias("h")), "h")
    counted = met.join(candidates, ["n", "item"], "left_semi").groupBy("n", "item").agg(F.count_distinct("h").alias("n_found"))
    found = counted.join(sk.select("item", "item_id", "n_item", "needed"), "item").where("n_found >= needed").groupBy("n").agg(F.collect_list(F.struct("item_id", "n_found", "n_item")).alias("found"))
    return numbered.join(found, "n", "left").select("row", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_found, n_item and containment for each row and each test item that it contains."""
    found = with_found(docs, benchmark, threshold, broadcast_shingles).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.explode("found").alias("f"))
    return found.select("doc_id", "f.item_id", "f.n_found", "f.n_item", (F.col("f.n_found") / F.col("f.n_item")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows, all columns, whose text contains no test item."""
    return with_found(docs, benchmark, threshold, broadcast_shingles).where(F.size("found") == 0).select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, n_items, item_ids (distinct, ascending), the highest containment and contaminated of every row; no items: an empty list and 0."""
    found = with_found(docs.select("doc_id", "text"), benchmark, threshold, broadcast_shingles)
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["item_id"])))
    highest = F.array_max(F.transform("found", lambda f: f["n_found"] / f["n_item"]))
    out = found.select(F.col("row.doc_id").cast("long").alias("doc_id"), ids.alias("item_ids"), F.coalesce(highest, F.lit(0.0)).alias("containment"), (F.size("found") > 0).alias("contaminated"))
    return out.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "containment", "contaminated")
