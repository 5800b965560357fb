"""Corpora of graph documents: vocabulary, negative sampling, training examples, documents added later.

Documents are rows (graph_id, line_no, tokens): a centre token and its context. Graphs and patterns get
numbers in order of first appearance (graphs by path, lines, places), without a sort in one task.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import dense_index, prefix_sum
from ..functions.rng import SCALE, draw, uniform

UNKNOWN = "UNK"
#: The sub-sampling threshold, the exponent of the negatives' distribution, slots of the table it stands for, negatives of an example.
SUBSAMPLE, EXPONENT, SLOTS, NEGATIVES = 1e-4, 0.5, 100_000_000, 10
#: Buckets that the slots are cut into, so that looking a slot up is an equality join.
BUCKETS = 4096
#: Patterns whose slots are broadcast at most (24 bytes each); a larger vocabulary is joined by buckets.
MAX_SLOTS = 2_000_000


def graph_rows(docs: DataFrame) -> DataFrame:
    """graph_id, graph_row: numbers from 0 in order of the file names (numbers sorted as strings)."""
    names = docs.select("graph_id").distinct().withColumn("name", F.col("graph_id").cast("string"))
    return dense_index(names, ["name"], "graph_row").select("graph_id", "graph_row")


def token_frequencies(docs: DataFrame, window: int | None = None) -> DataFrame:
    """pattern, freq, first (graph name, line, place). ``window``: the first window + 1 tokens of a line count; None: its centre, and UNK once."""
    used = F.slice("tokens", 1, 1 if window is None else window + 1)
    seen = docs.select(F.col("graph_id").cast("string").alias("g"), "line_no", F.posexplode(used).alias("place", "pattern"))
    freq = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct("g", "line_no", "place")).alias("first"))
    if window is None:
        # UNK stands after everything else.
        unknown = docs.sparkSession.range(1).select(F.lit(UNKNOWN).alias("pattern"), F.lit(1).cast("bigint").alias("freq"), F.struct(F.lit("~").alias("g"), F.lit(0).cast("int").alias("line_no"), F.lit(0).alias("place")).alias("first"))
        freq = freq.unionByName(unknown)
    return freq


def vocabulary(freq: DataFrame, min_count: int = 0) -> DataFrame:
    """pattern, pattern_id, freq, discard, neg_lo, neg_hi of the patterns of ``min_count`` uses or more.

    A pattern's negatives are the slots in [neg_lo, neg_hi).
    """
    kept = freq.where(F.col("freq") >= min_count) if min_count else freq
    ids = dense_index(kept, ["first"], "pattern_id").drop("first")
    totals = ids.agg(F.sum("freq").alias("total"), F.sum(F.pow("freq", F.lit(EXPONENT))).alias("mass"))
    share = F.lit(SUBSAMPLE) / (F.col("freq") / F.col("total"))
    slots = F.bround(F.pow("freq", F.lit(EXPONENT)) / F.col("mass") * SLOTS).cast("bigint")
    sized = ids.crossJoin(F.broadcast(totals)).select("pattern", "pattern_id", "freq", (F.sqrt(share) + share).alias("discard"), slots.alias("slots"))
    summed = prefix_sum(sized, ["pattern_id"], "slots", "neg_hi")
    return summed.select("pattern", "pattern_id", "freq", "discard", (F.col("neg_hi") - F.col("slots")).alias("neg_lo"), "neg_hi")


def add_documents(freq: DataFrame, new_docs: DataFrame, known_docs: DataFrame, window: int | None = None) -> DataFrame:
    """Frequencies after more documents came in; documents of graphs that are known already are ignored."""
    fresh = new_docs.join(known_docs.select("graph_id").distinct(), "graph_id", "left_anti")
    more = token_frequencies(fresh, window).where(F.col("pattern") != UNKNOWN if window is None else F.lit(True))
    return freq.unionByName(more).groupBy("pattern").agg(F.sum("freq").alias("freq"), F.min("first").alias("first"))


def _joined_negatives(targets: DataFrame, vocab: DataFrame, keys: list[str], avoid: str, size: int, seed: int) -> DataFrame:
    """:func:`negatives` for a vocabulary of any size: a row for each draw, an equality join on buckets of slots."""
    top = vocab.agg(F.max("neg_hi").alias("slots"))
    step = F.ceil(F.col("slots") / BUCKETS).cast("bigint")
    own = vocab.select(F.col("pattern_id").alias("_avoid"), F.col("neg_lo").alias("_lo"), (F.col("neg_hi") - F.col("neg_lo")).alias("_own"))
    asked = targets.select(*keys, F.col(avoid).cast("bigint").alias("_avoid")).join(own, "_avoid", "left").crossJoin(F.broadcast(top))
    left = F.col("slots") - F.coalesce("_own", F.lit(0))
    drawn = asked.withColumn("_left", left).where("_left > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    slot = F.floor(uniform(seed, *[F.col(k) for k in keys], F.col("_k")) * F.col("_left")).cast("bigint")
    drawn = drawn.withColumn("_slot", slot + F.when(slot >= F.col("_lo"), F.col("_own")).otherwise(F.lit(0)))
    drawn = drawn.withColumn("_bucket", F.floor(F.col("_slot") / step).cast("bigint")).select(*keys, "_k", "_slot", "_bucket")
    spans = vocab.where("neg_hi > neg_lo").crossJoin(F.broadcast(top)).select("pattern_id", "neg_lo", "neg_hi", F.explode(F.sequence(F.floor(F.col("neg_lo") / step).cast("bigint"), F.floor((F.col("neg_hi") - 1) / step).cast("bigint"))).alias("_bucket"))
    hit = drawn.join(spans, "_bucket").where((F.col("_slot") >= F.col("neg_lo")) & (F.col("_slot") < F.col("neg_hi")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "pattern_id"))), lambda x: x["pattern_id"])
    return hit.groupBy(*keys).agg(listed.alias("negatives"))


def with_negatives(examples: DataFrame, vocab: DataFrame, keys: list[str], avoid: str, size: int = NEGATIVES, seed: int = 0) -> DataFrame:
    """``examples`` with negatives array<bigint>: exactly ``size`` draws for each row, none of them the id in ``avoid``.

    Draws are hashes of the keys (which name a row) and the number of the draw, on the slots without those of the avoided
    pattern, so none has to be drawn again. A row for which no slot is left is left out. The slots of a counted, small
    vocabulary are broadcast and nothing is shuffled.
    """
    slots = vocab.select("pattern_id", "neg_lo", "neg_hi")
    if slots.limit(MAX_SLOTS + 1).count() > MAX_SLOTS:
        return examples.join(_joined_negatives(examples, vocab, keys, avoid, size, seed), keys)
    table = slots.toArrow()
    ids, lo, hi = (table[c].to_numpy().astype(np.int64) for c in ("pattern_id", "neg_lo", "neg_hi"))
    by_id, by_lo = np.argsort(ids), np.argsort(lo, kind="stable")
    by_lo = by_lo[hi[by_lo] > lo[by_lo]]
    shared = examples.sparkSession.sparkContext.broadcast((ids[by_id], lo[by_id], (hi - lo)[by_id], lo[by_lo], ids[by_lo], int(hi.max()) if len(hi) else 0))
    columns, place, key = list(examples.columns), "_place", "_key"
    asked = examples.select("*", F.col(avoid).cast("bigint").alias(place), F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit("")).alias(key))

    def run(batches):
        known, starts, sizes, edges, owners, top = shared.value
        ends = [str(k) for k in range(size)]
        for batch in batches:
            own, begin = np.zeros(len(batch), np.int64), np.full(len(batch), np.iinfo(np.int64).max)
            wanted, given = batch.column(place).fill_null(-1).to_numpy(zero_copy_only=False), batch.column(place).is_valid().to_numpy(zero_copy_only=False)
            if len(known):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                met = given & (known[at] == wanted)
                own[met], begin[met] = sizes[at[met]], starts[at[met]]
            left = top - own
            batch = batch.select(columns + [key])
            if (left <= 0).any():
                batch, own, begin, left = batch.filter(pa.array(left > 0)), own[left > 0], begin[left > 0], left[left > 0]
            drawn = b"".join([md5((x + e).encode()).digest() for x in batch.column(key).to_pylist() for e in ends])
            u = ((np.frombuffer(drawn, ">u4")[::4] >> 4) / SCALE).reshape(-1, size)
            slot = np.floor(u * left[:, None].astype(float)).astype(np.int64)
            slot += np.where(slot >= begin[:, None], own[:, None], 0)
            found = owners[np.searchsorted(edges, slot.ravel(), "right") - 1] if len(slot) else np.zeros(0, np.int64)
            negs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, size, dtype=np.int32)), pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), negs], names=[*columns, "negatives"])

    return asked.mapInArrow(run, T.StructType([*examples.schema.fields, T.StructField("negatives", T.ArrayType(T.LongType()))]))


def negatives(targets: DataFrame, vocab: DataFrame, keys: list[str], avoid: str, size: int = NEGATIVES, seed: int = 0) -> DataFrame:
    """``keys`` and negatives of :func:`with_negatives`."""
    return with_negatives(targets.select(*dict.fromkeys([*keys, avoid])), vocab, keys, avoid, size, seed).select(*keys, "negatives")


def numbered_lines(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """graph_id, line_no, ids: the lines as pattern numbers; tokens outside the vocabulary are left out."""
    places = docs.select("graph_id", "line_no", F.posexplode("tokens").alias("place", "pattern"))
    known = places.join(vocab.select("pattern", "pattern_id"), "pattern")
    return known.groupBy("graph_id", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pattern_id"))), lambda x: x["pattern_id"]).alias("ids"))


def pvdbow_pairs(docs: DataFrame, vocab: DataFrame, graphs: DataFrame) -> DataFrame:
    """graph_id, line_no, target (the graph's number), context (its centre's id)."""
    centres = docs.select("graph_id", "line_no", F.element_at("tokens", 1).alias("pattern"))
    return centres.join(vocab.select("pattern", "pattern_id"), "pattern").join(graphs, "graph_id").select("graph_id", "line_no", F.col("graph_row").alias("target"), F.col("pattern_id").alias("context"))


def skipgram_pairs(docs: DataFrame, vocab: DataFrame, window: int, seed: int | None = None) -> DataFrame:
    """graph_id, line_no, i, j, target, context: all ordered pairs of a line's first window + 1 tokens; with a seed, one of each line."""
    short = docs.select("graph_id", "line_no", F.slice("tokens", 1, window + 1).alias("tokens"))
    lines = numbered_lines(short, vocab)
    first = lines.select("graph_id", "line_no", "ids", F.posexplode("ids").alias("i", "target"))
    pairs = first.select("graph_id", "line_no", "i", "target", F.posexplode("ids").alias("j", "context")).where("i <> j")
    if seed is None:
        return pairs.select("graph_id", "line_no", "i", "j", "target", "context")
    order = F.struct(draw(seed, F.col("graph_id"), F.col("line_no"), F.col("i"), F.col("j")), "i", "j")
    return pairs.groupBy("graph_id", "line_no").agg(F.min_by(F.struct("i", "j", "target", "context"), order).alias("x")).select("graph_id", "line_no", "x.*")


def padded(contexts: Column, size: int) -> Column:
    """The contexts, repeated in turn up to ``size``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.element_at(contexts, (k % F.size(contexts) + 1).cast("int")))


def cbow_examples(docs: DataFrame, vocab: DataFrame, window: int) -> DataFrame:
    """graph_id, line_no, i, target, contexts: each of the first window + 1 tokens with the others; lines of one token give none."""
    short = docs.select("graph_id", "line_no", F.slice("tokens", 1, window + 1).alias("tokens"))
    lines = numbered_lines(short, vocab).where(F.size("ids") > 1)
    each = lines.select("graph_id", "line_no", "ids", F.posexplode("ids").alias("i", "target"))
    others = F.filter("ids", lambda x, k: k != F.col("i"))
    return each.select("graph_id", "line_no", "i", "target", padded(others, window).alias("contexts"))


def pvdm_examples(docs: DataFrame, vocab: DataFrame, graphs: DataFrame, window: int) -> DataFrame:
    """As :func:`cbow_examples`, with the graph's number."""
    return cbow_examples(docs, vocab, window).join(graphs, "graph_id").select("graph_id", "line_no", "i", F.col("graph_row").alias("graph"), "target", "contexts")


def word_order_counts(docs: DataFrame) -> DataFrame:
    """Lines and tokens of each graph's document."""
    return docs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"))


def latest(docs: DataFrame) -> DataFrame:
    """One row for each (graph, line): the longest sentence where a line came twice."""
    w = Window.partitionBy("graph_id", "line_no").orderBy(F.size("tokens").desc(), F.array_join("tokens", " "))
    return docs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
