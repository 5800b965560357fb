"""Line dedup by winnowing: of passages that occur more than once, all but the first occurrence go.

1. Lines. A line is LINE consecutive words (A-Z lowered), one begins at every word. So equal passages have
   equal lines wherever they stand in a paragraph and however it is wrapped.
2. Winnowing. Of every WINDOW neighbouring line hashes the smallest are fingerprints. A repeated run of
   LINE + WINDOW - 1 words holds one for certain, and its fingerprints are at most WINDOW words apart.
3. Positions. Fingerprints are counted (pre-aggregated in each task), those of one place only dropped. Each
   other occurrence meets the first one (least doc_id, then position) and never the others, so a passage in n
   documents gives n - 1 matches. Fingerprints with more than one in HOT_SHARE of all occurrences - at
   most HOT_SHARE of them - are joined by broadcast, so that no task holds a hot one.
4. Extension. The words around matched fingerprints (32-bit hashes) are compared both ways, word by word, up to the first that
   differs. They reach to the next match with the same shift, or so far that there must be one.
5. Joined ranges of LEAST_WORDS words or more are deleted where they occur later.

Texts are shuffled twice, to the places asked for and to the ranges to delete, as one Zstandard frame each;
by merge joins at every size, since a broadcast would put two Python workers in one task.

So a passage of LEAST_WORDS words that stands in two documents, and of which no line stands anywhere before,
goes from the second, to the word; a line that also stands earlier is compared with that place. Repeats
of fewer words stay, whole short lines too. Nothing goes that was not there before: each deleted word lies in a
stretch of LINE words or more that equals an earlier one (a word hash of 32 bits, looked at where a stretch ends, is wrong once in 4e9 ends).

Defined results: a null text stays null and an empty one empty; texts are otherwise changed only by the
deletion of whole runs with the white space after them; a document that repeats others entirely keeps its
row, with what is left of its text; rows of one doc_id with different texts are documents of their own, in the order
of a hash of their texts; rows with equal id and text are one document and get the same result; null ids keep their
texts and are no one's first occurrence; extra columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, materialize, rows, squeeze, unsqueeze
from .wordhash import GOLDEN, mix, words_of

LINE, WINDOW, LEAST_WORDS = 16, 30, 45
#: Words that are compared before and after a fingerprint: past them a longer run has another one.
BEFORE, AFTER = WINDOW, LINE + WINDOW
HOT_SHARE = 1000
#: Words between the first and the last match that are compared as one stretch, so that broadcast stretches are bounded (3 kB each).
LONGEST = 600


def line_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the LINE words (a power of two) from every word on."""
    out, span = words, 1
    while span < LINE and len(out) > span:
        out = out[:-span] + mix(out[span:] * np.uint64(GOLDEN) + np.uint64(span))
        span *= 2
    return mix(out) if span == LINE else out[:0]


def sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Places of the line hashes that are smallest in some window (all of them on ties); none in a text without a whole window."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64)
    low = sliding(hashes, WINDOW, np.minimum)
    # The highest of the minima of all windows around a place is its own value where it is a minimum.
    edge = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, low, edge]), WINDOW, np.maximum) == hashes)


def _marks(batches):
    for ids, keys, texts in rows(batches, "doc_id", "key", "text"):
        found = []
        for w in words_of(texts):
            h = line_hashes(w)
            at = fingerprints(h)
            found.append((h[at].astype(np.int64), at.astype(np.int32)))
        cuts = np.concatenate([[0], np.cumsum([len(at) for _, at in found])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([f[k] for f in found]) if found else [], t)) for k, t in ((0, pa.int64()), (1, pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int32()), *lists], names=["doc_id", "key", "fp", "at"])


CHAIN = "doc_id long, key int, at array<int>, d0 long, k0 int, a0 int, end int"


def _chains(batches):
    """Matches of a document with the same shift to the same source, no further apart than a comparison reaches, as one row of at most LONGEST words."""
    for batch in batches:
        column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "key", "matches")}
        lists = column["matches"]
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at, d0, k0, a0 = (x.to_numpy() for x in lists.flatten().flatten())
        order = np.lexsort((at, at - a0, k0, d0, row))
        row, at, d0, k0, a0 = (x[order] for x in (row, at, d0, k0, a0))
        same = (row[1:] == row[:-1]) & (d0[1:] == d0[:-1]) & (k0[1:] == k0[:-1]) & (at[1:] - a0[1:] == at[:-1] - a0[:-1]) & (at[1:] - at[:-1] <= AFTER)
        start = np.flatnonzero(np.concatenate([[True], ~same])[: len(at)])
        first = np.repeat(at[start], np.diff(np.append(start, len(at))))
        part = (at - first) // LONGEST
        cut = np.concatenate([[True], ~same | (part[1:] != part[:-1])])[: len(at)]
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(at)) - 1 if len(start) else start
        which = row[start]
        yield pa.RecordBatch.from_arrays(
            [
                column["doc_id"].take(pa.array(which)),
                column["key"].take(pa.array(which)),
                pa.ListArray.from_arrays(pa.array(np.append(start, len(at)).astype(np.int32)), pa.array(at, pa.int32())),
                *(pa.array(x, t) for x, t in ((d0[start], pa.int64()), (k0[start], pa.int32()), (a0[start], pa.int32()), (a0[stop], pa.int32()))),
            ],
            names=["doc_id", "key", "at", "d0", "k0", "a0", "end"],
        )


STRETCH = "doc_id long, key int, at array<int>, d0 long, k0 int, a0 int, end int, hot boolean, before int, words binary"


def _words(batches):
    """The words of each asked-for stretch of a document: from BEFORE ahead of its first place to AFTER past its last.

    A chain is asked for by its places, a source (no places) by d0, k0, a0 and end, which are its own.
    """
    for batch in batches:
        ids, keys, texts, asked = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "key", "text", "asked"))
        per_doc = np.diff(asked.offsets.to_numpy())
        at, d0, k0, a0, end, hot = asked.flatten().flatten()
        places, cuts = at.flatten().to_numpy(), at.offsets.to_numpy()
        cuts = cuts - cuts[0]
        own = np.diff(cuts) > 0
        first, last = a0.to_numpy().copy(), end.to_numpy().copy()
        first[own], last[own] = places[cuts[:-1][own]], places[cuts[1:][own] - 1]
        parts, sizes, k = [], [], 0
        for w, n in zip(words_of(unsqueeze(texts)), per_doc.tolist(), strict=True):
            lo, hi = np.maximum(first[k : k + n] - BEFORE, 0), np.minimum(last[k : k + n] + AFTER, len(w))
            parts.append((w >> np.uint64(32)).astype(np.uint32)[_spans(lo, hi - lo)])
            sizes.append(hi - lo)
            k += n
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int32) * 4
        data = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        which = pa.array(np.repeat(np.arange(len(per_doc)), per_doc))
        before = pa.array(np.minimum(first, BEFORE).astype(np.int32))
        names = ["doc_id", "key", "at", "d0", "k0", "a0", "end", "hot", "before", "words"]
        yield pa.RecordBatch.from_arrays([ids.take(which), keys.take(which), at, d0, k0, a0, end, hot, before, words], names=names)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of every span, one after another."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def _flat(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 32-bit words of a column of strings of them; start and length of each string."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(data, np.uint32, count=int(ends[-1])) if data is not None and len(column) else np.empty(0, np.uint32), ends[:-1], np.diff(ends)


def _extend(batches):
    """The stretches on which a chain and its source agree, around the chain's places; LINE words or more."""
    for batch in batches:
        ids, keys, at, before, words, before0, words0 = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "key", "at", "before", "words", "before0", "words0"))
        (x, start, size), (y, start0, size0) = _flat(words), _flat(words0)
        before, before0 = before.to_numpy().astype(np.int64), before0.to_numpy().astype(np.int64)
        back = np.minimum(before, before0)
        n = np.minimum(size - (before - back), size0 - (before0 - back)).astype(np.int64)
        # Rows one after another, each with a word that differs at its end.
        edge = np.concatenate([[0], np.cumsum(n + 1)])
        same = np.zeros(int(edge[-1]), bool)
        same[_spans(edge[:-1], n)] = x[_spans(start + before - back, n)] == y[_spans(start0 + before0 - back, n)]
        turns = np.flatnonzero(np.diff(same, prepend=False, append=False))
        lo, hi = turns[::2], turns[1::2]
        row = np.searchsorted(edge, lo, "right") - 1
        places, cuts = at.flatten().to_numpy().astype(np.int64), at.offsets.to_numpy()
        of_place = np.repeat(np.arange(len(at)), np.diff(cuts))
        origin = edge[:-1] + back - places[cuts[:-1] - cuts[0]] if len(places) else edge[:-1]
        flat = places + origin[of_place]
        held = (np.searchsorted(flat, lo, "left") < np.searchsorted(flat, hi, "left")) & (hi - lo >= LINE)
        lo, hi, row = lo[held], hi[held], row[held]
        which = pa.array(row)
        yield pa.RecordBatch.from_arrays([ids.take(which), keys.take(which), pa.array(lo - origin[row], pa.int64()), pa.array(hi - origin[row], pa.int64())], names=["doc_id", "key", "lo", "hi"])


def merge(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _long_runs(batches):
    """The joined ranges of each document that are long enough."""
    for ids, keys, lo, hi in rows(batches, "doc_id", "key", "lo", "hi"):
        out = [(i, k, [r for r in merge(zip(a, b, strict=True)) if r[1] - r[0] >= LEAST_WORDS]) for i, k, a, b in zip(ids, keys, lo, hi, strict=True)]
        out = [o for o in out if o[2]]
        ends = [pa.array([[r[j] for r in o[2]] for o in out], pa.list_(pa.int64())) for j in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), *ends], names=["doc_id", "key", "lo", "hi"])


def text_key():
    """A number that tells the texts of one doc_id apart."""
    return F.hash("text")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, key, lo, hi (arrays: the word ranges to delete) of the documents that have any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text").where("doc_id is not null and text is not null")
    with Scratch(docs.sparkSession) as scratch:
        marks = scratch(map_arrow(docs, _marks, "doc_id long, key int, fp array<long>, at array<int>"), "marks")
        later = _later_occurrences(marks, scratch)
        scratch.drop(marks)
        # The places of a document are bounded by its length.
        matches = later.groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "d0", "k0", "a0")).alias("matches"))
        chains = scratch(map_arrow(matches, _chains, CHAIN), "chains")
        scratch.drop(later)
        source = ["d0", "k0", "a0", "end"]
        uses = chains.groupBy(*source).agg(F.count(F.lit(1)).alias("n"))
        uses = scratch(uses.select(*source, (F.col("n") * HOT_SHARE > chains.count()).alias("hot")), "sources")
        chain = ["at", *source, "hot"]
        sources = uses.select(F.col("d0").alias("doc_id"), F.col("k0").alias("key"), F.array().cast("array<int>").alias("at"), *source, "hot")
        asked = chains.withColumn("hot", F.lit(False)).select("doc_id", "key", *chain).unionByName(sources).groupBy("doc_id", "key").agg(F.collect_list(F.struct(*chain)).alias("asked"))
        words = scratch(map_arrow(squeeze(docs).join(asked.hint("merge"), ["doc_id", "key"]), _words, STRETCH), "words")
        later = words.where(F.size("at") > 0)
        there = words.where(F.size("at") == 0).select(*source, "hot", F.col("before").alias("before0"), F.col("words").alias("words0")).dropDuplicates(source)
        met = _met(later, there, source, uses)
        ranges = map_arrow(met, _extend, "doc_id long, key int, lo long, hi long")
        by_doc = ranges.groupBy("doc_id", "key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
        return materialize(map_arrow(by_doc, _long_runs, "doc_id long, key int, lo array<long>, hi array<long>"), "runs")


def _met(left: DataFrame, right: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Inner join; the hot rows of ``right``, at most HOT_SHARE (their keys are in ``known``), are broadcast and what meets them is not shuffled."""
    left = left.drop("hot")
    others = left.join(F.broadcast(known.where("hot").select(*keys)), keys, "left_anti")
    return others.join(right.where("not hot"), keys).unionByName(left.join(F.broadcast(right.where("hot")), keys))


def _later_occurrences(marks: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, key, at of all occurrences of repeated fingerprints but the first; d0, k0, a0: the first; hot."""
    places = marks.select("doc_id", "key", F.explode(F.arrays_zip("fp", "at")).alias("x")).select("doc_id", "key", "x.fp", "x.at")
    total = marks.agg(F.sum(F.size("fp"))).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    seen = scratch(places.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d0")).where("n > 1").select("fp", "d0", hot.alias("hot")), "seen")
    shared = scratch(_met(places, seen, ["fp"], seen), "shared")
    first = shared.where("doc_id = d0").groupBy("fp", "hot").agg(F.min(F.struct("key", "at")).alias("x"))
    first = scratch(first.select("fp", F.col("x.key").alias("k0"), F.col("x.at").alias("a0"), "hot"), "first")
    pairs = _met(shared, first, ["fp"], first)
    later = scratch(pairs.where("doc_id <> d0 or key <> k0 or at <> a0").drop("fp"), "later")
    scratch.drop(seen, shared, first)
    return later


def delete_runs(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """A text without the given ranges of its words, each with the white space after it."""
    if not text or not ranges:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    starts = np.append(np.flatnonzero(~white & np.concatenate([[True], white[:-1]])), len(raw))
    keep, at = [], 0
    for lo, hi in merge(ranges):
        keep.append(raw[at : starts[lo]])
        at = int(starts[hi])
    return b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without later repeated runs (n_chars, where there is one, follows the text)."""
    names = docs.columns
    others = [n for n in names if n != "text"]
    packed = docs.select(F.struct(*(F.col(f"`{n}`") for n in others)).alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"))
    joined = squeeze(packed).join(repeated_runs(docs).hint("merge"), ["doc_id", "key"], "left").select("row", "text", "lo", "hi")

    def run(batches):
        for batch in batches:
            columns = dict(zip(others, batch.column(0).flatten(), strict=True))
            texts, lo, hi = unsqueeze(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cut = [delete_runs(t, list(zip(a, b, strict=True))) if a else t for t, a, b in zip(texts, lo, hi, strict=True)]
            columns["text"] = pa.array(cut, pa.string())
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pa.array([len(c) if a else n for c, a, n in zip(cut, lo, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return map_arrow(joined, run, docs.schema)


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, n_words_deleted, first_words and end_words (the word ranges that go) of every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"))
    joined = keyed.join(repeated_runs(docs), ["doc_id", "key"], "left")
    none = F.array().cast("array<long>")
    lo, hi = F.coalesce("lo", none), F.coalesce("hi", none)
    deleted = F.aggregate(F.zip_with(lo, hi, lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return joined.select("doc_id", F.size(lo).cast("long").alias("n_runs"), deleted.alias("n_words_deleted"), lo.alias("first_words"), hi.alias("end_words"))
