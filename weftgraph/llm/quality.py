"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network in numpy.

Words are the pieces of a text: runs of letters (lowered, with a mark for their case), of digits and of
punctuation. Every word has a sparse ternary index vector made from its hash; its context vector is the
sum of the index vectors of its neighbours over the training texts. A document is the mean over its words
of both vectors. A network with one hidden layer is trained on that; its logit is divided by a
temperature fitted, with an offset, on training rows that the network has not seen.

The model is fitted on at most 2 * PER_CLASS labelled rows (whole texts) outside the held-out fold; it is
a few MB whatever the size of the corpus, and is broadcast. Scoring is one pass without a shuffle.

Defined results: null and empty texts have the zero vector and so one fixed score; without usable rows of
both labels every score is the share of label 1 (1.0 if there is no label at all); rows are independent;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_arrow, rows
from .labelled import training_rows

MODULUS, HELD_OUT, PER_CLASS = 5, 0, 2000
DIM, NONZERO, REACH, KNOWN, BUCKETS, HIDDEN = 128, 8, 2, 12_000, 4096, 24
PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
REMEMBERED = 400_000


def pieces(token: str) -> list[str]:
    """The words of a white-space token, and a mark for the case of its letters."""
    out = []
    for p in PIECE.findall(token):
        if p[0].isalpha():
            out.append(p.lower())
            out.append("<AA>" if len(p) > 1 and p.isupper() else "<Aa>" if p[0].isupper() else "<aa>")
        elif p[0].isdigit():
            out.append("<0>")
        else:
            out.append(p)
    return out


def index_vector(word: str) -> np.ndarray:
    draw = np.frombuffer(blake2b(word.encode("utf-8", "replace"), digest_size=2 * NONZERO).digest(), np.uint16)
    v = np.zeros(DIM, np.float32)
    np.add.at(v, draw % DIM, np.where(draw >> 15, 1, -1).astype(np.float32))
    return v


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


@dataclass
class Model:
    rows: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    offset: float


class Pooler(dict):
    """token -> rows of the vector table."""

    def __init__(self, known: dict[str, int], vectors: np.ndarray):
        super().__init__()
        self.known, self.vectors, self.base = known, vectors, len(vectors) - BUCKETS

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        at = self.known.get
        made = tuple(at(p) if p in self.known else self.base + int.from_bytes(blake2b(p.encode("utf-8", "replace"), digest_size=4).digest(), "little") % BUCKETS for p in pieces(token))
        if len(token) < 100:
            self[token] = made
        return made

    def pool(self, text: str | None) -> np.ndarray:
        at = np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), np.int64) if text else np.empty(0, np.int64)
        if not len(at):
            return np.zeros(self.vectors.shape[1], np.float32)
        seen, n = np.unique(at, return_counts=True)
        total = np.zeros(self.vectors.shape[1], np.float32)
        for k in range(0, len(seen), 4096):
            total += n[k : k + 4096].astype(np.float32) @ self.vectors[seen[k : k + 4096]]
        return total / len(at)


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Rows of the KNOWN most frequent words (three uses or more), and the table of [context, index] vectors; hash buckets follow."""
    counts: Counter = Counter()
    for t in texts:
        for token in t.split():
            counts.update(pieces(token))
    known = {w: i for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:KNOWN]) if n >= 3}
    index = np.stack([index_vector(w) for w in [*known, *(f"<bucket {b}>" for b in range(BUCKETS))]])
    context = np.zeros_like(index)
    for t in texts:
        ids = np.fromiter((known.get(p, -1) for token in t.split() for p in pieces(token)), np.int64)
        for d in range(1, REACH + 1):
            for a, b in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                both = (a >= 0) & (b >= 0)
                np.add.at(context, a[both], index[b[both]])
    return known, np.hstack([_unit(context), _unit(index)]).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(samples: list[tuple[int, str, int]], share: float = 0.5, seed: int = 5) -> Model:
    """Fit on (id, text, label) rows. ``share``: label 1's share of all labels, which the sample may not show."""
    y = np.array([s[2] for s in samples], np.float32)
    known, vectors = word_vectors([s[1] for s in samples])
    pooler = Pooler(known, vectors)
    x = np.stack([pooler.pool(s[1]) for s in samples])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    tune, train = order[:cut], order[cut:]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z = (x - mean) / scale
    n1 = max(1.0, float(y[train].sum()))
    weight = np.where(y > 0, len(train) / (2 * n1), len(train) / (2 * max(1.0, len(train) - n1))).astype(np.float32)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(40):
        shuffled = rng.permutation(train)
        for k in range(0, len(shuffled), 128):
            at = shuffled[k : k + 128]
            h = np.tanh(z[at] @ p[0] + p[1])
            g = (_sigmoid(h @ p[2] + p[3]) - y[at]) * weight[at] / len(at)
            dh = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[at].T @ dh + 1e-3 * p[0], dh.sum(axis=0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
            step += 1
            for q in range(4):
                m[q] = 0.9 * m[q] + 0.1 * grads[q]
                v[q] = 0.999 * v[q] + 0.001 * grads[q] ** 2
                p[q] = p[q] - 0.01 * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(z[tune] @ p[0] + p[1]) @ p[2] + p[3]
    # Temperature and offset for the natural share of the labels.
    w = np.where(y[tune] > 0, share / max(1e-6, y[tune].mean()), (1 - share) / max(1e-6, 1 - y[tune].mean()))
    loss = lambda a: float(-(w * (y[tune] * np.log(_sigmoid(logit / a[0] + a[1]) + 1e-9) + (1 - y[tune]) * np.log(1 - _sigmoid(logit / a[0] + a[1]) + 1e-9))).mean())
    temperature, offset = min(((t, o) for t in np.geomspace(0.25, 8, 21) for o in np.linspace(-4, 4, 33)), key=loss)
    return Model(known, vectors, mean, scale, *p[:3], float(p[3][0]), float(temperature), float(offset))


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    logit = np.tanh(((x - model.mean) / model.scale) @ model.w1 + model.b1) @ model.w2 + model.b2
    return _sigmoid(logit / model.temperature + model.offset)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    session = docs.sparkSession
    samples = training_rows(docs, labels, label, MODULUS, HELD_OUT, per_class)
    values = {s[2] for s in samples}
    counts = {r["v"]: r["n"] for r in labels.where(crc_bucket(F.col("doc_id"), MODULUS) != HELD_OUT).where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
    model = session.sparkContext.broadcast(fit(samples, share) if values == {0, 1} else share)
    poolers: dict[int, Pooler] = {}

    def run(batches):
        m = model.value
        for ids, texts, held in rows(batches, "doc_id", "text", "held_out"):
            if isinstance(m, float):
                score = np.full(len(ids), m)
            else:
                pooler = poolers.setdefault(0, Pooler(m.rows, m.vectors)) if 0 not in poolers else poolers[0]
                score = probability(m, np.stack([pooler.pool(t) for t in texts])) if ids else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_bucket(F.col("doc_id").cast("long"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"))
    return map_arrow(rows_in, run, "doc_id long, held_out boolean, score double, predicted int")
