"""Training of the embedding models by negative sampling.

:func:`train_distributed` computes gradients where the examples are: a step sums sparse gradient rows
(kind, id, vector) over all partitions and the driver applies the optimiser to the parameters, which are
broadcast (their size is checked against MAX_PARAMETERS). :func:`train_in_memory` runs mini-batches in one
task for corpora of at most MAX_EXAMPLES examples; :func:`train` takes the one that a count allows. Both give the same kind of result and take the same
models: ``skipgram`` (also PV-DBOW, whose targets are graphs), ``cbow`` and ``pvdm``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PARAMETERS, MAX_EXAMPLES = 50_000_000, 5_000_000
#: Steps of an epoch over a corpus that is too large for one task; numbers of gradient rows that a task holds before it sums them.
LARGE_STEPS, HELD = 4, 8_000_000
CLAMP = 10.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -CLAMP, CLAMP)))


def init_parameters(model: str, n_targets: int, n_vocab: int, dim: int, seed: int) -> dict[str, np.ndarray]:
    """``input`` uniform in (-1/d, 1/d); the other side 0 (skip-gram) or uniform."""
    rng = np.random.default_rng(seed)
    u = lambda n, d: rng.uniform(-1 / dim, 1 / dim, (n, d))
    if model == "skipgram":
        return {"input": u(n_targets, dim), "output": np.zeros((n_vocab, dim))}
    if model == "cbow":
        return {"input": u(n_vocab, dim), "output": u(n_vocab, dim)}
    if model == "pvdm":
        return {"graph": u(n_targets, dim), "input": u(n_vocab, dim), "output": u(n_vocab, 2 * dim)}
    raise ValueError(f"no such model: {model}")


def gradients(model: str, p: dict[str, np.ndarray], batch: dict[str, np.ndarray]) -> tuple[float, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Summed loss, and for each parameter the ids and gradient rows of a batch of examples."""
    if model == "skipgram":
        hidden, positive = p["input"][batch["target"]], batch["context"]
    else:
        hidden, positive = p["input"][batch["contexts"]].sum(axis=1), batch["target"]
        if model == "pvdm":
            hidden = np.hstack([p["graph"][batch["graph"]], hidden])
    out, neg = p["output"][positive], p["output"][batch["negatives"]]
    s, t = (hidden * out).sum(axis=1), np.einsum("bd,bnd->bn", hidden, neg)
    loss = float(np.log1p(np.exp(-np.clip(s, -CLAMP, CLAMP))).sum() + np.log1p(np.exp(np.clip(t, -CLAMP, CLAMP))).sum())
    gs = (_sigmoid(s) - 1) * (np.abs(s) < CLAMP)
    gt = _sigmoid(t) * (np.abs(t) < CLAMP)
    dh = gs[:, None] * out + np.einsum("bn,bnd->bd", gt, neg)
    ids = np.concatenate([positive, batch["negatives"].ravel()])
    rows = np.concatenate([gs[:, None] * hidden, (gt[:, :, None] * hidden[:, None, :]).reshape(-1, hidden.shape[1])])
    grads = {"output": (ids, rows)}
    if model == "skipgram":
        grads["input"] = (batch["target"], dh)
    else:
        d = p["input"].shape[1]
        own = dh[:, -d:]
        width = batch["contexts"].shape[1]
        grads["input"] = (batch["contexts"].ravel(), np.repeat(own, width, axis=0))
        if model == "pvdm":
            grads["graph"] = (batch["graph"], dh[:, :d])
    return loss, grads


@dataclass
class Optimizer:
    """Adagrad (with decay of the rate) or sparse Adam, on rows; cosine annealing over ``steps`` when asked for."""

    kind: str = "adagrad"
    rate: float = 0.1
    decay: float = 0.0
    cosine_steps: int = 0
    reset_each_epoch: bool = False
    state: dict = field(default_factory=dict)
    step_no: int = 0

    def new_epoch(self) -> None:
        if self.reset_each_epoch:
            self.state, self.step_no = {}, 0

    def apply(self, p: dict[str, np.ndarray], grads: dict[str, tuple[np.ndarray, np.ndarray]], scale: float) -> None:
        self.step_no += 1
        rate = self.rate / (1 + (self.step_no - 1) * self.decay)
        if self.cosine_steps:
            rate *= 0.5 * (1 + math.cos(math.pi * min(1.0, (self.step_no - 1) / self.cosine_steps)))
        for name, (ids, rows) in grads.items():
            unique, where = np.unique(ids, return_inverse=True)
            g = np.zeros((len(unique), rows.shape[1]))
            np.add.at(g, where, rows)
            g *= scale
            if self.kind == "adagrad":
                acc = self.state.setdefault(name, np.zeros_like(p[name]))
                acc[unique] += g * g
                p[name][unique] -= rate * g / (np.sqrt(acc[unique]) + 1e-10)
            elif self.kind == "adam":
                m, v = self.state.setdefault(name, (np.zeros_like(p[name]), np.zeros_like(p[name])))
                m[unique] = 0.9 * m[unique] + 0.1 * g
                v[unique] = 0.999 * v[unique] + 0.001 * g * g
                p[name][unique] -= rate * (m[unique] / (1 - 0.9**self.step_no)) / (np.sqrt(v[unique] / (1 - 0.999**self.step_no)) + 1e-8)
            else:
                raise ValueError(f"no such optimiser: {self.kind}")


@dataclass
class Trained:
    parameters: dict[str, np.ndarray]
    losses: list[float]


ARRAYS = {"skipgram": ["target", "context", "negatives"], "cbow": ["target", "contexts", "negatives"], "pvdm": ["graph", "target", "contexts", "negatives"]}


def _batch(pdf: pd.DataFrame, model: str) -> dict[str, np.ndarray]:
    return {c: np.stack(pdf[c].to_numpy()).astype(np.int64) if c in ("negatives", "contexts") else pdf[c].to_numpy(np.int64) for c in ARRAYS[model]}


def _checked(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    size = sum(x.size for x in p.values())
    if size > MAX_PARAMETERS:
        raise ValueError(f"{size} parameters; at most {MAX_PARAMETERS} are broadcast. Raise min_count or lower the dimension")
    return p


def _summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and the sum of the rows of each."""
    order = np.argsort(ids, kind="stable")
    unique, first = np.unique(ids[order], return_index=True)
    return unique, np.add.reduceat(rows[order], first, axis=0) if len(ids) else rows


def _gradient_rows(held: dict[str, list[tuple[np.ndarray, np.ndarray]]], rows: int = 10_000):
    for name, sums in held.items():
        for ids, g in sums:
            for k in range(0, len(ids), rows):
                yield pd.DataFrame({"kind": name, "id": ids[k : k + rows], "g": list(g[k : k + rows])})


def train_distributed(examples: DataFrame, model: str, n_targets: int, n_vocab: int, dim: int = 128, epochs: int = 10, steps_per_epoch: int = 1, optimizer: Optimizer | None = None, seed: int = 0) -> Trained:
    """Synchronous training; each step uses the examples of one hash class in all partitions."""
    optimizer = optimizer or Optimizer()
    p = _checked(init_parameters(model, n_targets, n_vocab, dim, seed))
    context = examples.sparkSession.sparkContext
    parts_of_sums = context.defaultParallelism
    full = examples.select(*ARRAYS[model]).where(F.size("negatives") > 0).withColumn("_step", F.pmod(F.xxhash64(F.lit(seed), *ARRAYS[model][:2]), F.lit(steps_per_epoch))).persist(StorageLevel.DISK_ONLY)
    losses = []
    try:
        for _ in range(epochs):
            optimizer.new_epoch()
            total, seen = 0.0, 0
            for step in range(steps_per_epoch):
                shared = context.broadcast(p)

                def run(batches, shared=shared):
                    held, size, loss, n = {}, 0, 0.0, 0
                    for pdf in batches:
                        if not len(pdf):
                            continue
                        more, grads = gradients(model, shared.value, _batch(pdf, model))
                        loss, n = loss + more, n + len(pdf)
                        for name, (ids, rows) in grads.items():
                            held.setdefault(name, []).append(_summed(ids, rows))
                            size += held[name][-1][1].size
                        if size > HELD:
                            # Ids that come again are summed; a task that meets ever new ones hands its sums on instead of keeping them.
                            held = {name: [_summed(np.concatenate([i for i, _ in x]), np.concatenate([g for _, g in x]))] for name, x in held.items()}
                            size = sum(x[0][1].size for x in held.values())
                            if size > HELD // 2:
                                yield from _gradient_rows(held)
                                held, size = {}, 0
                    yield from _gradient_rows({name: [_summed(np.concatenate([i for i, _ in x]), np.concatenate([g for _, g in x]))] for name, x in held.items()})
                    if n:
                        yield pd.DataFrame({"kind": ["loss"], "id": [0], "g": [[loss, float(n)]]})

                def together(batches):
                    held = {}
                    for pdf in batches:
                        for name, part in pdf.groupby("kind"):
                            held.setdefault(name, []).append((part["id"].to_numpy(), np.stack(part["g"].to_numpy())))
                    yield from _gradient_rows({name: [_summed(np.concatenate([i for i, _ in x]), np.concatenate([g for _, g in x]))] for name, x in held.items()})

                schema = "kind string, id long, g array<double>"
                parts = full.where(F.col("_step") == step).mapInPandas(run, schema)
                summed = parts.repartition(parts_of_sums, "kind", "id").mapInPandas(together, schema).toPandas()
                shared.destroy()
                got = summed[summed["kind"] == "loss"]
                if not len(got):
                    continue
                lost, n = got["g"].iloc[0]
                total, seen = total + float(lost), seen + int(n)
                grads = {k: (part["id"].to_numpy(), np.stack(part["g"].to_numpy())) for k, part in summed[summed["kind"] != "loss"].groupby("kind")}
                optimizer.apply(p, grads, 1.0 / n)
            losses.append(total / max(1, seen))
    finally:
        full.unpersist()
    return Trained(p, losses)


def train(examples: DataFrame, model: str, n_targets: int, n_vocab: int, batch_size: int = 1024, count: int | None = None, **p) -> Trained:
    """In one task where the examples are at most MAX_EXAMPLES; else where they are, LARGE_STEPS steps an epoch, each example once an epoch.

    Steps of mini-batches are too many for a round over the cluster each, so a large corpus takes fewer and larger ones.
    """
    if (examples.count() if count is None else count) <= MAX_EXAMPLES:
        return train_in_memory(examples, model, n_targets, n_vocab, batch_size=batch_size, **p)
    return train_distributed(examples, model, n_targets, n_vocab, steps_per_epoch=LARGE_STEPS, **p)


def train_in_memory(examples: DataFrame, model: str, n_targets: int, n_vocab: int, dim: int = 128, batch_size: int = 1024, epochs: int = 100, optimizer: Optimizer | None = None, seed: int = 0) -> Trained:
    """Mini-batch training in one task, for a corpus whose number of examples is checked to be small."""
    optimizer = optimizer or Optimizer()
    _checked(init_parameters(model, n_targets, n_vocab, dim, seed))
    rows = examples.select(*ARRAYS[model]).where(F.size("negatives") > 0)
    count = rows.count()
    if count > MAX_EXAMPLES:
        raise ValueError(f"{count} examples are too many for one task; use train_distributed")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i, r=pdf[ARRAYS[model]].to_numpy(): tuple(tuple(x) if np.ndim(x) else x for x in r[i]))
        pdf = pdf.iloc[order]
        p, rng, losses = init_parameters(model, n_targets, n_vocab, dim, seed), np.random.default_rng(seed), []
        data = _batch(pdf, model)
        for _ in range(epochs):
            optimizer.new_epoch()
            order, total = rng.permutation(len(pdf)), 0.0
            for k in range(0, len(order), batch_size):
                at = order[k : k + batch_size]
                loss, grads = gradients(model, p, {c: x[at] for c, x in data.items()})
                optimizer.apply(p, grads, 1.0 / len(at))
                total += loss
            losses.append(total / max(1, len(order)))
        out = [{"kind": name, "id": i, "vector": row} for name, m in p.items() for i, row in enumerate(m)]
        return pd.DataFrame([*out, {"kind": "losses", "id": 0, "vector": np.array(losses)}])

    result = rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda pdf: run(pdf.drop(columns="_one")), "kind string, id long, vector array<double>").toPandas()
    p = {k: np.stack(part.sort_values("id")["vector"].to_numpy()) for k, part in result[result["kind"] != "losses"].groupby("kind")}
    return Trained(p, [float(x) for x in result[result["kind"] == "losses"]["vector"].iloc[0]]) if len(result) else Trained({}, [])


def embedding_table(spark, matrix: np.ndarray, names: DataFrame | None = None):
    """entity_id, name, vector of a parameter matrix; ``names``: entity_id, name."""
    table = spark.createDataFrame(pd.DataFrame({"entity_id": np.arange(len(matrix)), "vector": [x.astype(float).tolist() for x in matrix]}), "entity_id long, vector array<float>")
    if names is None:
        return table.select("entity_id", F.col("entity_id").cast("string").alias("name"), "vector")
    return table.join(names, "entity_id").select("entity_id", "name", "vector")
