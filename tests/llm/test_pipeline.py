"""The pipeline on planted documents, each stage against a plain version."""

import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import components_by_brute_force, runs_by_brute_force  # noqa: E402

from weftgraph.llm import line_dedup, toxicity  # noqa: E402
from weftgraph.llm.wordhash import shingle_set  # noqa: E402


def plain(spark, name, before, data):
    """doc_id -> text that a stage must leave, from a plain version of it; ids are unique."""
    rows = {r["doc_id"]: r for r in before.select("doc_id", "text", line_dedup.text_key().alias("key")).collect()}
    texts = {i: r["text"] for i, r in rows.items()}
    if name == "toxicity":
        scores = toxicity.toxicity_scores(before, spark.read.parquet(f"{data}/labels.parquet")).collect()
        return {r["doc_id"]: texts[r["doc_id"]] for r in scores if r["score"] < 0.3}
    if name == "line dedup":
        runs = runs_by_brute_force([(i, r["key"], r["text"]) for i, r in rows.items()])
        return {i: line_dedup.delete_runs(r["text"], runs.get((i, r["key"]), [])) for i, r in rows.items()}
    if name == "n-gram Jaccard join":
        return {i: texts[i] for i, _, c in components_by_brute_force(list(texts.items())) if i == c}
    items = [set(shingle_set(r["text"]).tolist()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    sets = {i: set(shingle_set(t).tolist()) for i, t in texts.items()}
    return {i: t for i, t in texts.items() if not any(x and 100 * len(x & sets[i]) >= 75 * len(x) for x in items)}


def test_stages(spark, data, tmp_path):
    rng = random.Random(12)
    src = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    text = lambda n: " ".join(f"clean{rng.randrange(10**7)}" for _ in range(n))
    near = text(80)
    item = max((r["text"] for r in bench.collect()), key=len)
    planted = [(50_000, near), (50_001, "First " + near), (50_002, text(60) + " " + item), (50_003, text(60)), (50_004, None), (50_005, "")]
    docs = src.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], src.schema))
    before, ids = docs, {r["doc_id"] for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, data)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            want = plain(spark, name, before, data)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        before = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert {r["doc_id"]: r["text"] for r in before.collect()} == want, name
        now = {r["doc_id"] for r in before.collect()}
        assert now <= ids
        seen[name], ids = now, now
    assert {50_003, 50_004, 50_005} <= ids
    assert 50_002 not in seen["benchmark decontamination"]
    left = {r["item_id"]: set(shingle_set(r["text"]).tolist()) for r in bench.collect()}
    kept = spark.read.parquet(str(tmp_path / "benchmark-decontamination")).collect()
    assert not any(len(x & s) >= 0.75 * len(x) for r in kept for s in [set(shingle_set(r["text"]).tolist())] for x in left.values() if x)
    assert len(kept) == before.count()


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
