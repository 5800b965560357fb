"""The corpus pipeline: toxic documents go, repeated passages go, one of each group of near copies stays,
documents with test items go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.bpe import bpe_digests
from weftgraph.llm.common import Scratch, materialize, table
from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm.jaccard_join import one_of_each_group
from weftgraph.llm.line_dedup import line_dedup
from weftgraph.llm.toxicity import drop_toxic


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs, _tokenizer())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", test_items),
    ("BPE encoding", encoding),
]

#: SQL can't express the stages; each is tested against a plain version of it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    The last stage is written too, so that all tables of the stages before it are deleted by then.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for k, (name, stage) in enumerate(STAGES):
            before, made = docs, stage(spark, docs, sf_dir)
            last = k == len(STAGES) - 1
            docs = materialize(made, "pipeline") if last else scratch(made, name.replace(" ", "-"))
            if k:
                scratch.drop(before)
    return docs
