"""The corpus pipeline: five stages, each an operator of ``tidewell.llm`` over all that the one before kept.

1. quality rules: rejected documents go. 2. n-gram Jaccard join: of each class of near copies the document
with the least id stays. 3. suffix-array dedup: passages of over 50 words that start anywhere else too are cut out of the
texts; a document stays even if nothing is left of it. 4. decontamination: documents that hold a benchmark item go.
5. packing: what is left becomes sequences.

``ORACLE_SQL`` is None: suffix arrays, spaced seeds and best-fit packing can't be put in SQL; tests compare
``run`` with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import store, table
from tidewell.llm.decontaminate import drop_contaminated
from tidewell.llm.jaccard_join import keep_one
from tidewell.llm.packing import pack_documents
from tidewell.llm.quality import keep_good
from tidewell.llm.queries import tokenizer
from tidewell.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs, length=51, unit="words")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
