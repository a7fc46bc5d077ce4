"""Training-corpus pipeline: each stage filters or rewrites what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from panelweave.llm.queries import table, word_bpe
from panelweave.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the clause grammar calls toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that many sources share, but in the first document of each."""
    return line_dedup.drop_shared_lines(docs)


def _jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return jaccard_join.near_duplicates_dropped(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack(packing.token_pieces(docs, word_bpe()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _toxicity),
    ("line dedup", _line_dedup),
    ("n-gram Jaccard join", _jaccard_join),
    ("benchmark decontamination", _decontamination),
    ("best-fit packing", _packing),
]
#: The grammar learns and the tokenizer is not SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
