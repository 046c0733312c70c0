"""The training-corpus pipeline: each stage works on all that the one before kept, written and read again in between.

Defined cases: a document with a null, empty or blank text goes (the first two in
the quality classifier, the last in language ID); a null id is kept like any
other, though it never trains a model; repeated rows are one group of copies, of
which the first stays; a very long text is judged as a whole and packed into as
many sequences as it needs; a null language is no claim; an empty table gives no
rows; the columns of documents, whatever their names, pass through all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textweir.llm import decontamination, language_id, packing, quality, simhash
from textweir.llm.common import stage, table, unstage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.filter_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), lean=True)  # beside the memory that four stages left


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", identify_language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: a trained model rejects documents and a greedy search packs them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES):
        made = apply(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        before, docs = docs, stage(made, f"pipeline{k}")
        if k:
            unstage(before)
    return docs
