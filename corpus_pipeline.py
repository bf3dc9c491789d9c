"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm import store


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    from inkfold.llm import quality as Q

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _columns(Q.keep(docs, Q.train(labelled, labels)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that stand elsewhere before."""
    from inkfold.llm import line_dedup

    return _columns(line_dedup.remove_repeats(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    from inkfold.llm import simhash

    return _columns(simhash.keep_one(docs), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    from inkfold.llm import decontaminate as D

    return _columns(D.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences."""
    from inkfold.llm import packing, units

    return packing.pack(docs, units.tokenizer_path("word_bpe_49k.json"), 1, 4096)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packed),
]

#: A trained model and a tokenizer decide what stays; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.written(docs)
    return docs
