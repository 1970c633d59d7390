"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.llm import decontaminate, jaccard, packing, quality, substrings
from linkmill.llm.common import written

#: Documents with a lower score go.
QUALITY_THRESHOLD = 0.7


def _reserved(docs: DataFrame) -> tuple[DataFrame, list[str], list[Column]]:
    """docs with its columns but text under names that no operator uses, these names, and the columns as they were."""
    names = ["text" if c == "text" else f"_row{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names, [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on these documents' labels, doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, names, back = _reserved(docs)
    return quality.score(rows, model, names).where(F.col("score") >= QUALITY_THRESHOLD).select(*back)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return jaccard.distinct_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; all documents stay, with the words that are left and their number of characters."""
    rows, names, back = _reserved(docs)
    kept = substrings.remove_repeats(rows, [n for n in names if n != "text"]).withColumnRenamed("kept_text", "text").select(*back)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth of the words or more lies in benchmark passages."""
    rows, names, back = _reserved(docs)
    found = decontaminate.search_benchmark(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names)
    return found.where(~F.col("contaminated")).select(*back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the classifier; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
