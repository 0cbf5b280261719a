"""A training corpus from raw documents, in five stages.

Each stage is one operator of ``velario.llm`` whose decisions take effect: what it
returns is written as Parquet and read again as the next stage's documents.
"""

from pyspark.sql import DataFrame, SparkSession

from velario.llm import curve_packing, rule_cascade, simhash_trees, soft_mixing, superkmers
from velario.llm.shared import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rule_cascade.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near copies, the one with the smallest id."""
    return simhash_trees.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that occur again."""
    return superkmers.without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say in expectation, rates fitted to the target weights."""
    labels = soft_mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # a document's own columns may be called as the fitted ones are
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"own{i}" for i, c in enumerate(docs.columns)])
    return soft_mixing.draw(soft_mixing.mix(plain, labels), plain.columns).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with the tokens themselves."""
    return curve_packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

# tokenizers and a classifier take part: tests/llm holds each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
