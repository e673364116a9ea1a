"""The corpus pipeline: stages over documents, each over all that its predecessor kept.

Every stage but the last returns the columns of documents. ORACLE_SQL is None: fingerprints and
token ids aren't expressible in SQL; stages and ``run`` are tested against plain Python instead.

Defined results, for every stage: null and empty texts are texts without words (the rules reject
them); very long texts are judged whole; repeated rows are judged one by one but for the near-dedup
stage; extra columns pass by, whatever their names, up to packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import decontaminate, near_copies, packing, quality_model, quality_rules
from wayfold.llm.shared import materialise


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier rejects go."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the rules reject go."""
    return docs.where(quality_rules.rules_column(docs["text"])["kept"])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, then what it can't find: of each group of near copies, of similarity 0.8 or more on
    five-word shingles, the text with the smallest doc_id stays, null ids last. Rows equal in doc_id and
    text count once; different texts with one doc_id are judged apart."""
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that leak a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 over what is left."""
    return packing.pack(docs).drop("ids")


STAGES = [("quality classifier", classify), ("quality rules", rules), ("SimHash near-dedup", deduplicate), ("benchmark decontamination", decontaminated), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
