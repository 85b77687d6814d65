"""A cleaning pipeline over documents: toxicity, line dedup, near-duplicate join, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. `run` applies the stages to the documents table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from medspan.llm.common import shared_dir, table

# Word shingles and similarity of near duplicates.
SHINGLE, NUM, DEN = 5, 80, 100


def _counted(docs: DataFrame, like: list[str]) -> DataFrame:
    """docs with n_chars of the new text, and the columns of documents only."""
    if "n_chars" in like:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*like)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores 0.5 or more go; the rest stays as it is."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut from the texts; every document stays. Long passages on fewer lines are left to the suffix
    stage: a copy that stands on one line would else be empty before the near-duplicate stage could name it a copy."""
    return _counted(line_dedup.dedup(docs, long=None), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles connect, the one with the smallest id stays."""
    found = ngram_join.join(docs, k=SHINGLE, num=NUM, den=DEN)
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    rows = docs.withColumn("__order", F.xxhash64("text"))
    kept = rows.join(keep, rows["doc_id"] == F.col("__kept"), "left_semi")
    return kept.dropDuplicates(["doc_id", "__order"]).drop("__order").unionByName(docs.filter("doc_id is null"))


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings of PASSAGE bytes, as long as the shortest passages of fifty words, are cut from the texts; every
    document stays."""
    return _counted(suffix_dedup.dedup(docs, length=suffix_dedup.PASSAGE, gram=suffix_dedup.PASSAGE_GRAM), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", suffixes),
    ("packing", packed),
]

# The stages learn and tokenise: SQL cannot express them. tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
