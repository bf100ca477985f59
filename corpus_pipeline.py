"""Corpus pipeline: quality classifier, near-duplicates, decontamination, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each as Parquet and reads it
again as the next one's documents. All but the last return the columns of documents. The last returns the packed pieces.
Stages handle null and empty texts as their operators do; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpath.llm import decontaminate, packing, pii, quality, setsketch
from cellpath.llm.queries import table, tokenizer_file
from cellpath.llm.staged import stage


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``rejected``, in their columns; rows without an id stay."""
    gone = rejected.select(F.col("doc_id").alias("_gone")).where("_gone is not null").distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    judged = quality.assess(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; of repeated rows one."""
    found = setsketch.near_duplicates(docs)
    rest = _without(docs, found.where("not kept"))
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again")
    once = rest.join(again, rest["doc_id"] == again["_again"], "left_anti")
    return once.union(rest.join(again, rest["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(F.size("hits") > 0))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the language model nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
