"""From raw documents to packed training sequences: five stages, each an operator of weftline.llm on what the stage
before it kept. Every stage takes (spark, docs, sf_dir); between stages documents lie in a table of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, packing, quality, secrets, simhash
from weftline.session import materialise, read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the learning folds among docs.

    Null texts count as empty and get a score too; rows that repeat an id are judged each, by their own texts; a row without
    an id is in no held-out fold. Without labels, or without documents, nothing is learnt: all rows have one score. Columns
    pass through whatever their names.
    """
    found = quality.classify(docs, read_table(spark, sf_dir, "labels"), keep_row=True)
    return found.where("predicted = 1").select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    Null texts count as empty, and empty texts are equal. A row without an id ranks below all others; of rows that repeat
    both id and text one stays. An empty table gives none.
    """
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 or more of their distinct five-word shingles, directly or over others, the one with the
    smallest id.

    Fingerprints propose links, and the sets of shingles decide them. Null texts count as empty; rows without an id stay;
    rows that repeat an id stay or go together. An empty table gives none.
    """
    return simhash.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark, and n_chars of the new text where it changed.

    A null text stays null; rows that repeat an id are searched each; an empty table gives none.
    """
    found = secrets.scan(docs, keep_row=True)
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans") != "", F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences.

    A null or empty text is one piece with the end id alone; rows that repeat an id are packed each; a null id stays null;
    an empty table gives none.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and token ids are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
