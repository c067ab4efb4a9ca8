"""The training-data pipeline: whole documents in, digests of the written token files out.

Documents the quality classifier rejects go, one document of each group of near copies stays,
documents that hold a test item go, sources are mixed to their targets in training order, and
the mix is written as token files.  Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderflow.llm import decontaminate, jaccard, mixing, quality, tokenfiles
from orderflow.llm.common import table
from orderflow.llm.queries import tokenizer_path
from orderflow.session import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents the classifier scores 0.5 or more, NULL and blank texts among them; an empty table or no labels keep all."""
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.score(docs, model, column="_score").where("_score >= 0.5").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies; texts without words are like nothing and stay."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def without_test_items(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a test item; NULL texts hold none and stay."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, folder, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A row per copy the mix takes, in training order; texts without words are never taken."""
    return mixing.in_training_order(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The digests of all documents handed in, repeated rows each, from files in ascending doc_id order."""
    path = Stage(spark).path("tokens")
    tokenfiles.write_tokens(docs, path, tokenizer_path())
    return tokenfiles.with_starts(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_test_items),
    ("mixing sources to target weights", mixed),
    ("token-ID output", token_files),
]
# The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Every stage on all that its predecessor kept, handed on as a Parquet table."""
    stage, docs = Stage(spark), table(spark, folder, "documents")
    *most, (_, last) = STAGES
    for place, (_, step) in enumerate(most):
        docs = stage.put(f"{place}", step(spark, docs, folder))
    return last(spark, docs, folder)
