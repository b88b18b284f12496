"""A training corpus from raw documents, in five stages.

Each stage works on all rows that the stage before it kept, written as Parquet
and read again: language identification (documents in no language that the
labels know go: no letters, nothing matched, or no language with half of what all
languages match), near-duplicate removal by the exact Jaccard join (one document of each
group stays), benchmark decontamination (documents holding a test item go),
secret scan (secrets are masked in the text), and mixing the sources to their
target weights.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regiolens.llm.common import Scratch, table
from regiolens.llm.decontaminate import drop_contaminated
from regiolens.llm.jaccard_join import keep_representatives
from regiolens.llm.lang_id import keep_identified
from regiolens.llm.mixing import mix_documents
from regiolens.llm.secrets import redact_secrets
from regiolens.session import ship_package


MIN_LANG_SCORE = 0.5  # share of the found language in what all languages match


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_identified(docs, min_score=MIN_LANG_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

# the language model, the edit-distance search and the guess costs have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.store(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
