"""A corpus from raw documents to tokens, in five stages, each written and read again before the next.

language    documents whose text has no determined language, or one that is scored under LEAST_LANGUAGE, go
near_copies one document of each component of near copies stays: the one with the smallest doc_id. Links are op10's: 4 words, 85 in 100
benchmark   documents that leak a benchmark passage go
pii         personal data in texts is replaced by its kind
tokens      texts are encoded and decoded

Defined results: null texts, and texts without a letter, go in the first stage; without any labelled rows only null texts go there; rows
without a doc_id are linked with nothing; under a repeated doc_id each text is a document of its own, and of rows that are alike one
stays; texts of any length are taken whole; columns that documents doesn't have are dropped at the start; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm import bpe, decontaminate, jaccard_join, language_id, pii
from timelens.llm.common import checkpoint, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of a document's language.
LEAST_LANGUAGE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    field = language_id.fit(language_id.training_rows(docs))
    judged = language_id.predict(docs, field)
    if field is None:
        return docs.filter(F.col("text").isNotNull())
    return judged.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_component(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs, bpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("decontaminate", benchmark),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: The stages hold fitted models and graph algorithms, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. Each result but the last is written to the shared folder and read from there."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
