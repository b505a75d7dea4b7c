"""The corpus pipeline: rules, near-duplicates, PII, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and reads it
back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaframe.llm import bpe, mixing, pii, quality_rules, simhash
from sylvaframe.llm._common import read_table, stored
from sylvaframe.llm.queries import SURROGATE_KEY, tokenizer_path
from sylvaframe.sources.shared import collected, owner_of

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _releasing(stage: Stage) -> Stage:
    """The stage, whose intermediate tables are deleted once its result and all that is derived from it are out of use."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with collected() as tables:
            out = stage(spark, docs, sf_dir)
        return owner_of(out, tables)

    return run


@_releasing
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the divergence rules.

    Each row is judged by its own text and language, whatever its doc_id is: null and repeated ids and repeated rows are rows like any
    other. Null and short texts fail. An empty table gives an empty result; columns beside COLUMNS are dropped.
    """
    return quality_rules.judge(docs.select(*COLUMNS), with_row=True).where("kept").select("row.*")


@_releasing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that with the smallest doc_id, null last, and of those the one whose row hashes lowest.

    Null texts are empty and one group. Rows without doc_id stay where their group has no other. An empty table gives an empty
    result; columns beside COLUMNS are dropped.
    """
    return simhash.representatives(docs.select(*COLUMNS))


@_releasing
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced by surrogates; n_chars follows the text.

    Rows are replaced by their text alone, so null and repeated ids and repeated rows need no care; null texts stay null, with n_chars
    null. An empty table gives an empty result; columns beside COLUMNS are dropped.
    """
    return pii.pseudonymize(docs.select(*COLUMNS), key=SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_releasing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Copies are decided for rows, so null and repeated ids and repeated rows are rows of their own; texts without a word are never taken. An
    empty table gives an empty result; columns beside COLUMNS are dropped.
    """
    taken = mixing.mix(docs.select(*COLUMNS), with_row=True).where("copies > 0")
    return taken.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: (doc_id, n_tokens, ids_sha256, decoded_sha256, ids); null texts have none, an empty table gives an empty result."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("rules", rules), ("near_duplicates", near_duplicates), ("private", private), ("mix", mix), ("tokens", tokens)]

#: Tokens and hash draws are beyond SQL; tests/llm holds run() and each stage against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
