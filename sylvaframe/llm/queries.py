"""Queries opN_<name> and pipeline for the driver: thin digests over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bradley_terry, html_extract, lattice_dedup, license_scan, mixing, multi_index, oracles, pii, prefix_trie, quality_rules, simhash, structure_repair, suffix_dedup
from ._common import read_table


#: Key of the surrogates on the synthetic tables; give an own, secret one for real data.
SURROGATE_KEY = "key-of-the-synthetic-tables"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_matches", "best_license", "best_score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = multi_index.sign_codes(read_table(spark, sf_dir, "embeddings"))
    return multi_index.search(codes, codes.where("id % 20 = 0"), k=10)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key=SURROGATE_KEY).select("doc_id", "text", "n_entities")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; hashes, models, tokens and drawn surrogates are beyond it."""
    return oracles.oracle_sql()
