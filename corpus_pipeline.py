"""Corpus pipeline: documents to packed training sequences.

language ID (rejected documents go) -> MinHash near-duplicates (one document of a
group stays) -> secret scan (spans are redacted) -> mixing to target weights (rows
occur as often as their rate says) -> packing.  Every stage works on all rows its
predecessor kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from moltab.llm import clean, op1_packing, op4_mixing
from moltab.llm.common import staged, table
from moltab.session import scratch_path

#: Wanted token mass of a domain as a multiple of what it has.
MULTIPLES = {"good": 1.05, "plain": 1.0, "toxic": 0.5}
#: A document less likely toxic than this occurs at least once.
KEEP = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean.keep_representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean.redact_secrets(docs, scratch_path(spark, "secret-ledger"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classifier, fit = op4_mixing.fit_mixture(docs, table(spark, sf_dir, "labels"), multiples=MULTIPLES,
                                             keep=KEEP)
    return op4_mixing.mix(docs, classifier, fit)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Not expressible in SQL (trained models, tokenizer); tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
