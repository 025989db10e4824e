"""The corpus pipeline: documents go through five operators of ``treestat.llm``, each stage written and read again.

Defined cases, for every stage but the last, which returns digests: columns stay as they are, also further ones and such
with clashing names; NULL and empty texts are kept (they are neither toxic nor duplicates nor leaks, and hold no
secret); rows without doc_id are kept but for those that are toxic or leak; repeated rows of one doc_id are one document
and one row is left of them; an empty table gives an empty one. Texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treestat.llm import byte_bpe, decontaminate, minhash, secrets, toxicity
from treestat.llm.queries import BYTE_BPE
from treestat.llm.tables import table
from treestat.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates stays."""
    return minhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars stays the length of the given text."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return byte_bpe.digests(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]

#: Model fitting, signatures and merges have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
