"""Corpus pipeline: documents to packed training sequences, one operator per stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its
predecessor kept. The first four return the columns of ``documents``; the last
returns the place of every piece in the packed sequences.

Defined results, for every stage: a null text counts as empty (quality rules
reject it, the later stages would keep it); nulls in any other column pass
through; repeated rows are judged alike, and near-dedup keeps one of them; of
equals the smallest id counts, null last; very long texts are read whole; an
empty table gives an empty table; extra columns are kept, whatever their names,
up to the last stage, which has its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caudal.llm import decontaminate, packing, quality, secrets, simhash
from caudal.llm.tables import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; a null or empty text is rejected."""
    return quality.filter_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the smallest id; texts without words are one component."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a null or short item contaminates none."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, ``n_chars`` follows; a row without a secret stays as it is, nulls included."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences; a null text has the end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Tokenising cannot be said in SQL; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the session's shared folder before the next reads it."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
