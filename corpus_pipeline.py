"""Training-data pipeline over ``documents``: five stages, each one operator of folioscope.llm.

Every stage works on all that the one before kept and its result is written as
Parquet and read again, so a lost executor costs one stage at most.

* quality_rules: documents that a rule rejects go.
* exact_dedup: of equal texts (white space aside) the smallest doc_id stays.
* simhash: of each group of linked fingerprints the smallest doc_id stays.
* mixing: sources are brought to their targets; a document may come twice.
* bpe: token ids, with digests of the ids and of what they decode to.

Nulls, empty texts and repeated rows follow the operators' docstrings; extra
columns are kept up to the last stage; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from folioscope.llm.common import documents, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The last stage is no SQL; tests hold the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
