"""From raw documents to token ids: five stages, each of them one of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. A row's columns other than the text and its length are never
changed; what each operator does with nulls, ties and repeated rows its module says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, mixing, quality, secrets, simhash
from siltstone.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints within four bits, or five-word shingles at 0.8."""
    return simhash.keep_one(spark, docs, similar=True)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mask in place of each secret."""
    return secrets.redact(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight and the rounding say."""
    return mixing.mix(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text that they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality classifier", good), ("SimHash near-dedup", distinct), ("secret scans", redacted), ("mixing sources", mixed), ("BPE", tokens)]

#: Training, fingerprints, automata and merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
