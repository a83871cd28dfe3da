"""A corpus made ready for training: language, quality, near duplicates, secrets, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns the
places of all pieces in sequences. Between stages the documents are a table in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm import langid, packing, quality, secret_scan, simhash
from evidex.llm.common import finished, release, spread

#: The least score of a language, and of quality, with which a document stays.
LANGUAGE_SCORE, QUALITY_SCORE = 0.5, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_language(docs, langid.learn(docs), LANGUAGE_SCORE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good(docs, quality.learn(docs, labels), QUALITY_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.mask_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_places(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language), ("quality", good_quality), ("near_dedup", near_duplicates), ("secrets", secrets), ("packing", packing_places)]

#: Models, hashes and tokens are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        docs = finished(lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023  called at once
        if last is not None:
            release(last)
        last = docs
    return docs
