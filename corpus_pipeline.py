"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept.

Toxic documents go; of each group of near-duplicates the document of smallest id stays; documents that overlap the
benchmark go; personal data is replaced in the texts; what is left is mixed to the sources' target weights. Each stage
is written as Parquet to the shared folder and reread, so that a lost executor costs no more than its stage. The result
holds the sanitised documents with their size in words and the words to take of each, repeats counted.

Defined results: null, empty and very long texts, null ids, ties, repeated rows and extra columns pass through each stage
as its operator states; empty documents are near copies of one another; an empty table, or none left, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontam, mixing, pii, simhash, toxicity
from folioscope.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", sanitise),
    ("source_mix", mix),
]

#: A fitted classifier and XXH64 fingerprints are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
