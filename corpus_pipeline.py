"""Documents to a tokenised training mix, in five stages that each read the Parquet the one before wrote.

1. quality classifier: fitted on the labels, rejects documents of low quality and toxic ones;
2. exact dedup: one document of each text stays;
3. SimHash near-dedup: one document of each group of near duplicates stays;
4. mixing sources to target weights: equal weights, 0.8 of the rows, shuffled in shards;
5. byte-level BPE: (doc_id, tokens, n_tokens, round_trip) of each.

Every stage keeps rows of null, empty and very long texts unless its decision is against them (the classifier may reject an empty text, texts that
equal each other are one document, nulls equal nothing), rows of null ids, repeated rows up to exact dedup, and columns of any name; ties are decided by the least id. An empty table stays empty.
Each takes (spark, docs, sf_dir); all but the last return the columns of documents. No SQL can express the
classifier, the fingerprints, the draws or the encoding, so ORACLE_SQL is None and tests/llm hold the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm.bpe import tokenize
from parley.llm.common import drop, read, stored_at
from parley.llm.exact_dedup import without_exact_duplicates
from parley.llm.mixing import mixed
from parley.llm.quality_fm import accepted
from parley.llm.simhash_vp import without_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenize(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup), ("source mixing", mixing), ("byte-level bpe", bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again, and deleted when the next has been written."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = stored_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
