"""Training-data pipeline over ``documents``: language ID, SimHash near-dedup, secret
scan, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
Null or letterless texts are dropped by the first stage; every stage accepts them anyway,
as well as repeated rows, extra columns and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onramp.llm import common, language_id, mixing, secrets_cnn, simhash, word_bpe
from onramp.session import materialize

SHINGLE, DISTANCE = 3, 2  # of the SimHash stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; a missing ``lang`` gets the prediction."""
    common.ready(spark)
    d = common.packed(docs, text="text", lang="lang")
    kept = language_id.identify(d, language_id.learned(docs)).filter(~F.col("rejected"))
    return common.unpacked(kept, docs, lang=F.coalesce("lang", "lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints."""
    common.ready(spark)
    return simhash.without_near_duplicates(docs, SHINGLE, DISTANCE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces found secrets in the texts; every document stays."""
    common.ready(spark)
    return secrets_cnn.redacted(docs, secrets_cnn.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document zero, one or two times, as its source's target asks."""
    common.ready(spark)
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hashes of ids and decoded text."""
    common.ready(spark)
    return word_bpe.encode_texts(docs, word_bpe.default_path(), keep_ids=True, keep_text=False)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("word_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # compression, XXH64 and BPE have no SQL form: tests hold each stage against brute force
