"""A corpus from raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vspark.llm import bpe, language, mixing, near_dedup, pii
from vspark.llm.common import remove, shared_dir

#: A document is rejected if its language can't be told, or is told with less than this score.
LANGUAGE_SCORE = 0.4
TOKENS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of undetermined language; a missing lang becomes the predicted one."""
    import public_tokenizers

    model = language.fit_languages(docs.filter(~language.held_out(F.col("doc_id"))), public_tokenizers.path(PIECES))
    told = language.predict_languages(docs, model, docs.columns)
    told = told.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id, or one without doc_id if the class has no other."""
    return near_dedup.one_of_each_class(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind, n_chars following the text."""
    return pii.redact_pii(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every row as often as its source's target weight asks for."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without text, with token_ids (little-endian unsigned 32-bit), their number and digests of the ids and of the bytes decoded from them."""
    import public_tokenizers

    return bpe.encoded_documents(docs, public_tokenizers.path(TOKENS), public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_to_weights),
    ("bpe", tokenize),
]

#: SQL can express neither the language model, nor the signatures, nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them a table in the shared folder cuts the lineage.

    A table goes when the next one is written; the last one stays, as the result reads it when it is used, and goes with the folder.
    """
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
