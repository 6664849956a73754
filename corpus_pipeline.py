"""From documents to token ids: five stages, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of documents, further columns included, whatever
their names. Null and empty texts, repeated rows and very long texts are
defined for each stage below; an empty table stays empty in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece
from lodestrata.llm.shared import discard, saved

#: A public model; the operator takes any path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts.

    Null texts, texts without a letter and texts in no language of the corpus
    go; ids and repeated rows play no part. Long texts are judged whole.
    """
    return language_id.keep_accepted(docs, language_id.train(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id.

    Null texts are empty ones; of rows that repeat id and text one stays.
    """
    return exact_dedup.drop_copies(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents with a null id stay; texts without words are one group.
    """
    return near_dedup.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to twice.

    A null source is a source of its own; null and empty texts weigh nothing.
    """
    return mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and digests of the text before and after the round trip.

    Null and empty texts have no ids; a row of ``docs`` is a row here.
    """
    return sentencepiece.encode_documents(docs, sentencepiece.load(MODEL))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_documents),
    ("mixing", mixed_sources),
    ("sentencepiece", token_ids),
]

#: Language models, rounding by hashes and piece merging have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again; a stage's table goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
