"""A corpus pipeline: language filter, near-duplicate removal, decontamination, masking of personal data, tokens.

Every stage takes a table with the columns of ``documents`` and any others, reads every text whole, and gives an empty
table for an empty one. Nulls and repeated rows are treated as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontam, langid, pii, simhash
from palimpsest.llm.common import key_remainder, table
from palimpsest.llm.queries import LANG_FOLD, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model learns from the documents outside the held-out fold.

    Texts that are null or have no letter go, and all do if no document has a language. A document without an id is not
    learned from; repeated rows stay. Of languages with equal shares the first counts, so ties keep a document."""
    learn = F.coalesce(key_remainder(F.col("doc_id"), LANG_FOLD[0]) != LANG_FOLD[1], F.lit(False))
    found = langid.identify(docs, learn)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates.

    A row that repeats id and text goes, and so does a row without an id if another one without an id has its class; of
    several texts under the smallest id one stays, by their hash. Null and word-less texts are one class."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and word-less texts hold none; repeated rows stay or go together. Without items all documents stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows the text.

    All rows stay. A null text stays null, and its n_chars becomes null."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the bytes that they decode to.

    All rows stay; a null or empty text has no ids."""
    return bpe.with_tokens(docs, *tokenizer()).select("doc_id", "lang", "source", "tokens.*")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

#: No stage but the language filter's "und" rule can be stated in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
