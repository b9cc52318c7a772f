"""The corpus pipeline: documents in, a deduplicated, decontaminated, redacted mixture out.

Every stage takes all that its predecessor kept. All but the last give the columns of documents.

In every stage: whole texts are read, whatever their length; extra columns pass through, whatever they are called; equal rows fare equally; an empty
table gives an empty one. Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm import decontam, jaccard, langid, mixing, pii
from corpuscope.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. The network is fitted on a bounded sample of the documents' own labels.

    A document with a null or empty text, or one without letters, goes; null labels, ids and sources don't matter. Of equally likely languages the first in the alphabet counts.
    """
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones.

    Rows with a null id, and null or empty texts, are similar to nothing and stay. Repeated rows of a document that stays stay.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Rows with a null id or text, and texts shorter than a passage, stay. An id that is repeated goes with all its rows if one of them has a passage.
    """
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers redacted; n_chars follows the text where it changed. Null and empty texts stay as they are."""
    return pii.redact(docs, length_col="n_chars").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mixture of sources; adds mix_tokens, mix_key and mix_copies.

    A null source is a source of its own; a null or empty text has no tokens; rows with a null id go, as they have no key. Ties of the key are in order of the text's hash.
    """
    return mixing.mix_sources(docs, mixing.TARGETS, mixing.quality_weights(table(spark, sf_dir, "labels")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("private_data", private_data), ("mixture", mixture)]
#: A trained network decides in the first stage, and transducers rewrite texts in the fourth, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
