"""The corpus pipeline: five stages, each over everything that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs, whatever further columns there are and however they are named.

Defined cases: a null or empty text has no letters, so the first stage drops it, like other texts without letters and those whose n-grams are
hardly known to any language. Texts are used whole at any length. Of equal texts the largest doc_id stays (repeated rows: one of them), of near copies
the smallest. Rows without an id stay or go like others; they sort below all ids. A row taken twice by the mix is packed twice. An empty table gives
an empty result at every stage; without any row to learn languages from, everything is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import exact_dedup, langid, mixing, near_dedup, packing
from kinmatch.llm.common import cut, documents, fresh


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or hardly any known n-grams."""
    verdict = langid.identifier(spark, langid.learn(docs, langid.held_in(F.col("doc_id"))))
    (v,) = fresh(docs, "verdict")
    rows = docs.withColumn(v, verdict(docs["text"]))
    return rows.where((F.col(f"{v}.lang") != "und") & (F.col(f"{v}.cover") >= langid.LEAST_COVER)).drop(v)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; a repeated document's copies are packed one by one."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID's model, near-duplicate components and the tokeniser have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
