"""Exact dedup by skew-safe combining.

1. Each input partition collapses its own equal texts (map-side aggregation).
2. What is left meets by digest, salt and text: a hot text is spread over SALTS tasks.
3. The salts' winners, at most SALTS rows per text, meet globally by digest and text.

The whole normalised text is part of the grouping key in each stage, so texts that merely share a digest never merge. The
way back to the rows joins on the digest alone unless some digest has two texts; then it joins on the text as well.

Defined cases: null text counts as empty, and all empty texts form one group. Of equal texts the row with the largest
doc_id stays; where the largest id occurs twice (repeated rows), every row of that id is marked kept, and deduplicate()
keeps one of them. A null id is smaller than any other. Texts are compared whole, however long. An empty table gives an empty result. Further
columns, whatever their names, are carried by deduplicate() and ignored by classes().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, documents, fresh

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows (doc_id, digest, norm): one row per text with keep_id and group_size."""
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def classes(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """docs (doc_id, text): doc_id, digest, keep_id, group_size for every row."""
    rows = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    rows = rows.select("doc_id", digest(F.col("norm")).alias("digest"), "norm")
    found = combine(rows, salts).groupBy("digest")
    found = found.agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    found = cut(found, "exact")
    if found.where("texts > 1").isEmpty():
        keys, right = ["digest"], found.drop("texts")
    else:
        keys, right = ["digest", "norm"], combine(rows, salts)
    # Rows without a copy need no partner; the few groups left are joined, large ones by Spark's split of skewed partitions.
    right = right.where("group_size > 1")
    return rows.join(right, keys, "left").select(
        "doc_id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, the one with the largest doc_id.

    The whole text moves in two aggregations, as in combine(), which also keep one of several rows with that id.
    """
    norm = ascii_lower(F.coalesce(docs["text"], F.lit("")))
    digest, own, h = keys = fresh(docs, "digest", "own", "h")
    # Of rows with the largest id, the one with the largest checksum of its columns.
    held = docs.withColumns({digest: sha256(norm), own: docs["doc_id"], h: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])})
    best = F.max("rank").alias("rank")
    rows = held.select(F.col(digest).alias("digest"), norm.alias("norm"), F.struct(F.col(own).alias("own"), F.col(h).alias("h")).alias("rank"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rank"), F.lit(salts)).cast("int"))
    kept = salted.groupBy("digest", "salt", "norm").agg(best).groupBy("digest", "norm").agg(best)
    kept = cut(kept.select("digest", "rank.own", "rank.h"), "exact")
    same = (held[digest] == kept["digest"]) & held[own].eqNullSafe(kept["own"]) & (held[h] == kept["h"])
    # Rows that are equal in every column remain together; the join's partitioning serves to keep one of them.
    return held.join(kept, same, "left_semi").dropDuplicates(keys).drop(*keys)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP4_SQL = """
WITH n AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents
), g AS (
    SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
    FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
