"""Sharding: a keyed Feistel permutation with cycle walking over global row numbers.

The row at permuted position p goes to shard p mod S, slot p div S. So row counts of shards differ by one at most (law
`rows`), slots have no gaps, and both can be computed from the row number alone.

Global row numbers need no global sort: rows fall into hash buckets, a bucket's rows are ordered by their hash, and the
bucket's first number is the count of rows in the buckets before it. Rows that are equal in id, size and checksum are
first counted together, so that a row repeated by a third of the table is one row until it is numbered, RANGE copies at a time.

Defined cases: null text counts as empty (size 16, checksum 0). Null and repeated ids are rows like any others. An empty
table gives an empty result. Further columns are ignored. Texts of any length are read once, for size and checksum. Rows tied in their hash are
ordered by id, size and checksum; rows tied in those too are interchangeable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, sized

SHARDS = 40
SEED = 20_240_917
ROUNDS = 6
BUCKET_ROWS = 100_000
#: Copies of one row that one task numbers.
RANGE = 100_000
#: Steps of a walk beyond which the query fails rather than go on. With 4,096 rows or fewer no walk is longer; with more, the chance of one is
#: below (1 / sqrt(rows)) ** 64.
MOST_STEPS = 64


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A bijection of 0 .. a*b-1: an alternating Feistel network over Z_a x Z_b."""
    left, right = F.pmod(x, F.lit(a)), F.floor(x / F.lit(a)).cast("long")
    for j in range(ROUNDS):
        m = F.lit(a if j % 2 == 0 else b)
        left, right = right, F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(j)), m), m)
    return right * F.lit(a) + left


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number x (0 .. n-1) in a keyed permutation of 0 .. n-1, by walking cycles of feistel()."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))
    outside = a * b - n  # a walk meets each outer point once at most
    first = feistel(x, a, b, seed)
    if not outside:
        return first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(min(outside, MOST_STEPS))),
        first,
        lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed)),
    )
    walk = F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a cycle walk is too long")).cast("long"))
    return F.when(first < n, first).otherwise(walk)


def numbered(rows: DataFrame, keys: list[str], n: int, most: int, seed: int = SEED) -> DataFrame:
    """Adds row_number (0 .. n-1), which depends on the rows alone and not on how they are partitioned.

    rows: distinct keys and `copies`, the number of times that each occurs (`most` at most).
    """
    buckets = max(1, n // BUCKET_ROWS)
    rows = rows.withColumn("h", F.xxhash64(*keys, F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    # one row for each BUCKET_ROWS rows
    starts = rows.groupBy("bucket").agg(F.sum("copies").alias("held"))
    starts = starts.select("bucket", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("h", *keys)
    rows = rows.withColumn("past", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(sized(starts), "bucket")
    rows = rows.withColumn("part", F.explode(F.expr(f"sequence(0, (copies - 1) div {RANGE})")))
    if most > RANGE:  # copies of one row are spread over tasks
        rows = rows.repartition("h", "part")
    copy = F.sequence(F.col("part") * RANGE + 1, F.least(F.col("copies"), (F.col("part") + 1) * RANGE))
    return (
        rows.withColumn("copy", F.explode(copy))
        .withColumn("row_number", F.col("start") + F.col("past") - F.col("copy"))
        .drop("h", "bucket", "start", "past", "part", "copy", "copies")
    )


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text): doc_id, size, text_crc32, position, shard, slot for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    keys = slim.columns
    slim = cut(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")), "shard")
    n, most = slim.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    rows = numbered(slim, keys, n, most, seed)
    return rows.select(*keys, permuted(F.col("row_number"), n, seed).alias("position")).select(
        *keys,
        "position",
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
