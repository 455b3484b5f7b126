"""Helpers shared by the corpus operators: tables, text expressions, lineage cuts and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import release  # noqa: F401
from ..staging import stage as cut  # noqa: F401  writes a table to the shared folder and reads it back

#: A word is a maximal run of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side of a join is broadcast only when it was counted and has no more rows, and bytes of text and binary, than these.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sized(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, with at most `most_bytes` of text and binary; else as it is, so that Spark
    shuffles the join.

    df should be cheap to count (a table from cut() or a small aggregate of one).
    """
    wide = [F.octet_length(f"`{f.name}`") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)).cast("long") for x in wide), F.lit(0).cast("long"))), F.lit(0))
    rows, held = df.limit(most + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if rows <= most and held <= most_bytes else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that no column of df has, in any case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
        held.add(name.lower())
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched. lower() is the same on pure ASCII and much faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(id)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def with_text_ids(docs: DataFrame) -> DataFrame:
    """doc_id as text, and text: pandas holds integers with nulls among them as floats, which can't tell large ones apart."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
