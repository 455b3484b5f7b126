"""The record table: three sources stacked, with the normalised columns that all later steps use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

COLUMNS = ["entity_id", "business_name", "business_address", "country"]
SOURCES = ("S1", "S2", "S3")


def stack(s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    tagged = [df.select(*COLUMNS).withColumn("source", F.lit(tag)) for df, tag in zip((s1, s2, s3), SOURCES, strict=True)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def country_key(country: Column) -> Column:
    """A blank country is a group of its own."""
    return F.lower(T.strip(F.coalesce(country, F.lit(""))))


def normalise(raw: DataFrame) -> DataFrame:
    """Adds country_key, name_norm, name_core, name_acr, addr_core, postal, nums and name_addr. Nulls count as empty."""
    full = raw.withColumns({c: F.coalesce(c, F.lit("")) for c in ("business_name", "business_address", "country")})
    folded = full.withColumns({"_n": T.lower_folded(F.col("business_name")), "_a": T.lower_folded(F.col("business_address"))})
    out = folded.withColumns(
        {
            "country_key": country_key(F.col("country")),
            "name_norm": T.name_norm(F.col("_n")),
            "addr_core": T.address_core(F.col("_a")),
            "postal": T.postal_codes(F.col("business_address")),
            "nums": T.numbers(F.col("business_address")),
        }
    )
    out = out.withColumn("name_core", T.name_core(F.col("name_norm"))).withColumn("name_acr", T.acronym(F.col("name_core")))
    return out.withColumn("name_addr", F.concat("name_core", F.lit(" | "), "addr_core")).drop("_n", "_a")


def build_records(s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    return normalise(stack(s1, s2, s3))


def assert_unique(records: DataFrame) -> None:
    """Fails if an id occurs twice: later steps join on it."""
    twice = records.groupBy("entity_id").count().where("count > 1").select("entity_id").limit(3).collect()
    if twice:
        raise ValueError(f"entity_id is not unique: {', '.join(str(r[0]) for r in twice)}")
