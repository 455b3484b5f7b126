"""Candidate pairs by weighted votes over shared keys.

An anchor gets w votes for a target with each of its keys that the target has too. Anchor keys count as often as they occur, target
keys once. Keys that more than max_bucket target rows of a source and country share are left out, which also bounds what an
anchor key can fan out to. The max_cand targets with most votes are kept per anchor and source, ties by id. Votes are whole tenths, so sums
don't depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that make no name key.
COMMON_NAME_WORDS = [
    "the", "and", "of", "co", "inc", "ltd", "llc", "corp", "company", "limited", "private", "pvt",
    "group", "services", "service", "international", "national", "enterprises", "trading", "traders",
]
# Words that make no address key.
COMMON_ADDRESS_WORDS = [
    "no", "floor", "flr", "unit", "near", "opp", "opposite", "plot", "door", "house", "shop", "office",
    "ground", "road", "rd", "street", "st", "colony", "layout", "sector", "nagar", "east", "west",
    "north", "south", "new", "old", "main", "cross",
]
# Votes of a key, in tenths.
WEIGHTS = {"tok": 30, "pre4": 20, "ng4": 4, "pin": 80, "apre6": 10, "atok": 25, "num": 15}


@dataclass(frozen=True)
class BlockingConfig:
    same_country: bool = True
    max_bucket: int = 1000
    max_cand: int = 50


def name_keys(core: Column) -> Column:
    common = F.array(*map(F.lit, COMMON_NAME_WORDS))
    return F.filter(T.tokens(core), lambda t: (F.length(t) >= 3) & ~F.array_contains(common, t))


def address_keys(core: Column) -> Column:
    common = F.array(*map(F.lit, COMMON_ADDRESS_WORDS))
    return F.filter(T.tokens(core), lambda t: (F.length(t) >= 4) & ~F.array_contains(common, t) & ~t.rlike(r"^\p{Nd}+$"))


def _prefix(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array(F.substring(text, 1, n))).otherwise(F.array().cast("array<string>"))


def key_lists(records: DataFrame) -> dict[str, Column]:
    name, address = T.compact(F.col("name_core")), T.compact(F.col("addr_core"))
    return {
        "tok": name_keys(F.col("name_core")),
        "pre4": _prefix(name, 4),
        "ng4": T.char_grams(name, 4),
        "pin": F.col("postal"),
        "apre6": _prefix(address, 6),
        "atok": address_keys(F.col("addr_core")),
        "num": F.col("nums"),
    }


def _typed(keys: Column, kind: str) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("ktype"), k.alias("key"), F.lit(WEIGHTS[kind]).alias("weight")))


def blocking_keys(records: DataFrame, same_country: bool = True) -> DataFrame:
    """entity_id, source, country_key, ktype, key, weight: a row per occurrence for anchors, per key for targets."""
    country = F.col("country_key") if same_country else F.lit("")
    typed = []
    for kind, keys in key_lists(records).items():
        held = F.when(F.col("source") == "S1", keys).otherwise(F.array_distinct(keys))
        typed.append(_typed(held, kind))
    return records.select("entity_id", "source", country.alias("country_key"), F.explode(F.concat(*typed)).alias("k")).select(
        "entity_id", "source", "country_key", "k.*"
    )


BUCKET = ["country_key", "source", "ktype", "key"]


def bucket_sizes(keys: DataFrame) -> DataFrame:
    return keys.where("source <> 'S1'").groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"))


def target_keys(keys: DataFrame, max_bucket: int) -> DataFrame:
    """Target keys without oversized buckets. Those are few (at most rows / max_bucket), so Spark can broadcast the anti-join."""
    large = bucket_sizes(keys).where(F.col("n") > max_bucket)
    return keys.where("source <> 'S1'").join(large, BUCKET, "left_anti")


def votes(keys: DataFrame, max_bucket: int = 1000) -> DataFrame:
    """a_id, b_id, target, score (tenths). What an anchor and a source share comes together, so that top_candidates() deals out nothing anew."""
    a = keys.where("source = 'S1'").select(F.col("entity_id").alias("a_id"), "country_key", "ktype", "key", "weight")
    b = target_keys(keys, max_bucket).select(F.col("entity_id").alias("b_id"), F.col("source").alias("target"), "country_key", "ktype", "key")
    return a.join(b, ["country_key", "ktype", "key"]).repartition("a_id", "target").groupBy("a_id", "b_id", "target").agg(F.sum("weight").alias("score"))


def top_candidates(scored: DataFrame, max_cand: int = 50) -> DataFrame:
    best = Window.partitionBy("a_id", "target").orderBy(F.col("score").desc(), "b_id")
    return scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= max_cand).drop("rn")


def candidates(records: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    return top_candidates(votes(blocking_keys(records, config.same_country), config.max_bucket), config.max_cand)


def best_votes(scored: DataFrame) -> DataFrame:
    return scored.groupBy("a_id").agg(F.max("score").alias("best"))


def weak_entities(records: DataFrame, scored: DataFrame, threshold_tenths: int = 30) -> DataFrame:
    """Anchors whose best vote is below the threshold; none counts as 0."""
    anchors = records.where("source = 'S1'").select(F.col("entity_id").alias("a_id"))
    best = F.coalesce("best", F.lit(0)).cast("long")
    return anchors.join(best_votes(scored), "a_id", "left").select("a_id", best.alias("best")).where(F.col("best") < threshold_tenths)


def sparse_entities(records: DataFrame, pairs: DataFrame, fewer_than: int = 5) -> DataFrame:
    """Anchors with fewer candidates than that."""
    anchors = records.where("source = 'S1'").select(F.col("entity_id").alias("a_id"))
    counts = pairs.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"))
    return anchors.join(counts, "a_id", "left").select("a_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < fewer_than)
