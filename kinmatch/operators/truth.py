"""Ground truth: parsing, pairs that resolve to records, labels and blocking recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_truth(raw: DataFrame) -> DataFrame:
    """source1_entity_id, matched_entity_ids (comma list): s1_id, ids (a sorted set, maybe empty)."""
    parts = F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x))
    ids = F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))
    return raw.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("ids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("ids").alias("t_id"))


def truth_counts(truth: DataFrame) -> DataFrame:
    """Every anchor with its number of matches; ids without a record count too."""
    return truth.select("s1_id", F.size("ids").cast("long").alias("truth_cnt"))


def resolved_pairs(truth: DataFrame, records: DataFrame) -> DataFrame:
    """The pairs both of whose ids have a record: a_id, b_id."""
    ids = records.select("entity_id")
    pairs = truth_pairs(truth).select(F.col("s1_id").alias("a_id"), F.col("t_id").alias("b_id")).distinct()
    return pairs.join(ids, pairs["a_id"] == ids["entity_id"], "left_semi").join(ids, pairs["b_id"] == ids["entity_id"], "left_semi")


def label(pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    marked = resolved.select("a_id", "b_id", F.lit(1).alias("_hit"))
    return pairs.join(marked, ["a_id", "b_id"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def blocking_recall(resolved: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """scope (all, target or country), value, hits, pairs, recall."""
    hit = pairs.select("a_id", "b_id", F.lit(1).alias("hit"))
    b = records.select(F.col("entity_id").alias("b_id"), F.col("source").alias("target"))
    a = records.select(F.col("entity_id").alias("a_id"), "country_key")
    rows = resolved.join(hit, ["a_id", "b_id"], "left").join(b, "b_id").join(a, "a_id")
    per = rows.groupingSets([[], ["target"], ["country_key"]], "target", "country_key").agg(
        F.grouping_id().alias("g"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("pairs")
    )
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "target").otherwise("country")
    value = F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("target")).otherwise(F.col("country_key"))
    return per.select(scope.alias("scope"), value.alias("value"), "hits", "pairs", F.round(F.col("hits") / F.col("pairs"), 6).alias("recall"))


def positive_rate(labelled: DataFrame) -> float:
    """The share of pairs with label 1; 0 without pairs."""
    return labelled.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
