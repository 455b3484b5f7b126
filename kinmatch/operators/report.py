"""Reports on sources and ground truth, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .truth import truth_counts, truth_pairs


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "country").agg(F.count(F.lit(1)).alias("n"))


def empty_rates(records: DataFrame) -> DataFrame:
    rate = lambda c: F.round(F.avg((F.coalesce(c, F.lit("")) == "").cast("double")), 6)
    return records.groupBy("source").agg(rate("business_name").alias("empty_name"), rate("business_address").alias("empty_address"))


def singleton_rate(truth: DataFrame) -> DataFrame:
    return truth_counts(truth).agg(F.round(F.avg((F.col("truth_cnt") == 0).cast("double")), 6).alias("singleton_rate"))


def match_histogram(truth: DataFrame, first: int = 10) -> DataFrame:
    return truth_counts(truth).groupBy(F.col("truth_cnt").alias("matches")).agg(F.count(F.lit(1)).alias("entities")).orderBy("matches").limit(first)


def multi_claimed(truth: DataFrame) -> DataFrame:
    """How many claims a target has beyond its first, in all."""
    return truth_pairs(truth).agg((F.count("t_id") - F.countDistinct("t_id")).alias("extra_claims"))


def matched_share(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Per target source: claims by prefix of the id over the source's rows."""
    claims = truth_pairs(truth).groupBy(F.substring("t_id", 1, 2).alias("source")).agg(F.count(F.lit(1)).alias("claims"))
    rows = records.where("source <> 'S1'").groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    share = F.round(F.coalesce("claims", F.lit(0)) / F.col("rows"), 6)
    return rows.join(claims, "source", "left").select("source", share.alias("share"))


def cross_country(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Matches whose raw country labels differ."""
    pairs = truth_pairs(truth)
    a = records.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("ca"))
    b = records.select(F.col("entity_id").alias("t_id"), F.col("country").alias("cb"))
    return pairs.join(a, "s1_id").join(b, "t_id").agg(F.count_if(F.col("ca") != F.col("cb")).alias("cross_country"), F.count(F.lit(1)).alias("pairs"))


def match_both(truth: DataFrame) -> DataFrame:
    per = truth_pairs(truth).groupBy("s1_id").agg(F.bool_or(F.col("t_id").startswith("S2-")).alias("two"), F.bool_or(F.col("t_id").startswith("S3-")).alias("three"))
    return per.agg(F.count_if(F.col("two") & F.col("three")).alias("both"))


def sample(records: DataFrame, source: str, n: int = 5, seed: int = 0) -> DataFrame:
    """n drawn rows of a source."""
    return records.where(F.col("source") == source).orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id").limit(n)


def matched_group(truth: DataFrame, records: DataFrame) -> DataFrame:
    """The first anchor with two matches or more, and its matches."""
    first = truth_counts(truth).where("truth_cnt >= 2").orderBy("s1_id").limit(1).select("s1_id")
    ids = first.select(F.col("s1_id").alias("entity_id")).union(truth_pairs(truth).join(first, "s1_id", "left_semi").select("t_id"))
    return records.join(ids.distinct(), "entity_id", "left_semi").orderBy("source", "entity_id")


def prediction_summary(anchors: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per country: share of anchors with a match, mean matches and mean candidates. anchors: s1_id, country_key."""
    n = lambda df, name: df.groupBy(F.col("a_id").alias("s1_id")).agg(F.count(F.lit(1)).alias(name))
    rows = anchors.join(n(predicted, "m"), "s1_id", "left").join(n(candidates, "c"), "s1_id", "left").na.fill(0, ["m", "c"])
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy("country_key").agg(mean(F.col("m") > 0).alias("match_rate"), mean(F.col("m")).alias("avg_matches"), mean(F.col("c")).alias("avg_candidates"))
