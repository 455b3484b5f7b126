"""F0.5 per anchor and its mean over all anchors, those without matches included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(pred: Column, truth: Column, tp: Column) -> Column:
    """1 if nothing was due and nothing given, 0 if nothing was right, else 1.25 P R / (0.25 P + R)."""
    p, r = tp / pred, tp / truth
    score = 1.25 * p * r / (0.25 * p + r)
    return F.when((pred == 0) & (truth == 0), 1.0).when((pred == 0) | (truth == 0) | (tp == 0), 0.0).otherwise(score)


def entity_scores(anchors: DataFrame, predicted: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """anchors (s1_id, ...), predicted (a_id, b_id), truth_pairs (s1_id, t_id): anchors with pred, truth_cnt, tp, f05."""
    given = predicted.select("a_id", "b_id").distinct()
    due = truth_pairs.select(F.col("s1_id").alias("a_id"), F.col("t_id").alias("b_id"), F.lit(1).alias("hit")).distinct()
    n_due = due.groupBy("a_id").agg(F.count(F.lit(1)).alias("truth_cnt"))
    n_given = given.join(due, ["a_id", "b_id"], "left").groupBy("a_id").agg(F.count(F.lit(1)).alias("pred"), F.count("hit").alias("tp"))
    both = n_due.join(n_given, "a_id", "full")
    rows = anchors.join(both, anchors["s1_id"] == both["a_id"], "left").drop("a_id")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("pred", "truth_cnt", "tp")})
    return rows.withColumn("f05", f05(F.col("pred"), F.col("truth_cnt"), F.col("tp")))


def macro_f05(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("n"))


def macro_by_country(scores: DataFrame) -> DataFrame:
    return scores.groupBy("country_key").agg(F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("n"))


def empty_baseline(counts: DataFrame) -> DataFrame:
    """The score of predicting nothing, which is the share of anchors without a match."""
    return counts.agg(F.avg((F.col("truth_cnt") == 0).cast("double")).alias("macro_f05"))
