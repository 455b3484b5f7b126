"""From pair probabilities to match lists, and the search for the thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metric import f05

#: 0.30, 0.32, ... 0.98
GRID = tuple(round(x / 100, 2) for x in range(30, 99, 2))


def best_per_target(scored: DataFrame) -> DataFrame:
    """Of each target's pairs the one with the highest p, ties by anchor id. An anchor may keep many targets."""
    best = Window.partitionBy("b_id").orderBy(F.col("p").desc(), "a_id")
    return scored.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def over_threshold(scored: DataFrame, thr2: float, thr3: float) -> DataFrame:
    return scored.where(F.col("p") >= F.when(F.col("src") == 0, F.lit(thr2)).otherwise(F.lit(thr3)))


def predictions(scored: DataFrame, thr2: float, thr3: float, one_to_one: bool = True) -> DataFrame:
    return over_threshold(best_per_target(scored) if one_to_one else scored, thr2, thr3).select("a_id", "b_id")


def id_lists(anchors: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """One row per anchor (s1_id, further columns kept) with its targets as a sorted comma list, empty without any."""
    lists = pairs.groupBy("a_id").agg(F.array_join(F.array_sort(F.collect_set("b_id")), ",").alias(column))
    joined = anchors.join(lists, anchors["s1_id"] == lists["a_id"], "left").drop("a_id")
    return joined.withColumn(column, F.coalesce(column, F.lit("")))


def _steps(p: Column, grid: tuple[float, ...]) -> Column:
    """How many thresholds of the grid p reaches; a pair is kept at the t-th (from 0) if that is more than t."""
    return sum(((p >= F.lit(g)).cast("int") for g in grid[1:]), (p >= F.lit(grid[0])).cast("int"))


def threshold_scores(scored: DataFrame, counts: DataFrame, one_to_one: bool = True, grid: tuple[float, ...] = GRID) -> DataFrame:
    """thr2, thr3, macro_f05 for every pair of thresholds. scored: a_id, b_id, src, p, label; counts: s1_id, truth_cnt.

    Whether a pair is kept depends only on how many thresholds it reaches. So pairs are summed per anchor, source and
    that number, anchors with the same sums are counted together, and only these signatures meet the grid, whose size is fixed.
    """
    n = len(grid)
    best = (best_per_target(scored) if one_to_one else scored).withColumn("step", _steps(F.col("p"), grid))
    cell = best.where("step > 0").groupBy("a_id", "src", "step").agg(F.count(F.lit(1)).alias("pred"), F.sum("label").cast("long").alias("tp"))
    signature = cell.groupBy("a_id").agg(F.array_sort(F.collect_list(F.struct("src", "step", "pred", "tp"))).alias("cells"))
    anchors = counts.join(signature, counts["s1_id"] == signature["a_id"], "left")
    empty = F.array().cast("array<struct<src:int,step:int,pred:bigint,tp:bigint>>")
    cells = F.coalesce(F.col("cells").cast("array<struct<src:int,step:int,pred:bigint,tp:bigint>>"), empty)
    alike = anchors.select("truth_cnt", cells.alias("cells")).groupBy("truth_cnt", "cells").agg(F.count(F.lit(1)).alias("entities"))
    # len(grid) values, exploded in place of a join
    ts = F.sequence(F.lit(0), F.lit(n - 1))
    alike = alike.withColumn("t2", F.explode(ts)).withColumn("t3", F.explode(ts))
    kept = F.filter("cells", lambda c: c["step"] > F.when(c["src"] == 0, F.col("t2")).otherwise(F.col("t3")))
    alike = alike.withColumn("kept", kept)
    add = lambda field: F.aggregate("kept", F.lit(0).cast("long"), lambda acc, c: acc + c[field])
    alike = alike.select("t2", "t3", "entities", f05(add("pred"), F.col("truth_cnt"), add("tp")).alias("f"))
    # exact decimals, so that equal sums tie whatever their order
    total = F.sum((F.col("f").cast("decimal(20,15)") * F.col("entities")).cast("decimal(38,15)"))
    value = F.element_at(F.array(*map(F.lit, grid)), F.col("t2") + 1), F.element_at(F.array(*map(F.lit, grid)), F.col("t3") + 1)
    out = alike.groupBy("t2", "t3").agg((total.cast("double") / F.sum("entities")).alias("macro_f05"))
    return out.select(value[0].alias("thr2"), value[1].alias("thr3"), "macro_f05")


@dataclass(frozen=True)
class Thresholds:
    thr2: float
    thr3: float
    macro_f05: float


def tune_thresholds(scored: DataFrame, counts: DataFrame, one_to_one: bool = True, grid: tuple[float, ...] = GRID) -> Thresholds:
    """The best thresholds; among equals the highest for S2, then for S3."""
    rows = threshold_scores(scored, counts, one_to_one, grid)
    best = rows.orderBy(F.col("macro_f05").desc(), F.col("thr2").desc(), F.col("thr3").desc()).first()
    return Thresholds(*best) if best and best[2] is not None else Thresholds(0.5, 0.5, -1.0)
