"""Train and validation parts by anchor, and subsamples. Draws are hashes of ids, so they are the same in any run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import country_key
from .truth import truth_pairs


@dataclass(frozen=True)
class Tables:
    s1: DataFrame
    s2: DataFrame
    s3: DataFrame
    truth: DataFrame | None = None


def draw(entity_id: Column, seed: int) -> Column:
    return F.md5(F.concat(entity_id.cast("string"), F.lit(f"|{seed}")))


def uniform(entity_id: Column, seed: int) -> Column:
    return F.conv(F.substring(draw(entity_id, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def validation_flags(s1: DataFrame, val_frac: float = 0.2, seed: int = 42, holdout_country: str | None = None) -> DataFrame:
    """entity_id, country_key, is_val: in each country exactly the rounded share (half to even), or one country."""
    rows = s1.select("entity_id", country_key(F.col("country")).alias("country_key"))
    if holdout_country is not None:
        return rows.withColumn("is_val", F.col("country_key") == holdout_country.strip().lower())
    group = Window.partitionBy("country_key")
    rn = F.row_number().over(group.orderBy(draw(F.col("entity_id"), seed), "entity_id"))
    rows = rows.withColumns({"_rn": rn, "_n": F.count(F.lit(1)).over(group)})
    return rows.select("entity_id", "country_key", (F.col("_rn") <= F.bround(F.col("_n") * val_frac)).alias("is_val"))


def owners(truth: DataFrame) -> DataFrame:
    """t_id, owner: the anchor that claims a target; of several, the smallest."""
    return truth_pairs(truth).groupBy("t_id").agg(F.min("s1_id").alias("owner"))


def target_flags(targets: DataFrame, truth: DataFrame, flags: DataFrame, val_frac: float = 0.2, seed: int = 42, holdout_country: str | None = None) -> DataFrame:
    """targets with is_val: a matched target follows its owner, an orphan is drawn or goes by its own country."""
    own = owners(truth).join(flags.select(F.col("entity_id").alias("owner"), F.col("is_val").alias("_owner_val")), "owner", "left")
    joined = targets.join(own, targets["entity_id"] == own["t_id"], "left")
    if holdout_country is not None:
        orphan = country_key(F.col("country")) == holdout_country.strip().lower()
    else:
        orphan = uniform(F.col("entity_id"), seed) < val_frac
    side = F.when(F.col("owner").isNotNull(), F.coalesce("_owner_val", F.lit(False))).otherwise(orphan)
    return joined.withColumn("is_val", side).drop("t_id", "owner", "_owner_val")


def make_split(tables: Tables, val_frac: float = 0.2, seed: int = 42, holdout_country: str | None = None) -> tuple[Tables, Tables]:
    flags = validation_flags(tables.s1, val_frac, seed, holdout_country)
    s1 = tables.s1.join(flags.drop("country_key"), "entity_id")
    sides = [s1, *[target_flags(t, tables.truth, flags, val_frac, seed, holdout_country) for t in (tables.s2, tables.s3)]]
    val_ids = flags.where("is_val").select(F.col("entity_id").alias("s1_id"))
    truths = [tables.truth.join(val_ids, "s1_id", "left_anti"), tables.truth.join(val_ids, "s1_id", "left_semi")]
    train = Tables(*[s.where("NOT is_val").drop("is_val") for s in sides], truths[0])
    val = Tables(*[s.where("is_val").drop("is_val") for s in sides], truths[1])
    return train, val


def subsample(tables: Tables, max_s1: int | None, seed: int = 0) -> Tables:
    """max_s1 drawn anchors with their matches and the same share of orphans; everything if that isn't fewer."""
    n = tables.s1.count() if max_s1 is not None else 0
    if max_s1 is None or max_s1 >= n:
        return tables
    share = max_s1 / n
    keep = tables.s1.select("entity_id").orderBy(draw(F.col("entity_id"), seed), "entity_id").limit(max_s1)
    own = owners(tables.truth)
    kept = own.join(keep, own["owner"] == keep["entity_id"], "left_semi").select("t_id", F.lit(True).alias("_kept"))

    def side(df: DataFrame) -> DataFrame:
        held = df.join(own.select("t_id", F.lit(True).alias("_owned")), df["entity_id"] == F.col("t_id"), "left").drop("t_id")
        held = held.join(kept, held["entity_id"] == kept["t_id"], "left").drop("t_id")
        stays = F.when(F.col("_owned"), F.coalesce("_kept", F.lit(False))).otherwise(uniform(F.col("entity_id"), seed) < share)
        return held.where(stays).drop("_owned", "_kept")

    ids = keep.select(F.col("entity_id").alias("s1_id"))
    return Tables(tables.s1.join(keep, "entity_id", "left_semi"), side(tables.s2), side(tables.s3), tables.truth.join(ids, "s1_id", "left_semi"))
