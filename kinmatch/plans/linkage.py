"""The linkage run: records, candidates, features, model, thresholds and match lists.

Records, candidates and features are each read more than once and so are written to the shared folder between steps; a run goes
on from there when executors are lost.
"""

from __future__ import annotations

import subprocess
import sys
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, decode, features, metric, model, rescue, split, truth
from ..operators.records import assert_unique, build_records, country_key
from ..operators.report import prediction_summary
from ..operators.split import Tables
from ..sources import tsv
from ..staging import stage
from .config import RunConfig

EmbedFn = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class RescueConfig:
    """Which anchors get nearest neighbours: by quality of the best vote (tenths), or by number of candidates."""

    top_k: int = 10
    sim_min: float = 0.5
    by_quality: bool = True
    quality_tenths: int = 80
    fewer_than: int = 5


@dataclass(frozen=True)
class PairTable:
    records: DataFrame
    pairs: DataFrame
    features: DataFrame
    resolved: DataFrame | None = None


def rescue_pairs(records: DataFrame, scored: DataFrame, pairs: DataFrame, embed_fn: EmbedFn, config: RescueConfig, same_country: bool = True) -> DataFrame:
    weak = blocking.weak_entities(records, scored, config.quality_tenths) if config.by_quality else blocking.sparse_entities(records, pairs, config.fewer_than)
    country = F.col("country_key") if same_country else F.lit("")
    pool = records.where("source <> 'S1'")
    anchors = records.join(weak.select(F.col("a_id").alias("entity_id")), "entity_id", "left_semi")
    vectors = stage(rescue.embed(anchors.select("entity_id", "business_name").union(pool.select("entity_id", "business_name")), embed_fn), "vectors")
    keyed = records.select("entity_id", F.col("source").alias("target"), country.alias("country_key"))
    anchors = anchors.select("entity_id").join(keyed.drop("target"), "entity_id").join(vectors, "entity_id").withColumnRenamed("entity_id", "a_id")
    pool = keyed.where("target <> 'S1'").join(vectors, "entity_id").withColumnRenamed("entity_id", "b_id")
    return rescue.nearest(anchors, pool, config.top_k, config.sim_min)


def build_pair_table(tables: Tables, config: RunConfig, embed_fn: EmbedFn | None = None, rescue_config: RescueConfig = RescueConfig()) -> PairTable:
    """Records, candidates (with neighbours if an embedding is given) and features, labelled where truth is known."""
    records = stage(build_records(tables.s1, tables.s2, tables.s3), "records")
    assert_unique(records)
    keys = stage(blocking.blocking_keys(records, config.block.same_country), "keys")  # read by anchors, targets and bucket sizes
    scored = blocking.votes(keys, config.block.max_bucket)
    if embed_fn is not None:
        scored = stage(scored, "votes")
    pairs = blocking.top_candidates(scored, config.block.max_cand).select("a_id", "b_id")
    if embed_fn is not None:
        pairs = rescue.with_rescue(pairs, rescue_pairs(records, scored, pairs, embed_fn, rescue_config, config.block.same_country))
    pairs = stage(pairs, "pairs")
    rows, resolved = features.build_features(pairs, records), None
    if tables.truth is not None:
        resolved = truth.resolved_pairs(tables.truth, records)
        rows = truth.label(rows, resolved)
    return PairTable(records, pairs, stage(rows, "features"), resolved)


@dataclass(frozen=True)
class Validation:
    config: RunConfig
    model: PipelineModel
    scored: DataFrame
    recall: DataFrame
    macro: DataFrame
    by_country: DataFrame
    baseline: DataFrame
    importances: list[tuple[str, float]]
    positive_rate: float


def anchors_of(tables: Tables) -> DataFrame:
    order = F.col("ordinal") if "ordinal" in tables.s1.columns else F.col("entity_id")
    return tables.s1.select(F.col("entity_id").alias("s1_id"), country_key(F.col("country")).alias("country_key"), order.alias("ordinal"))


def validate(tables: Tables, config: RunConfig = RunConfig(), val_frac: float = 0.2, embed_fn: EmbedFn | None = None, seed: int = 42) -> Validation:
    """Splits by anchor, fits on the train part and tunes thresholds on the validation part."""
    train, val = split.make_split(split.subsample(tables, config.max_s1), val_frac, seed, config.holdout_country)
    a, b = build_pair_table(train, config, embed_fn), build_pair_table(val, config, embed_fn)
    fitted = model.fit(a.features, config.features, config.gbt, b.features)
    scored = stage(model.score(b.features, fitted, config.features), "scored")
    counts = truth.truth_counts(val.truth)
    anchors = anchors_of(val)
    counts = anchors.join(counts, "s1_id", "left").select("s1_id", F.coalesce("truth_cnt", F.lit(0)).alias("truth_cnt"))
    best = decode.tune_thresholds(scored, counts, config.one_to_one)
    predicted = decode.predictions(scored, best.thr2, best.thr3, config.one_to_one)
    scores = stage(metric.entity_scores(anchors, predicted, truth.truth_pairs(val.truth)), "scores")
    macro = metric.macro_f05(scores)
    value = macro.first()["macro_f05"]
    if value is not None and abs(value - best.macro_f05) > 1e-6:
        raise AssertionError(f"the search found {best.macro_f05}, the metric {value}")
    held = replace(config, best_iter=model.best_iteration(fitted), thr2=best.thr2, thr3=best.thr3, val_f05=value or 0.0)
    return Validation(
        held, fitted, scored, truth.blocking_recall(b.resolved, b.pairs, b.records), macro, metric.macro_by_country(scores),
        metric.empty_baseline(counts), model.importances(fitted, config.features), truth.positive_rate(a.features),
    )


def fit_final(tables: Tables, config: RunConfig, embed_fn: EmbedFn | None = None, max_s1: int | None = None) -> PipelineModel:
    """The model of all labelled pairs, with more trees than validation needed."""
    built = build_pair_table(split.subsample(tables, max_s1), config, embed_fn, RescueConfig(by_quality=False, fewer_than=999))
    return model.fit(built.features, config.features, replace(config.gbt, max_iter=model.refit_iterations(config.best_iter)))


@dataclass(frozen=True)
class Prediction:
    matches: DataFrame
    candidates: DataFrame
    summary: DataFrame


def predict(tables: Tables, fitted: PipelineModel, config: RunConfig, embed_fn: EmbedFn | None = None) -> Prediction:
    """Match and candidate lists, one row per anchor."""
    built = build_pair_table(replace(tables, truth=None), config, embed_fn)
    scored = model.score(built.features, fitted, config.features)
    kept = stage(decode.predictions(scored, config.thr2, config.thr3, config.one_to_one), "matches")
    anchors = anchors_of(tables)
    return Prediction(
        decode.id_lists(anchors, kept, "matched_entity_ids"),
        decode.id_lists(anchors, built.pairs, "candidate_entity_ids"),
        prediction_summary(anchors, kept, built.pairs),
    )


def check_lists(matches: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """check, failures: one row per anchor in either list, and matches are candidates."""
    ids = anchors.select("s1_id")
    m = matches.select("s1_id", F.split("matched_entity_ids", ",").alias("m"))
    c = candidates.select("s1_id", F.split("candidate_entity_ids", ",").alias("c"))
    once = lambda df: df.groupBy("s1_id").count().join(ids.withColumn("due", F.lit(1)), "s1_id", "full").where("coalesce(count, 0) <> coalesce(due, 0)")
    stray = m.join(c, "s1_id").select(F.explode(F.array_except("m", "c")).alias("x")).where("x <> ''")
    rows = [("matches_per_anchor", once(m)), ("candidates_per_anchor", once(c)), ("matches_are_candidates", stray)]
    out = None
    for name, df in rows:
        one = df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = one if out is None else out.union(one)
    return out


MATCHES, CANDIDATES = "matching_results.tsv", "candidate_pairs.tsv"


def write_prediction(made: Prediction, out_dir: str, single_file: bool = True) -> None:
    tsv.write_id_lists(made.matches, f"{out_dir}/{MATCHES}", "matched_entity_ids", single_file=single_file)
    tsv.write_id_lists(made.candidates, f"{out_dir}/{CANDIDATES}", "candidate_entity_ids", single_file=single_file)


def run_validator(script: str, out_dir: str, test_dir: str) -> int | None:
    """Runs an external validator on the written lists; its exit code, or nothing if there is no such script."""
    if not Path(script).exists():
        return None
    return subprocess.run([sys.executable, script, "--matching", f"{out_dir}/{MATCHES}", "--candidate", f"{out_dir}/{CANDIDATES}", "--test-dir", test_dir], check=False).returncode


def package(out_dir: str, target: str, code_dir: str | None = None, documents: tuple[str, ...] = ()) -> list[str]:
    """A zip of the written lists under output/, the code under code/ and further files; the names in it."""
    left_out = {".git", "dataset", "artifacts", "output", "experiments", "submissions", "tests", "__pycache__"}
    held = [(Path(out_dir) / name, f"output/{name}") for name in (MATCHES, CANDIDATES)]
    if code_dir:
        files = sorted(p for p in Path(code_dir).rglob("*") if p.is_file() and p.suffix != ".log" and not left_out & set(p.relative_to(code_dir).parts))
        held += [(p, f"code/{Path(code_dir).resolve().name}/{p.relative_to(code_dir)}") for p in files]
    held += [(Path(p), Path(p).name) for p in documents]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path, name in held:
            z.write(path, name)
    return [name for _, name in held]


def session(app: str = "kinmatch") -> SparkSession:
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()
