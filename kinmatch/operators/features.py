"""The feature table of candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..staging import collect_garbage, release, stage
from .ranking import add_anchor_ranks, add_rank_features, add_target_ranks
from .tfidf import VIEWS, cosines, record_vectors, rounded, text_dots, view_texts, vocabulary

# The model's features, in order.
FEATURES = [
    "src", "name_char", "name_word", "full_char", "addr_char",
    "n_ratio", "n_tsort", "n_tset", "n_partial", "n_jw", "n_lev", "nfull_tset", "n_len_ratio", "n_tok_jacc",
    "n_first_tok", "n_compact_eq", "n_acr", "n_len_a", "n_len_b",
    "a_ratio", "a_tsort", "a_tset", "a_partial", "a_tok_jacc", "a_len_ratio", "a_missing",
    "pc_eq", "pc_both", "num_jacc", "num_common", "base", "s1_rank", "s1_gap", "t_rank", "t_gap",
]

SIDE = ["name_core", "name_norm", "name_acr", "addr_core", "postal", "nums"]


def with_records(pairs: DataFrame, records: DataFrame, side: list[str] = SIDE) -> DataFrame:
    """pairs with both records as structs a and b, and src (0 for S2, 1 for S3). The rows of an anchor come together."""
    a = records.select(F.col("entity_id").alias("a_id"), F.struct(*side).alias("a"))
    b = records.select(F.col("entity_id").alias("b_id"), F.struct(*side).alias("b"), (F.col("source") == "S3").cast("int").alias("src"))
    return pairs.join(b, "b_id").join(a, "a_id")


def string_features(pairs: DataFrame, records: DataFrame, known: tuple | None = None) -> DataFrame:
    """a_id, b_id, src and all string features; with a vocabulary() the cosines too."""
    sides = [F.col(f"{s}.{c}") for c in ("name_core", "name_norm", "addr_core") for s in ("a", "b")]
    made = {"u": S.aligned(*sides)}
    if known:
        records = records.withColumn("texts", view_texts(VIEWS))
        made["dots"] = text_dots(pairs.sparkSession, known, VIEWS)("a.texts", "b.texts")
    rows = with_records(pairs, records, [*SIDE, "texts"] if known else SIDE)
    rows = rows.select("a_id", "b_id", "src", *[e.alias(c) for c, e in S.native_features().items()], *[e.alias(c) for c, e in made.items()])
    return rows.select("a_id", "b_id", "src", *S.native_features(), *[F.col(f"u.{c}").alias(c) for c in S.ALIGNED], *(rounded("dots", VIEWS) if known else []))


def build_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """a_id, b_id and FEATURES of every candidate pair. What a pair's two records give is written, with its rank among the anchor's pairs, so
    that one job holds less of the plan."""
    pairs = pairs.select("a_id", "b_id")
    known = vocabulary(records, pairs, VIEWS)
    if known is None:
        held = record_vectors(records, pairs, VIEWS)
        found = stage(cosines(pairs, held, VIEWS), "cosines")
        release(held)
        return add_rank_features(string_features(pairs, records).join(found, ["a_id", "b_id"])).select("a_id", "b_id", *FEATURES)
    found = stage(add_anchor_ranks(string_features(pairs, records, known)), "cosines")
    collect_garbage(pairs.sparkSession)
    return add_target_ranks(found).select("a_id", "b_id", *FEATURES)
