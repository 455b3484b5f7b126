"""Nearest-neighbour candidates for anchors that keys don't serve, from embeddings of names.

Exact top-k by cosine within country and target source. Anchors and pool are cut into blocks, a pair of blocks is one task, which takes
its anchors SLICE at a time and returns at most top_k rows for each; their top_k are the answer. Only the weak anchors are
compared, against the whole pool: they are the few, so their blocks are the large ones and the pool moves once for each of those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHOR_BLOCK = 32_768
POOL_BLOCK = 8192
SLICE = 1024
DIGITS = 6


def embed(records: DataFrame, embed_fn: Callable[[list[str]], np.ndarray], column: str = "business_name") -> DataFrame:
    """entity_id, vec of distinct texts, by a function from texts to unit vectors."""
    texts = records.select(F.col(column).alias("text")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vec=[v.astype(float).tolist() for v in embed_fn(batch["text"].tolist())])

    vectors = texts.mapInPandas(run, "text string, vec array<double>")
    return records.join(vectors, records[column] == vectors["text"]).select("entity_id", "vec")


def _blocks(group: DataFrame, size: int, name: str) -> DataFrame:
    return group.groupBy("country_key", "target").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def nearest(anchors: DataFrame, pool: DataFrame, top_k: int = 10, sim_min: float = 0.5) -> DataFrame:
    """anchors (a_id, country_key, vec), pool (b_id, country_key, target, vec): a_id, b_id, target, sim."""
    targets = pool.select("country_key", "target").distinct()
    anchors = anchors.join(targets, "country_key")
    na, nb = _blocks(anchors, ANCHOR_BLOCK, "na"), _blocks(pool, POOL_BLOCK, "nb")
    count = na.join(nb, ["country_key", "target"])

    def spread(own: DataFrame, key: str, block: str, blocks: str, other: str, others: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        held = own.join(count, ["country_key", "target"]).withColumn(block, F.pmod(F.xxhash64(key), F.col(blocks)).cast("int"))
        held = held.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("na", "nb")
        return held.select(*[F.col(c).alias(c) for c in held.columns])  # both sides may come from one table

    left, right = spread(anchors, "a_id", "ia", "na", "ib", "nb"), spread(pool, "b_id", "ib", "nb", "ia", "na")
    keys = ["country_key", "target", "ia", "ib"]

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a_id": [], "b_id": [], "target": [], "sim": []})
        if not len(a) or not len(b):
            return none
        b = b.sort_values("b_id", kind="stable")  # ties by id
        ids, other, out = b["b_id"].to_numpy(), np.stack(b["vec"].tolist()).astype(float).T, []
        for i in range(0, len(a), SLICE):
            part = a.iloc[i : i + SLICE]
            sims = np.round(np.stack(part["vec"].tolist()).astype(float) @ other, DIGITS)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :top_k]
            rows, cols = np.repeat(np.arange(len(part)), best.shape[1]), best.ravel()
            found = pd.DataFrame({"a_id": part["a_id"].to_numpy()[rows], "b_id": ids[cols], "target": b["target"].iloc[0], "sim": sims[rows, cols]})
            out.append(found[found["sim"] >= sim_min])
        return pd.concat(out, ignore_index=True)

    a_kind, b_kind = anchors.schema["a_id"].dataType.simpleString(), pool.schema["b_id"].dataType.simpleString()
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, f"a_id {a_kind}, b_id {b_kind}, target string, sim double")
    best = Window.partitionBy("a_id", "target").orderBy(F.col("sim").desc(), "b_id")
    return found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top_k).drop("rn")


def with_rescue(pairs: DataFrame, rescued: DataFrame) -> DataFrame:
    return pairs.select("a_id", "b_id").union(rescued.select("a_id", "b_id")).distinct()


def dot(x: Column, y: Column) -> Column:
    """The dot product of two vectors, element by element in order."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with name_embed_sim, the dot product of their vectors (entity_id, vec)."""
    a = vectors.select(F.col("entity_id").alias("a_id"), F.col("vec").alias("_va"))
    b = vectors.select(F.col("entity_id").alias("b_id"), F.col("vec").alias("_vb"))
    joined = pairs.join(a, "a_id").join(b, "b_id")
    return joined.withColumn("name_embed_sim", F.round(dot(F.col("_va"), F.col("_vb")), DIGITS)).drop("_va", "_vb")
