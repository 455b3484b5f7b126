"""Mixing sources to target weights.

Tokens are summed per source, a repetition rate is derived for each source, and each document is emitted floor(rate) times
plus once more if a uniform number hashed from the seed and its id is below the rate's fraction. The draws of different ids are
independent, so a source's words come as near to its target as its number and sizes of documents let them.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share the corpus' size by weight, but no
target exceeds CAP times its source's size; what is cut off is shared again by weight. The end of that process is the level
L with sum(min(weight * L, CAP * size)) = total, found in one pass over the sources sorted by CAP * size / weight.

Defined cases: null and empty texts have size 0; texts of any length are counted whole. A null source is a source of its own, apart
from the empty one. A source without words has target 0 and its documents are taken 0 times. Sources with the same size by weight reach their
caps together. Repeated rows are taken as often as each other. An empty table gives an empty result. mix() carries all columns, whatever their
names. Two runs agree, as nothing but ids, texts, sources and seed decides. One task holds a row for each source (not for each document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, fresh, n_words, sized

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (source, size): source, source_size, target, rate. Windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("most", F.lit(cap) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", rest / share).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    per = per.withColumn("at", F.row_number().over(fill))
    # the first row of that order that stays under its cap sets the level for itself and all that follow, ties of the ratio among them
    level = F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(everything)["level"]
    target = F.least(F.coalesce(level * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    return per.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def hashed(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1): the first 32 bits of md5(seed:id)."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(head, 16, 10).cast("long") / F.lit(4294967296.0)


def copies(rate: Column, uniform: Column) -> Column:
    """floor(rate), and one more with the probability of its fraction."""
    whole = F.floor(rate)
    return (whole + F.when(uniform < rate - whole, 1).otherwise(0)).cast("long")


def slim(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source): doc_id, source, size, source_size, target, rate, copies for every row."""
    rows = slim(docs)
    targets = sized(cut(source_targets(rows), "targets").withColumnRenamed("source", "of"))  # broadcast only if they are few
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["of"])).drop("of")
    return rows.withColumn("copies", copies(F.col("rate"), hashed(F.col("doc_id"), seed)))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: all columns of docs, each row as often as it is taken."""
    of, rate, copy = fresh(docs, "of", "rate", "copy")
    targets = cut(source_targets(slim(docs)), "targets").select(F.col("source").alias(of), F.col("rate").alias(rate)).where(F.col(rate) > 0)
    targets = sized(targets)
    rows = docs.join(targets, docs["source"].eqNullSafe(targets[of]))
    times = F.sequence(F.lit(1), copies(F.col(rate), hashed(docs["doc_id"], seed)))
    rows = rows.where(copies(F.col(rate), hashed(docs["doc_id"], seed)) > 0).withColumn(copy, F.explode(times))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The level here: of all ratios that are filled with no more than there is, the largest; what is left goes to the sources above it.
OP6_SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), p AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, 3 * source_size AS most, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
        WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p
), filled AS (
    SELECT r, sum(CASE WHEN most <= r * weight THEN most ELSE r * weight END) AS need
    FROM w, (SELECT DISTINCT CAST(most AS DOUBLE) / weight AS r FROM w) GROUP BY r
), k AS (
    SELECT coalesce(max(r) FILTER (need <= (SELECT sum(source_size) FROM w)), -1) AS r FROM filled
), l AS (
    SELECT CAST((SELECT sum(source_size) FROM w) - coalesce(sum(most) FILTER (CAST(most AS DOUBLE) / weight <= r), 0) AS DOUBLE)
        / CAST(sum(weight) FILTER (CAST(most AS DOUBLE) / weight > r) AS DOUBLE) AS level FROM w, k
), t AS (
    SELECT source, source_size, least(coalesce((SELECT level FROM l) * weight, CAST(most AS DOUBLE)), CAST(most AS DOUBLE)) AS target FROM w
), r AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
    SELECT *, CAST(floor(rate) AS BIGINT) + CAST(u < rate - floor(rate) AS INT) AS copies FROM r
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
