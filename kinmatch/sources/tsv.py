"""Tab-separated sources and sinks. Every column is text, nothing is quoted, and a missing field is the empty string."""

from __future__ import annotations

import gzip as zipped
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.split import Tables
from ..operators.truth import parse_truth

RECORD_SCHEMA = "entity_id string, business_name string, business_address string, country string"
TRUTH_SCHEMA = "source1_entity_id string, matched_entity_ids string"
_FORMAT = {"sep": "\t", "header": True, "quote": "", "escape": "", "emptyValue": "", "nullValue": ""}


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """All fields stripped of white space of any script; `NA` and `null` stay text; lines without any field are skipped."""
    raw = spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="").csv(path).na.fill("")
    return raw.select(*[strip(F.col(c)).alias(c) for c in raw.columns])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_split(spark: SparkSession, data_dir: str, split: str) -> Tables:
    """The three sources of a split and its truth, if there is one."""
    at = lambda name: f"{data_dir}/{split}/{split}_{name}.tsv"
    s1, s2, s3 = (read_tsv(spark, at(f"source{i}")) for i in (1, 2, 3))
    truth = parse_truth(read_tsv(spark, at("ground_truth"), TRUTH_SCHEMA)) if exists(spark, at("ground_truth")) else None
    return Tables(s1.withColumn("ordinal", F.monotonically_increasing_id()), s2, s3, truth)


def write_tsv(df: DataFrame, path: str, gzip: bool = False, single_file: bool = False) -> None:
    """A folder of files, each with a header; or one file, put together from them by copying, in the order of df's partitions.

    No task holds more than its own part. Gzip files stay valid when they follow one another.
    """
    options = {**_FORMAT, **({"compression": "gzip"} if gzip else {})}
    if not single_file:
        df.write.mode("overwrite").options(**options).csv(path)
        return
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target, parts = fs.Path(path), fs.Path(f"{path}.parts-{uuid.uuid4().hex}")
    at = target.getFileSystem(conf)
    try:
        df.write.options(**{**options, "header": False}).csv(parts.toString())
        found = sorted(x.getPath().getName() for x in at.listStatus(parts))
        at.delete(target, True)
        out = at.create(target)
        try:
            header = ("\t".join(df.columns) + "\n").encode()
            out.write(bytearray(zipped.compress(header, mtime=0) if gzip else header))
            for name in found:
                if name.startswith("part-"):
                    read = at.open(fs.Path(parts, name))
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, conf, False)
                    read.close()
        finally:
            out.close()
    finally:
        at.delete(parts, True)


def write_id_lists(lists: DataFrame, path: str, column: str, order: str = "ordinal", single_file: bool = True) -> None:
    """source1_entity_id and a comma list per anchor, in the anchors' order. Files of a large result are in order by name."""
    rows = lists.orderBy(order).select(F.col("s1_id").alias("source1_entity_id"), column)
    write_tsv(rows, path, single_file=single_file)


def write_scored_pairs(scored: DataFrame, path: str) -> None:
    write_tsv(scored.select("a_id", "b_id", "src", "label", "p"), path, gzip=True, single_file=True)
