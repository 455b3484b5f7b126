"""Seeded example data: entities of several countries with noisy copies in two target sources, in generated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.split import Tables

FIRST = {"US": ["Summit", "Liberty", "Harbor", "Pioneer", "Cascade", "Granite"], "India": ["Shree", "Lakshmi", "Bharat", "Sundar", "Ganga", "Vijay"], "France": ["Lumière", "Château", "Provence", "Étoile", "Rivière", "Forêt"]}
SECOND = {"US": ["Robotics", "Foods", "Logistics", "Dental", "Media"], "India": ["Textiles", "Motors", "Spices", "Steel", "Pharma"], "France": ["Boulangerie", "Transport", "Conseil", "Vins", "Optique"]}
FORM = {"US": ["Incorporated", "LLC", "Corporation"], "India": ["Private Limited", "Limited"], "France": ["SARL", "SAS"]}
CITY = {"US": ["Dayton", "Tucson", "Salem"], "India": ["Nagpur", "Kochi", "Indore"], "France": ["Tours", "Dijon", "Brest"]}
STREET = ["Maple", "Station", "Temple", "Canal", "Market", "Hill", "Garden"]


def _roll(tag: str, n: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(tag), *keys), F.lit(n)).cast("int")


def _pick(options: dict[str, list[str]] | list[str], tag: str, *keys: Column) -> Column:
    if isinstance(options, list):
        return F.element_at(F.array(*map(F.lit, options)), _roll(tag, len(options), *keys) + 1)
    chosen = None
    for country, values in options.items():
        here = _pick(values, tag, *keys)
        chosen = F.when(F.col("country") == country, here) if chosen is None else chosen.when(F.col("country") == country, here)
    return chosen


def entities(spark: SparkSession, countries: list[str], per_country: int, seed: int) -> DataFrame:
    rows = spark.range(per_country * len(countries)).withColumn("country", F.element_at(F.array(*map(F.lit, countries)), (F.col("id") % len(countries) + 1).cast("int")))
    k = [F.col("id"), F.lit(seed)]
    name = F.concat_ws(" ", _pick(FIRST, "f", *k), _pick(FIRST, "g", *k), _pick(SECOND, "s", *k), _pick(FORM, "o", *k))
    number = (_roll("no", 998, *k) + 1).cast("string")
    post = F.when(F.col("country") == "India", _roll("pin", 99_999, *k) + 500_000).otherwise(_roll("zip", 89_999, *k) + 10_000).cast("string")
    address = F.concat(number, F.lit(" "), _pick(STREET, "st", *k), F.lit(" Road, "), _pick(CITY, "c", *k), F.lit(", "), post)
    return rows.select("id", "country", name.alias("business_name"), address.alias("business_address"))


def noisy(rows: DataFrame, tag: str, seed: int) -> DataFrame:
    """Abbreviations, swapped letters, dropped forms, capitals, cut, marked and blank addresses."""
    k = [F.col("id"), F.col("copy"), F.lit(tag), F.lit(seed)]
    chance = lambda what, percent: _roll(what, 100, *k) < percent
    name, address = F.col("business_name"), F.col("business_address")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "Private", "Pvt"), "Limited", "Ltd"), "Corporation", "Corp")
    name = F.when(chance("abbr", 50), short).otherwise(name)
    at = _roll("at", 4, *k) + 2
    swapped = F.concat(F.substr(name, F.lit(1), at - 1), F.substr(name, at + 1, F.lit(1)), F.substr(name, at, F.lit(1)), F.substr(name, at + 2))
    name = F.when(chance("typo", 20), swapped).otherwise(name)
    name = F.when(chance("form", 25), F.regexp_replace(name, r" (LLC|SARL|SAS|Incorporated)$", "")).otherwise(name)
    name = F.when(chance("caps", 20), F.upper(name)).otherwise(name)
    address = F.when(chance("road", 60), F.regexp_replace(address, "Road", "Rd")).otherwise(address)
    address = F.when(chance("cut", 25), F.regexp_replace(address, r", [^,]*$", "")).otherwise(address)
    address = F.when((F.col("country") == "India") & chance("mark", 25), F.concat(address, F.lit(", Near Clock Tower"))).otherwise(address)
    address = F.when(chance("blank", 5), F.lit("")).otherwise(address)
    return rows.withColumns({"business_name": name, "business_address": address})


def make_split(spark: SparkSession, countries: list[str], per_country: int = 600, seed: int = 7) -> Tables:
    """Anchors, targets and truth: 15 % of anchors without copies, others with 0 to 2 in each target; a quarter as many orphans."""
    base = entities(spark, countries, per_country, seed)
    columns = ["entity_id", "business_name", "business_address", "country"]
    s1 = base.withColumn("entity_id", F.format_string("S1-%07d", "id"))
    targets, owned = [], []
    for tag in ("S2", "S3"):
        n = F.element_at(F.array(*map(F.lit, (0, 1, 1, 2))), _roll(f"n{tag}", 4, F.col("id"), F.lit(seed)) + 1)
        n = F.when(_roll("single", 100, F.col("id"), F.lit(seed)) < 15, 0).otherwise(n)
        copies = base.withColumn("n", n).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
        copies = copies.withColumn("entity_id", F.format_string(f"{tag}-%07d-%d", "id", "copy"))
        orphans = entities(spark, countries, max(1, per_country // 4), seed + (101 if tag == "S2" else 202))
        orphans = orphans.withColumns({"copy": F.lit(0), "entity_id": F.format_string(f"{tag}-X%06d", "id")})
        targets.append(noisy(copies.unionByName(orphans), tag, seed).select(*columns))
        owned.append(copies.select("id", "entity_id"))
    lists = owned[0].union(owned[1]).groupBy("id").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
    truth = s1.join(lists, "id", "left").select(F.col("entity_id").alias("s1_id"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    return Tables(s1.select(*columns, F.col("id").alias("ordinal")), targets[0], targets[1], truth)


def write_split(tables: Tables, data_dir: str, split: str) -> None:
    from .tsv import write_tsv

    for i, df in enumerate((tables.s1.drop("ordinal"), tables.s2, tables.s3), 1):
        write_tsv(df, f"{data_dir}/{split}/{split}_source{i}.tsv")
    if tables.truth is not None:
        truth = tables.truth.select(F.col("s1_id").alias("source1_entity_id"), F.array_join("ids", ",").alias("matched_entity_ids"))
        write_tsv(truth, f"{data_dir}/{split}/{split}_ground_truth.tsv")
