"""The engine's operators as queries over whole tables, with SQL that gives the same rows.

Records for linkage come from three tables: customers (S1), suppliers (S2) and parts (S3). Names and addresses are made of whole
columns; the country is the region. Text functions run over whole texts of documents. A stand-in probability is derived from
votes, so that decoding can be compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import similarity as S
from .functions import text as T
from .operators import blocking, decode, features, metric, model, ranking, records, report, rescue, split, tfidf, truth
from .staging import release, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources -------------------------------------------------------------------------------------------------------


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    c, s, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey")
    s1 = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        text("S1-", c).alias("entity_id"), text(F.col("c_name"), " ", F.col("c_mktsegment")).alias("business_name"),
        text("No ", c, ", ", F.col("n_name"), " Road, ", F.col("r_name"), " ", c + 10000).alias("business_address"), text(" ", F.col("r_name")).alias("country"),
    )
    s2 = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        text("S2-", s).alias("entity_id"), text(F.col("s_name"), " & Co Ltd").alias("business_name"),
        text("No ", s, ", near Depot ", s, ", ", F.col("n_name"), " Rd, ", F.col("r_name"), " ", s + 10000).alias("business_address"), F.col("r_name").alias("country"),
    )
    s3 = t("part").join(t("region"), F.col("p_size") % 5 == F.col("r_regionkey")).select(
        text("S3-", p).alias("entity_id"), text(F.col("p_name"), " ", F.col("p_brand"), " ", F.col("p_type"), " Inc").alias("business_name"),
        F.when(F.col("p_size") == 7, "").otherwise(text("Plot ", p, ", ", p + 10000, " Depot")).alias("business_address"), F.lower("r_name").alias("country"),
    )
    return records.stack(s1, s2, s3)


RAW = """raw AS (
    SELECT 'S1-' || c_custkey AS entity_id, c_name || ' ' || c_mktsegment AS business_name,
        'No ' || c_custkey || ', ' || n_name || ' Road, ' || r_name || ' ' || (c_custkey + 10000) AS business_address, ' ' || r_name AS country, 'S1' AS source
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 'S2-' || s_suppkey, s_name || ' & Co Ltd',
        'No ' || s_suppkey || ', near Depot ' || s_suppkey || ', ' || n_name || ' Rd, ' || r_name || ' ' || (s_suppkey + 10000), r_name, 'S2'
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 'S3-' || p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' Inc',
        CASE WHEN p_size = 7 THEN '' ELSE 'Plot ' || p_partkey || ', ' || (p_partkey + 10000) || ' Depot' END, lower(r_name), 'S3'
    FROM part JOIN region ON p_size % 5 = r_regionkey
)"""


def er_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.normalise(raw_records(spark, sf_dir))


def raw_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with blanks, repeats and ids without a record."""
    c = F.col("c_custkey")
    two = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("S2-"), F.floor(c / 15), F.lit(", "), F.lit("S2-"), F.floor(c / 15))).otherwise("")
    three = F.when(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD"), F.concat(F.lit("S3-"), c, F.lit(" ,,S3-X"), c)).otherwise("")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), c).alias("source1_entity_id"), F.concat(two, F.lit(","), three).alias("matched_entity_ids"))


def er_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.parse_truth(raw_truth(spark, sf_dir))


TRUTH = """tl AS (
    SELECT 'S1-' || c_custkey AS s1_id, list_sort(list_distinct(list_filter(list_transform(string_split(
        CASE WHEN c_mktsegment <> 'BUILDING' THEN 'S2-' || (c_custkey // 15) || ', S2-' || (c_custkey // 15) ELSE '' END || ',' ||
        CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'S3-' || c_custkey || ' ,,S3-X' || c_custkey ELSE '' END, ','),
        lambda x: trim(x)), lambda x: x <> ''))) AS ids FROM customer
), tp AS (SELECT s1_id, unnest(ids) AS t_id FROM tl
), tc AS (SELECT s1_id, CAST(len(ids) AS BIGINT) AS truth_cnt FROM tl)"""

# --- the same normalisation in SQL ------------------------------------------------------------------------------------


def _basic(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace({x}, '&', ' and '), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _expand(x: str, words: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())
    return f"array_to_string(list_transform({_tokens(x)}, lambda t: CASE t {cases} ELSE t END), ' ')"


def _without(x: str, words: list[str]) -> str:
    return f"list_filter({_tokens(x)}, lambda t: t NOT IN ({', '.join(map(repr, words))}))"


def _runs(x: str, which: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_extract_all({x}, '(\p{{Nd}}+)', 1), lambda r: length(r) {which} (5, 6))))"


_LANDMARK = T.LANDMARK.replace("'", "''")


def _normalised(source: str, name: str, address: str, keep: str) -> str:
    """CTEs f, g, h, rec over `source`."""
    core = f"array_to_string({_without('name_norm', T.NAME_GLUE)}, ' ')"
    return f"""f AS (SELECT *, lower(strip_accents({name})) AS fn, lower(strip_accents({address})) AS fa FROM {source}
), g AS (SELECT *, {_expand(_basic('fn'), T.NAME_WORDS)} AS name_norm, {_expand(_basic('fa'), T.ADDRESS_WORDS)} AS addr_full,
    {_expand(_basic(f"regexp_replace(fa, '{_LANDMARK}', ' ', 'g')"), T.ADDRESS_WORDS)} AS addr_cut, {_runs(address, 'IN')} AS postal, {_runs(address, 'NOT IN')} AS nums FROM f
), h AS (SELECT *, CASE WHEN {core} = '' THEN name_norm ELSE {core} END AS name_core, CASE WHEN addr_cut = '' THEN addr_full ELSE addr_cut END AS addr_core FROM g
), rec AS (SELECT {keep}, name_norm, name_core, addr_full, addr_core, postal, nums,
    array_to_string(list_transform({_tokens('name_core')}, lambda t: t[1:1]), '') AS name_acr, name_core || ' | ' || addr_core AS name_addr FROM h)"""


REC = RAW + ", " + _normalised("raw", "business_name", "business_address", "entity_id, source, country, business_name, business_address, lower(trim(country)) AS country_key")
DOC = _normalised("documents", "coalesce(text, '')", "coalesce(text, '')", "doc_id")

# --- projections and text functions -----------------------------------------------------------------------------------


@query(f"WITH {RAW} SELECT entity_id, business_name, business_address, country, source, lower(trim(country)) AS country_key FROM raw")
def records_union(spark, sf_dir):
    rows = raw_records(spark, sf_dir)
    return rows.withColumn("country_key", records.country_key(F.col("country")))


@query(
    f"WITH {REC} SELECT entity_id, source, country_key, name_norm, name_core, name_acr, addr_core, name_addr,"
    " array_to_string(postal, ',') AS postal, array_to_string(nums, ',') AS nums FROM rec"
)
def normalised_records(spark, sf_dir):
    return er_records(spark, sf_dir).select(
        "entity_id", "source", "country_key", "name_norm", "name_core", "name_acr", "addr_core", "name_addr",
        F.array_join("postal", ",").alias("postal"), F.array_join("nums", ",").alias("nums"),
    )


def _folded(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), T.lower_folded(text).alias("folded"))


@query(f"WITH {DOC} SELECT doc_id, name_norm FROM rec")
def name_norm(spark, sf_dir):
    return _folded(spark, sf_dir).select("doc_id", T.name_norm(F.col("folded")).alias("name_norm"))


@query(f"WITH {DOC} SELECT doc_id, name_core FROM rec")
def name_core(spark, sf_dir):
    rows = _folded(spark, sf_dir).select("doc_id", T.name_norm(F.col("folded")).alias("n"))
    return rows.select("doc_id", T.name_core(F.col("n")).alias("name_core"))


@query(f"WITH {DOC} SELECT doc_id, name_acr FROM rec")
def acronym(spark, sf_dir):
    rows = _folded(spark, sf_dir).select("doc_id", T.name_norm(F.col("folded")).alias("n"))
    return rows.select("doc_id", T.acronym(T.name_core(F.col("n"))).alias("name_acr"))


@query(f"WITH {DOC} SELECT doc_id, addr_full FROM rec")
def addr_full(spark, sf_dir):
    return _folded(spark, sf_dir).select("doc_id", T.address_full(F.col("folded")).alias("addr_full"))


@query(f"WITH {DOC} SELECT doc_id, addr_core FROM rec")
def addr_core(spark, sf_dir):
    return _folded(spark, sf_dir).select("doc_id", T.address_core(F.col("folded")).alias("addr_core"))


@query(f"SELECT doc_id, array_to_string({_runs('text', 'IN')}, ',') AS postal FROM documents")
def postal_codes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.postal_codes(F.col("text")), ",").alias("postal"))


@query(f"SELECT doc_id, array_to_string({_runs('text', 'NOT IN')}, ',') AS nums FROM documents")
def numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), ",").alias("nums"))


# --- blocking ------------------------------------------------------------------------------------------------------


def _keys_sql(country: str = "country_key") -> str:
    empty = "CAST([] AS VARCHAR[])"
    name, address = "replace(name_core, ' ', '')", "replace(addr_core, ' ', '')"
    stop = lambda words: ", ".join(map(repr, words))
    lists = {
        "tok": f"list_filter({_tokens('name_core')}, lambda t: length(t) >= 3 AND t NOT IN ({stop(blocking.COMMON_NAME_WORDS)}))",
        "pre4": f"CASE WHEN length({name}) >= 4 THEN [{name}[1:4]] ELSE {empty} END",
        "ng4": f"CASE WHEN length({name}) >= 4 THEN list_transform(range(1, length({name}) - 2), lambda i: substr({name}, i, 4)) ELSE {empty} END",
        "pin": "postal",
        "apre6": f"CASE WHEN length({address}) >= 6 THEN [{address}[1:6]] ELSE {empty} END",
        "atok": rf"list_filter({_tokens('addr_core')}, lambda t: length(t) >= 4 AND t NOT IN ({stop(blocking.COMMON_ADDRESS_WORDS)}) AND NOT regexp_full_match(t, '\p{{Nd}}+'))",
        "num": "nums",
    }
    parts = [
        f"SELECT entity_id, source, {country} AS country_key, '{k}' AS ktype, unnest(CASE WHEN source = 'S1' THEN {x} ELSE list_distinct({x}) END) AS key, {blocking.WEIGHTS[k]} AS weight FROM rec"
        for k, x in lists.items()
    ]
    return "keys AS (\n    " + "\n    UNION ALL ".join(parts) + "\n)"


def _votes_sql(max_bucket: int = 1000, country: str = "country_key") -> str:
    return f"""{REC}, {_keys_sql(country)}, sizes AS (
    SELECT country_key, source, ktype, key, count(*) AS n FROM keys WHERE source <> 'S1' GROUP BY ALL
), votes AS (
    SELECT a.entity_id AS a_id, b.entity_id AS b_id, b.source AS target, CAST(sum(a.weight) AS BIGINT) AS score
    FROM keys a JOIN keys b USING (country_key, ktype, key) JOIN sizes s ON s.country_key = b.country_key AND s.source = b.source AND s.ktype = b.ktype AND s.key = b.key
    WHERE a.source = 'S1' AND b.source <> 'S1' AND s.n <= {max_bucket} GROUP BY ALL
)"""


def _cand_sql(max_cand: int = 50, **kw) -> str:
    return f"""{_votes_sql(**kw)}, cand AS (
    SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY a_id, target ORDER BY score DESC, b_id) <= {max_cand}
)"""


KEYS, VOTES, CAND = f"{REC}, {_keys_sql()}", _votes_sql(), _cand_sql()


def _keys(spark, sf_dir, same_country=True):
    return blocking.blocking_keys(er_records(spark, sf_dir), same_country)


def _records(spark, sf_dir):
    """For queries that read records more than once: normalised once."""
    return stage(er_records(spark, sf_dir), "records")


def _votes(spark, sf_dir, recs=None, max_bucket=1000):
    """The keys are read by anchors, targets and bucket sizes, so they are made once."""
    keys = blocking.blocking_keys(er_records(spark, sf_dir) if recs is None else recs)
    return blocking.votes(stage(keys, "keys"), max_bucket)


def _candidates(spark, sf_dir, recs=None):
    return blocking.top_candidates(_votes(spark, sf_dir, recs))


def _written_pairs(recs):
    """a_id and b_id of the candidates. The keys, and what the votes shuffled, go before the pairs are shuffled."""
    keys = stage(blocking.blocking_keys(recs), "keys")
    pairs = stage(blocking.top_candidates(blocking.votes(keys)).select("a_id", "b_id"), "pairs")
    release(keys)
    return pairs


@query(f"WITH {KEYS} SELECT * FROM keys")
def blocking_keys(spark, sf_dir):
    return _keys(spark, sf_dir)


@query(f"WITH {KEYS} SELECT country_key, source, ktype, key, count(*) AS n FROM keys WHERE source <> 'S1' GROUP BY ALL")
def bucket_sizes(spark, sf_dir):
    return blocking.bucket_sizes(_keys(spark, sf_dir))


@query(f"WITH {KEYS}, s AS (SELECT count(*) AS n FROM keys WHERE source <> 'S1' GROUP BY country_key, source, ktype, key) SELECT count(*) AS dropped FROM s WHERE n > 100")
def bucket_dropped(spark, sf_dir):
    return blocking.bucket_sizes(_keys(spark, sf_dir)).where("n > 100").agg(F.count(F.lit(1)).alias("dropped"))


@query(f"WITH {VOTES} SELECT * FROM votes")
def votes(spark, sf_dir):
    return _votes(spark, sf_dir)


@query(f"WITH {_votes_sql(20)} SELECT * FROM votes")
def votes_small_buckets(spark, sf_dir):
    return _votes(spark, sf_dir, max_bucket=20)


@query(f"WITH {CAND} SELECT * FROM cand")
def candidates_topk(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(f"WITH {_cand_sql(10, max_bucket=100, country=repr(''))} SELECT * FROM cand")
def candidates_cross_country(spark, sf_dir):
    keys = stage(_keys(spark, sf_dir, same_country=False), "keys")
    return blocking.top_candidates(blocking.votes(keys, 100), 10)


@query(f"WITH {VOTES} SELECT a_id, max(score) AS best FROM votes GROUP BY a_id")
def best_vote(spark, sf_dir):
    return blocking.best_votes(_votes(spark, sf_dir))


@query(f"WITH {VOTES} SELECT entity_id AS a_id, coalesce(max(score), 0) AS best FROM rec LEFT JOIN votes ON a_id = entity_id WHERE source = 'S1' GROUP BY entity_id HAVING coalesce(max(score), 0) < 130")
def weak_entities(spark, sf_dir):
    recs = _records(spark, sf_dir)
    return blocking.weak_entities(recs, _votes(spark, sf_dir, recs), 130)


@query(f"WITH {CAND} SELECT entity_id AS a_id, count(b_id) AS n FROM rec LEFT JOIN cand ON a_id = entity_id WHERE source = 'S1' GROUP BY entity_id HAVING count(b_id) < 15")
def sparse_entities(spark, sf_dir):
    recs = _records(spark, sf_dir)
    return blocking.sparse_entities(recs, _candidates(spark, sf_dir, recs), 15)


# --- truth and reports -----------------------------------------------------------------------------------------------

RESOLVED = f"""{TRUTH}, res AS (
    SELECT DISTINCT s1_id AS a_id, t_id AS b_id FROM tp WHERE s1_id IN (SELECT entity_id FROM rec) AND t_id IN (SELECT entity_id FROM rec)
)"""


def _resolved(spark, sf_dir):
    return truth.resolved_pairs(er_truth(spark, sf_dir), er_records(spark, sf_dir))


@query(f"WITH {TRUTH} SELECT s1_id, array_to_string(ids, ',') AS ids FROM tl")
def truth_lists(spark, sf_dir):
    return er_truth(spark, sf_dir).select("s1_id", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {REC}, {RESOLVED} SELECT * FROM res")
def truth_pairs(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(f"WITH {CAND}, {RESOLVED} SELECT cand.a_id, cand.b_id, CAST(res.a_id IS NOT NULL AS INT) AS label FROM cand LEFT JOIN res USING (a_id, b_id)")
def labelled_pairs(spark, sf_dir):
    return truth.label(_candidates(spark, sf_dir).select("a_id", "b_id"), _resolved(spark, sf_dir))


@query(f"WITH {CAND}, {RESOLVED} SELECT round(avg(CAST(res.a_id IS NOT NULL AS INT)), 9) AS positive_rate FROM cand LEFT JOIN res USING (a_id, b_id)")
def positive_rate(spark, sf_dir):
    return labelled_pairs(spark, sf_dir).agg(F.round(F.avg("label"), 9).alias("positive_rate"))


@query(f"""WITH {CAND}, {RESOLVED}, r AS (
    SELECT a.country_key, b.source AS target, CAST(cand.a_id IS NOT NULL AS BIGINT) AS hit FROM res LEFT JOIN cand USING (a_id, b_id)
    JOIN rec a ON a.entity_id = res.a_id JOIN rec b ON b.entity_id = res.b_id
), s AS (
    SELECT 'all' AS scope, '' AS value, hit FROM r UNION ALL SELECT 'target', target, hit FROM r UNION ALL SELECT 'country', country_key, hit FROM r
) SELECT scope, value, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS pairs, round(CAST(sum(hit) AS DOUBLE) / count(*), 6) AS recall FROM s GROUP BY ALL""")
def blocking_recall(spark, sf_dir):
    return truth.blocking_recall(_resolved(spark, sf_dir), _candidates(spark, sf_dir), er_records(spark, sf_dir))


@query(f"WITH {RAW} SELECT source, country, count(*) AS n FROM raw GROUP BY ALL")
def country_counts(spark, sf_dir):
    return report.country_counts(raw_records(spark, sf_dir))


@query(f"WITH {RAW} SELECT source, round(avg(CAST(business_name = '' AS DOUBLE)), 6) AS empty_name, round(avg(CAST(business_address = '' AS DOUBLE)), 6) AS empty_address FROM raw GROUP BY source")
def empty_rates(spark, sf_dir):
    return report.empty_rates(raw_records(spark, sf_dir))


@query(f"WITH {TRUTH} SELECT round(avg(CAST(truth_cnt = 0 AS DOUBLE)), 6) AS singleton_rate FROM tc")
def singleton_rate(spark, sf_dir):
    return report.singleton_rate(er_truth(spark, sf_dir))


@query(f"WITH {TRUTH} SELECT truth_cnt AS matches, count(*) AS entities FROM tc GROUP BY 1 ORDER BY 1 LIMIT 10")
def match_histogram(spark, sf_dir):
    return report.match_histogram(er_truth(spark, sf_dir))


@query(f"WITH {TRUTH} SELECT count(t_id) - count(DISTINCT t_id) AS extra_claims FROM tp")
def multi_claimed(spark, sf_dir):
    return report.multi_claimed(er_truth(spark, sf_dir))


@query(f"""WITH {RAW}, {TRUTH} SELECT r.source, round(coalesce(c.n, 0) / CAST(r.n AS DOUBLE), 6) AS share
FROM (SELECT source, count(*) AS n FROM raw WHERE source <> 'S1' GROUP BY source) r LEFT JOIN (SELECT t_id[1:2] AS source, count(*) AS n FROM tp GROUP BY 1) c USING (source)""")
def matched_share(spark, sf_dir):
    return report.matched_share(er_truth(spark, sf_dir), raw_records(spark, sf_dir))


@query(f"""WITH {RAW}, {TRUTH} SELECT count(*) FILTER (a.country <> b.country) AS cross_country, count(*) AS pairs
FROM tp JOIN raw a ON a.entity_id = s1_id JOIN raw b ON b.entity_id = t_id""")
def cross_country(spark, sf_dir):
    return report.cross_country(er_truth(spark, sf_dir), raw_records(spark, sf_dir))


@query(f"""WITH {TRUTH} SELECT count(*) AS "both" FROM (SELECT s1_id FROM tp GROUP BY s1_id
HAVING bool_or(starts_with(t_id, 'S2-')) AND bool_or(starts_with(t_id, 'S3-')))""")
def match_both(spark, sf_dir):
    return report.match_both(er_truth(spark, sf_dir))


@query(f"""WITH {RAW}, {TRUTH}, one AS (SELECT s1_id FROM tc WHERE truth_cnt >= 2 ORDER BY s1_id LIMIT 1)
SELECT * FROM raw WHERE entity_id IN (SELECT s1_id FROM one) OR entity_id IN (SELECT t_id FROM tp WHERE s1_id IN (SELECT s1_id FROM one))""")
def matched_group(spark, sf_dir):
    return report.matched_group(er_truth(spark, sf_dir), raw_records(spark, sf_dir))


@query()
def source_samples(spark, sf_dir):
    rows = raw_records(spark, sf_dir)
    return report.sample(rows, "S1").union(report.sample(rows, "S2")).union(report.sample(rows, "S3"))


# --- pair features ---------------------------------------------------------------------------------------------------

PAIRS = f"{CAND}, ab AS (SELECT a_id, b_id, a, b FROM cand JOIN rec a ON a.entity_id = a_id JOIN rec b ON b.entity_id = b_id)"


def _pair_rows(spark, sf_dir):
    recs = _records(spark, sf_dir)
    return features.with_records(_candidates(spark, sf_dir, recs).select("a_id", "b_id"), recs)


def _round(c):
    return F.round(c, 6)


def _native(spark, sf_dir, *names):
    made = S.native_features()
    return _pair_rows(spark, sf_dir).select("a_id", "b_id", *[_round(made[n]).alias(n) for n in names])


def _jacc(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN round(len(list_intersect({x}, {y})) / CAST(len(list_distinct(list_concat({x}, {y}))) AS DOUBLE), 6) END"


_BOTH_NAMES, _BOTH_ADDRESSES = "a.name_core <> '' AND b.name_core <> ''", "a.addr_core <> '' AND b.addr_core <> ''"


def _token_jacc(column: str) -> str:
    return _jacc(*[f"list_distinct({_tokens(f'{s}.{column}')})" for s in "ab"])


def _length_ratio(column: str) -> str:
    return f"round(least(length(a.{column}), length(b.{column})) / CAST(greatest(length(a.{column}), length(b.{column})) AS DOUBLE), 6)"


@query(f"WITH {PAIRS} SELECT a_id, b_id, {_token_jacc('name_core')} AS n_tok_jacc, {_token_jacc('addr_core')} AS a_tok_jacc FROM ab")
def token_jaccard(spark, sf_dir):
    return _native(spark, sf_dir, "n_tok_jacc", "a_tok_jacc")


@query(f"WITH {PAIRS} SELECT a_id, b_id, CASE WHEN {_BOTH_NAMES} THEN round(1 - levenshtein(a.name_core, b.name_core) / CAST(greatest(length(a.name_core), length(b.name_core)) AS DOUBLE), 6) END AS n_lev FROM ab")
def levenshtein_sim(spark, sf_dir):
    return _native(spark, sf_dir, "n_lev")


@query(f"WITH {PAIRS} SELECT a_id, b_id, CASE WHEN {_BOTH_NAMES} THEN {_length_ratio('name_core')} END AS n_len_ratio, CASE WHEN {_BOTH_ADDRESSES} THEN {_length_ratio('addr_core')} END AS a_len_ratio, CAST(length(a.name_core) AS DOUBLE) AS n_len_a, CAST(length(b.name_core) AS DOUBLE) AS n_len_b FROM ab")
def length_ratio(spark, sf_dir):
    return _native(spark, sf_dir, "n_len_ratio", "a_len_ratio", "n_len_a", "n_len_b")


@query(f"WITH {PAIRS} SELECT a_id, b_id, CASE WHEN {_BOTH_NAMES} THEN CAST(replace(a.name_core, ' ', '') = replace(b.name_core, ' ', '') AS DOUBLE) END AS n_compact_eq, CASE WHEN {_BOTH_NAMES} THEN CAST(string_split(a.name_core, ' ')[1] = string_split(b.name_core, ' ')[1] AS DOUBLE) END AS n_first_tok FROM ab")
def compact_eq(spark, sf_dir):
    return _native(spark, sf_dir, "n_compact_eq", "n_first_tok")


@query(f"""WITH {PAIRS} SELECT a_id, b_id, CASE WHEN {_BOTH_NAMES} THEN CAST((length(replace(a.name_core, ' ', '')) >= 2 AND b.name_acr = replace(a.name_core, ' ', ''))
OR (length(replace(b.name_core, ' ', '')) >= 2 AND a.name_acr = replace(b.name_core, ' ', '')) AS DOUBLE) END AS n_acr FROM ab""")
def acronym_match(spark, sf_dir):
    return _native(spark, sf_dir, "n_acr")


@query(f"WITH {PAIRS} SELECT a_id, b_id, CAST(len(a.postal) > 0 AND len(b.postal) > 0 AS DOUBLE) AS pc_both, CASE WHEN len(a.postal) > 0 AND len(b.postal) > 0 THEN CAST(list_has_any(a.postal, b.postal) AS DOUBLE) END AS pc_eq FROM ab")
def pc_eq(spark, sf_dir):
    return _native(spark, sf_dir, "pc_both", "pc_eq")


@query(f"WITH {PAIRS} SELECT a_id, b_id, {_jacc('a.nums', 'b.nums')} AS num_jacc, CAST(len(list_intersect(a.nums, b.nums)) AS DOUBLE) AS num_common FROM ab")
def num_overlap(spark, sf_dir):
    return _native(spark, sf_dir, "num_jacc", "num_common")


@query(f"WITH {PAIRS} SELECT a_id, b_id, CAST(NOT ({_BOTH_ADDRESSES}) AS DOUBLE) AS a_missing FROM ab")
def addr_missing(spark, sf_dir):
    return _native(spark, sf_dir, "a_missing")


def _aligned(spark, sf_dir, *names):
    sides = [F.col(f"{s}.{c}") for c in ("name_core", "name_norm", "addr_core") for s in ("a", "b")]
    rows = _pair_rows(spark, sf_dir).select("a_id", "b_id", S.aligned(*sides).alias("u"))
    return rows.select("a_id", "b_id", *[_round(F.col(f"u.{n}")).alias(n) for n in names])


@query(f"WITH {PAIRS} SELECT a_id, b_id, CASE WHEN {_BOTH_NAMES} THEN round(jaro_winkler_similarity(a.name_core, b.name_core), 6) END AS n_jw FROM ab")
def jaro_winkler(spark, sf_dir):
    return _aligned(spark, sf_dir, "n_jw")


@query()
def fuzz_ratio(spark, sf_dir):
    return _aligned(spark, sf_dir, "n_ratio", "a_ratio")


@query()
def token_sort(spark, sf_dir):
    return _aligned(spark, sf_dir, "n_tsort", "a_tsort")


@query()
def token_set(spark, sf_dir):
    return _aligned(spark, sf_dir, "n_tset", "nfull_tset", "a_tset")


@query()
def partial_ratio(spark, sf_dir):
    return _aligned(spark, sf_dir, "n_partial", "a_partial")


# --- TF-IDF ----------------------------------------------------------------------------------------------------------


def _terms_sql(column: str, how: str) -> str:
    if how == "word":
        w = rf"regexp_extract_all(lower({column}), '([\p{{L}}\p{{N}}_]+)', 1)"
        return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    cuts = lambda n: f"list_transform(range(1, greatest(length(w) - {n} + 1, 1) + 1), lambda i: substr(w, i, {n}))"
    return f"flatten(list_transform(list_transform({_tokens(f'lower({column})')}, lambda t: ' ' || t || ' '), lambda w: CASE WHEN length(w) > 3 THEN list_concat({cuts(3)}, {cuts(4)}) ELSE {cuts(3)} END))"


def _tfidf_sql() -> str:
    parts = [f"SELECT '{v}' AS view, entity_id, unnest({_terms_sql(c, how)}) AS term FROM touched" for v, (c, how, _) in tfidf.VIEWS.items()]
    pruned = ", ".join(f"'{v}'" for v, (_, _, p) in tfidf.VIEWS.items() if p)
    return f"""{CAND}, touched AS (
    SELECT * FROM rec WHERE entity_id IN (SELECT a_id FROM cand UNION SELECT b_id FROM cand)
), terms AS (
    {' UNION ALL '.join(parts)}
), tf AS (SELECT view, entity_id, term, count(*) AS tf FROM terms GROUP BY ALL
), n AS (SELECT count(*) AS n FROM touched
), df AS (SELECT view, term, count(*) AS df, n FROM tf, n GROUP BY ALL
), idf AS (SELECT view, term, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM df WHERE view NOT IN ({pruned}) OR (df >= 2 AND df <= 0.5 * n)
), raw_w AS (SELECT view, entity_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (view, term)
), w AS (SELECT view, entity_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY view, entity_id)) AS w FROM raw_w)"""


def _weights(spark, sf_dir, *names):
    recs = _records(spark, sf_dir)
    views = {v: tfidf.VIEWS[v] for v in names}
    return tfidf.weights(tfidf.touched(recs, stage(_candidates(spark, sf_dir, recs).select("a_id", "b_id"), "pairs")), views)


@query(f"WITH {_tfidf_sql()} SELECT view, entity_id, term, round(w, 6) AS w FROM w WHERE view <> 'name_word'")
def tfidf_char(spark, sf_dir):
    return _weights(spark, sf_dir, "name_char", "full_char", "addr_char").select("view", "entity_id", "term", _round(F.col("w")).alias("w"))


@query(f"WITH {_tfidf_sql()} SELECT view, entity_id, term, round(w, 6) AS w FROM w WHERE view = 'name_word'")
def tfidf_word(spark, sf_dir):
    return _weights(spark, sf_dir, "name_word").select("view", "entity_id", "term", _round(F.col("w")).alias("w"))


def _cosine_sql() -> str:
    sums = ", ".join(f"sum(x.w * y.w) FILTER (x.view = '{v}') AS {v}" for v in tfidf.VIEWS)
    cols = ", ".join(f"round(coalesce({v}, 0), 6) AS {v}" for v in tfidf.VIEWS)
    return f"""{_tfidf_sql()}, dots AS (
    SELECT a_id, b_id, {sums} FROM cand JOIN w x ON x.entity_id = a_id JOIN w y ON y.entity_id = b_id AND y.view = x.view AND y.term = x.term GROUP BY a_id, b_id
), cosine AS (SELECT a_id, b_id, {cols} FROM cand LEFT JOIN dots USING (a_id, b_id))"""


@query(f"WITH {_cosine_sql()} SELECT * FROM cosine")
def pair_cosine(spark, sf_dir):
    recs = _records(spark, sf_dir)
    return tfidf.pair_cosines(recs, _written_pairs(recs))


# --- ranks -----------------------------------------------------------------------------------------------------------


def _rank_sql(key: str, prefix: str) -> str:
    return f"""WITH {VOTES}, o AS (
    SELECT a_id, b_id, score / 1000.0 :: DOUBLE AS base FROM votes
), r AS (
    SELECT *, rank() OVER w AS rk, row_number() OVER w AS rn, max(base) OVER (PARTITION BY {key}) AS top FROM o WINDOW w AS (PARTITION BY {key} ORDER BY base DESC)
), s AS (SELECT *, coalesce(max(CASE WHEN rn = 2 THEN base END) OVER (PARTITION BY {key}), 0.0) AS second FROM r)
SELECT a_id, b_id, base, CAST(rk AS DOUBLE) AS {prefix}_rank, round(CASE WHEN rk = 1 THEN base - second ELSE base - top END, 6) AS {prefix}_gap FROM s"""


def _ranked(spark, sf_dir, key, prefix):
    rows = _votes(spark, sf_dir).select("a_id", "b_id", (F.col("score") / 1000).alias("base"))
    return ranking.add_rank_gap(rows, key, prefix).select("a_id", "b_id", "base", f"{prefix}_rank", _round(F.col(f"{prefix}_gap")).alias(f"{prefix}_gap"))


@query(_rank_sql("a_id", "s1"))
def rank_gap_s1(spark, sf_dir):
    return _ranked(spark, sf_dir, "a_id", "s1")


@query(_rank_sql("b_id", "t"))
def rank_gap_target(spark, sf_dir):
    return _ranked(spark, sf_dir, "b_id", "t")


# --- decoding and evaluation -------------------------------------------------------------------------------------------

SCORED = f"""{CAND}, {RESOLVED}, sc AS (
    SELECT cand.a_id, cand.b_id, CAST(target = 'S3' AS INT) AS src, round(score / CAST(score + 100 AS DOUBLE), 6) AS p, CAST(res.a_id IS NOT NULL AS INT) AS label
    FROM cand LEFT JOIN res USING (a_id, b_id)
), best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY p DESC, a_id) = 1
), kept AS (SELECT * FROM best WHERE p >= CASE WHEN src = 0 THEN CAST(0.66 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)"""
THR2, THR3 = 0.66, 0.5

SCORES = f"""{SCORED}, es AS (
    SELECT tc.s1_id, lower(trim(rec.country)) AS country_key, coalesce(k.pred, 0) AS pred, truth_cnt, coalesce(k.tp, 0) AS tp FROM tc JOIN rec ON rec.entity_id = tc.s1_id
    LEFT JOIN (SELECT a_id, count(*) AS pred, count(*) FILTER (EXISTS (SELECT 1 FROM tp WHERE tp.s1_id = kept.a_id AND tp.t_id = kept.b_id)) AS tp FROM kept GROUP BY a_id) k ON k.a_id = tc.s1_id
), ef AS (SELECT *, CASE WHEN pred = 0 AND truth_cnt = 0 THEN 1.0 :: DOUBLE WHEN pred = 0 OR truth_cnt = 0 OR tp = 0 THEN 0.0 :: DOUBLE
    ELSE 1.25 :: DOUBLE * (tp / pred :: DOUBLE) * (tp / truth_cnt :: DOUBLE) / (0.25 :: DOUBLE * (tp / pred :: DOUBLE) + tp / truth_cnt :: DOUBLE) END AS f05 FROM es)"""


def _scored(spark, sf_dir, found=None):
    pairs = truth.label(_candidates(spark, sf_dir) if found is None else found, _resolved(spark, sf_dir))
    p = F.round(F.col("score") / (F.col("score") + 100), 6)
    return pairs.select("a_id", "b_id", (F.col("target") == "S3").cast("int").alias("src"), p.alias("p"), "label")


def _anchors(spark, sf_dir):
    rows = raw_records(spark, sf_dir).where("source = 'S1'")
    return rows.select(F.col("entity_id").alias("s1_id"), records.country_key(F.col("country")).alias("country_key"))


def _entity_scores(spark, sf_dir):
    predicted = decode.predictions(_scored(spark, sf_dir), THR2, THR3)
    return metric.entity_scores(_anchors(spark, sf_dir), predicted, truth.truth_pairs(er_truth(spark, sf_dir)))


@query(f"WITH {SCORED} SELECT * FROM best")
def best_per_target(spark, sf_dir):
    return decode.best_per_target(_scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT * FROM kept")
def threshold_filter(spark, sf_dir):
    return decode.over_threshold(decode.best_per_target(_scored(spark, sf_dir)), THR2, THR3)


@query(f"WITH {SCORED} SELECT s1_id, coalesce(string_agg(b_id, ',' ORDER BY b_id), '') AS matched_entity_ids FROM tc LEFT JOIN kept ON a_id = s1_id GROUP BY s1_id")
def prediction_lists(spark, sf_dir):
    anchors = _anchors(spark, sf_dir).select("s1_id")
    return decode.id_lists(anchors, decode.predictions(_scored(spark, sf_dir), THR2, THR3), "matched_entity_ids")


@query(f"WITH {SCORED}, many AS (SELECT * FROM sc WHERE p >= CASE WHEN src = 0 THEN CAST(0.66 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END) SELECT a_id, b_id FROM many")
def predictions_many_to_many(spark, sf_dir):
    return decode.predictions(_scored(spark, sf_dir), THR2, THR3, one_to_one=False)


@query(f"WITH {CAND} SELECT entity_id AS s1_id, coalesce(string_agg(b_id, ',' ORDER BY b_id), '') AS candidate_entity_ids FROM rec LEFT JOIN cand ON a_id = entity_id WHERE source = 'S1' GROUP BY entity_id")
def candidate_lists(spark, sf_dir):
    return decode.id_lists(_anchors(spark, sf_dir).select("s1_id"), _candidates(spark, sf_dir), "candidate_entity_ids")


@query(f"WITH {SCORES} SELECT s1_id, country_key, pred, truth_cnt, tp, round(f05, 9) AS f05 FROM ef")
def f05_per_entity(spark, sf_dir):
    return _entity_scores(spark, sf_dir).withColumn("f05", F.round("f05", 9))


@query(f"WITH {SCORES} SELECT round(avg(f05), 9) AS macro_f05, count(*) AS n FROM ef")
def macro_f05(spark, sf_dir):
    return metric.macro_f05(_entity_scores(spark, sf_dir)).withColumn("macro_f05", F.round("macro_f05", 9))


@query(f"WITH {SCORES} SELECT country_key, round(avg(f05), 9) AS macro_f05, count(*) AS n FROM ef GROUP BY country_key")
def f05_by_country(spark, sf_dir):
    return metric.macro_by_country(_entity_scores(spark, sf_dir)).withColumn("macro_f05", F.round("macro_f05", 9))


@query(f"WITH {TRUTH} SELECT avg(CAST(truth_cnt = 0 AS DOUBLE)) AS macro_f05 FROM tc")
def empty_baseline(spark, sf_dir):
    return metric.empty_baseline(truth.truth_counts(er_truth(spark, sf_dir)))


_GRID_SQL = ", ".join(f"({x} :: DOUBLE)" for x in decode.GRID)


@query(f"""WITH {SCORED}, gr AS (SELECT x.t AS thr2, y.t AS thr3 FROM (VALUES {_GRID_SQL}) x(t), (VALUES {_GRID_SQL}) y(t)
), c AS (SELECT thr2, thr3, a_id, count(*) AS pred, sum(label) AS tp FROM gr JOIN best ON p >= CASE WHEN src = 0 THEN thr2 ELSE thr3 END GROUP BY ALL
), e AS (SELECT gr.thr2, gr.thr3, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp, truth_cnt FROM gr CROSS JOIN tc LEFT JOIN c ON c.thr2 = gr.thr2 AND c.thr3 = gr.thr3 AND c.a_id = tc.s1_id
) SELECT thr2, thr3, round(avg(CASE WHEN pred = 0 AND truth_cnt = 0 THEN 1.0 :: DOUBLE WHEN pred = 0 OR truth_cnt = 0 OR tp = 0 THEN 0.0 :: DOUBLE
    ELSE 1.25 :: DOUBLE * (tp / pred :: DOUBLE) * (tp / truth_cnt :: DOUBLE) / (0.25 :: DOUBLE * (tp / pred :: DOUBLE) + tp / truth_cnt :: DOUBLE) END), 9) AS macro_f05 FROM e GROUP BY ALL""")
def threshold_grid(spark, sf_dir):
    counts = truth.truth_counts(er_truth(spark, sf_dir))
    return decode.threshold_scores(_scored(spark, sf_dir), counts).withColumn("macro_f05", F.round("macro_f05", 9))


@query(f"""WITH {SCORED} SELECT lower(trim(country)) AS country_key, round(avg(CAST(coalesce(m, 0) > 0 AS DOUBLE)), 6) AS match_rate, round(avg(coalesce(m, 0)), 6) AS avg_matches,
round(avg(coalesce(c, 0)), 6) AS avg_candidates FROM rec LEFT JOIN (SELECT a_id, count(*) AS m FROM kept GROUP BY a_id) k ON k.a_id = entity_id
LEFT JOIN (SELECT a_id, count(*) AS c FROM cand GROUP BY a_id) n ON n.a_id = entity_id WHERE source = 'S1' GROUP BY 1""")
def prediction_summary(spark, sf_dir):
    found = stage(_candidates(spark, sf_dir), "pairs")  # counted and scored
    predicted = decode.predictions(_scored(spark, sf_dir, found), THR2, THR3)
    return report.prediction_summary(_anchors(spark, sf_dir), predicted, found)


# --- splits ----------------------------------------------------------------------------------------------------------

_SPLIT = f"""{RAW}, {TRUTH}, n AS (
    SELECT entity_id, lower(trim(country)) AS country_key, row_number() OVER (PARTITION BY lower(trim(country)) ORDER BY md5(entity_id || '|42'), entity_id) AS rn,
        count(*) OVER (PARTITION BY lower(trim(country))) AS n FROM raw WHERE source = 'S1'
), fl AS (SELECT entity_id, country_key, rn <= round_even(n * 0.2 :: DOUBLE, 0) AS is_val FROM n
), ow AS (SELECT t_id, min(s1_id) AS owner FROM tp GROUP BY t_id)"""


def _uniform_sql(seed: int) -> str:
    return f"CAST('0x' || substr(md5(entity_id || '|{seed}'), 1, 8) AS BIGINT) / 4294967296.0 :: DOUBLE"


@query(f"WITH {_SPLIT} SELECT * FROM fl")
def stratified_split(spark, sf_dir):
    return split.validation_flags(raw_records(spark, sf_dir).where("source = 'S1'"))


@query(f"WITH {RAW} SELECT entity_id, lower(trim(country)) AS country_key, lower(trim(country)) = 'asia' AS is_val FROM raw WHERE source = 'S1'")
def holdout_split(spark, sf_dir):
    return split.validation_flags(raw_records(spark, sf_dir).where("source = 'S1'"), holdout_country=" Asia")


@query(f"""WITH {_SPLIT} SELECT raw.entity_id, raw.source, CASE WHEN owner IS NOT NULL THEN coalesce(fl.is_val, FALSE) ELSE {_uniform_sql(42).replace('entity_id', 'raw.entity_id')} < 0.2 END AS is_val
FROM raw LEFT JOIN ow ON ow.t_id = raw.entity_id LEFT JOIN fl ON fl.entity_id = owner WHERE source <> 'S1'""")
def target_ownership(spark, sf_dir):
    rows = raw_records(spark, sf_dir)
    flags = split.validation_flags(rows.where("source = 'S1'"))
    return split.target_flags(rows.where("source <> 'S1'").select("entity_id", "source", "country"), er_truth(spark, sf_dir), flags).drop("country")


def _tables(spark, sf_dir):
    rows = raw_records(spark, sf_dir)
    return split.Tables(*[rows.where(F.col("source") == s) for s in records.SOURCES], er_truth(spark, sf_dir))


@query(f"""WITH {RAW}, {TRUTH}, keep AS (SELECT entity_id FROM raw WHERE source = 'S1' ORDER BY md5(entity_id || '|0'), entity_id LIMIT 100
), ow AS (SELECT t_id, min(s1_id) AS owner FROM tp GROUP BY t_id)
SELECT entity_id, source FROM raw LEFT JOIN ow ON t_id = entity_id WHERE CASE WHEN source = 'S1' THEN entity_id IN (SELECT entity_id FROM keep)
WHEN owner IS NOT NULL THEN owner IN (SELECT entity_id FROM keep) ELSE {_uniform_sql(0)} < 100 / (SELECT count(*) FROM raw WHERE source = 'S1') :: DOUBLE END""")
def subsample(spark, sf_dir):
    t = split.subsample(_tables(spark, sf_dir), 100)
    return t.s1.unionByName(t.s2).unionByName(t.s3).select("entity_id", "source")


@query(f"""WITH {_SPLIT} SELECT CASE WHEN is_val THEN 'val' ELSE 'train' END AS part, count(*) AS s1, CAST(sum(len(ids)) AS BIGINT) AS matches
FROM fl JOIN tl ON s1_id = entity_id GROUP BY 1""")
def split_sizes(spark, sf_dir):
    parts = []
    for name, t in zip(("train", "val"), split.make_split(_tables(spark, sf_dir)), strict=True):
        held = t.s1.join(t.truth, t.s1["entity_id"] == t.truth["s1_id"])
        parts.append(held.agg(F.count(F.lit(1)).alias("s1"), F.sum(F.size("ids")).alias("matches")).select(F.lit(name).alias("part"), "s1", "matches"))
    return parts[0].union(parts[1])


# --- neighbours ------------------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    source = F.element_at(F.array(*map(F.lit, records.SOURCES)), (F.col("vec_id") % 3 + 1).cast("int"))
    return rows.select("vec_id", source.alias("source"), F.col("label").alias("country_key"), F.col("embedding").alias("vec"))


_KNN = """v AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'S3' END AS source, label, embedding :: DOUBLE[] AS e FROM embeddings
), knn AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, b.source AS target, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b USING (label)
    WHERE a.source = 'S1' AND b.source <> 'S1' QUALIFY row_number() OVER (PARTITION BY a.vec_id, b.source ORDER BY round(list_dot_product(a.e, b.e), 6) DESC, b.vec_id) <= 10)"""


def _nearest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    anchors = v.where("source = 'S1'").select(F.col("vec_id").alias("a_id"), "country_key", "vec")
    pool = v.where("source <> 'S1'").select(F.col("vec_id").alias("b_id"), "country_key", F.col("source").alias("target"), "vec")
    return rescue.nearest(anchors, pool, top_k=10, sim_min=0.2)


@query(f"WITH {_KNN} SELECT * FROM knn WHERE sim >= 0.2 :: DOUBLE")
def knn_rescue(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query(f"WITH {_KNN} SELECT a_id, b_id FROM knn WHERE sim >= 0.2 :: DOUBLE UNION SELECT a.vec_id, b.vec_id FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.source = 'S1'")
def candidates_with_rescue(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    ids = v.where("source <> 'S1'").select(F.col("vec_id").alias("b_id"))
    nextdoor = v.where("source = 'S1'").select(F.col("vec_id").alias("a_id")).join(ids, F.col("b_id") == F.col("a_id") + 1)
    return rescue.with_rescue(nextdoor, _nearest(spark, sf_dir))


@query(f"WITH {_KNN} SELECT a_id, b_id, sim AS name_embed_sim FROM knn")
def embed_similarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    anchors = v.where("source = 'S1'").select(F.col("vec_id").alias("a_id"), "country_key", "vec")
    pool = v.where("source <> 'S1'").select(F.col("vec_id").alias("b_id"), "country_key", F.col("source").alias("target"), "vec")
    pairs = rescue.nearest(anchors, pool, top_k=10, sim_min=-1.0).select("a_id", "b_id")
    return rescue.pair_similarity(pairs, v.select(F.col("vec_id").alias("entity_id"), "vec"))


# --- the classifier --------------------------------------------------------------------------------------------------


def _features(spark, sf_dir):
    recs = _records(spark, sf_dir)
    return truth.label(features.build_features(_written_pairs(recs), recs), _resolved(spark, sf_dir))


@query()
def pair_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query()
def gbt_scores(spark, sf_dir):
    rows = stage(_features(spark, sf_dir), "features")  # boosting reads them once per tree
    return model.score(rows, model.fit(rows))
