import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinmatch import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


#: One query or two of each group; the others share their parts.
NAMES = (
    "normalised_records", "name_core", "addr_core", "postal_codes", "blocking_keys", "votes_small_buckets", "candidates_topk", "weak_entities", "truth_lists",
    "blocking_recall", "matched_share", "num_overlap", "jaro_winkler", "pair_cosine", "positive_rate", "rank_gap_s1", "prediction_lists", "f05_by_country", "threshold_grid",
    "target_ownership", "subsample", "knn_rescue",
)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, DATA)
    want = sql.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r[c] for c in names) for r in got.collect()) == order(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["a_id", "b_id", "target", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_prediction_summary_finds_candidates_once(spark, sql, monkeypatch):
    calls, votes = [], queries.blocking.votes
    monkeypatch.setattr(queries.blocking, "votes", lambda *a: calls.append(a) or votes(*a))
    test_against_sql(spark, sql, "prediction_summary")
    assert len(calls) == 1
