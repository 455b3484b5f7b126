import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.mixing import CAP, OP6_SQL, WEIGHTS, copies, hashed, mix, mixed, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = {s: CAP * sizes[s] for s in free if rest * weight[s] / w > CAP * sizes[s]}
        if not over:
            return capped | {s: rest * weight[s] / w for s in free}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 500, "b": 200, "c": 100}, {"a": 500, "b": 440, "c": 60}, {"a": 5, "b": 2, "c": 1, "d": 1000}, {"a": 7, "b": 7, "c": 7, "d": 7}, {"a": 0, "b": 0}, {"a": 10, "b": 1000, None: 40, "": 3}, {"x": 5}, {"a": 0, "b": 7}, {f"s{i}": (i * 37) % 101 + 1 for i in range(20)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r for r in source_targets(rows).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s]["target"] == pytest.approx(want[s])
        assert got[s]["rate"] == pytest.approx(want[s] / sizes[s] if sizes[s] else 0)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 5, 10, 20, 50, 100, 500, 10_000]), min_size=1, max_size=9))
def test_targets_with_ties(sizes):
    """The operator's rule and the SQL's against the process itself, on sizes that tie often."""
    held = {f"s{i}": n for i, n in enumerate(sizes)}
    want = filled(held)
    with duckdb.connect() as db:
        db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (1, repeat('w ', ?), ?)", [(n, s) for s, n in held.items()])
        found = db.sql(f"SELECT DISTINCT source_size, target FROM ({OP6_SQL})").fetchall()
    assert Counter(round(t, 6) for _, t in found).keys() == {round(t, 6) for t in want.values()}
    spark = SparkSession.getActiveSession()
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(held.items()), "source string, size long")).collect()}
    assert got == pytest.approx(want) and all(t >= 0 for t in got.values())


def test_a_copy_is_drawn_with_the_probability_of_the_fraction(spark):
    u = spark.range(20_000).select(hashed(F.col("id")).alias("u"))
    for rate in (0.29, 1.5, 2.0):
        taken = u.select(F.sum(copies(F.lit(rate), F.col("u")))).first()[0]
        assert abs(taken / 20_000 - rate) < 0.015


def test_any_names_of_columns(spark):
    rows = [(i, "w " * 5, f"s{i % 2}", 1, 2, 3, 4) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, of int, rate int, copy int, copies int")
    assert mix(docs).columns == docs.columns and mix(docs).count() == 20


def test_whole_table(odd_docs, odd_items):
    rows = mixed(odd_docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, _, s in odd_items)
    for r in rows:
        assert int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 and r["copies"] <= CAP
    assert sorted(map(str, rows)) == sorted(map(str, mixed(odd_docs.repartition(1)).collect()))
    made = mix(odd_docs)
    assert made.columns == odd_docs.columns
    want = Counter()
    for r in rows:
        want[(r["doc_id"], r["source"])] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in made.collect()) == +want


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 4}") for i in range(8000)]
    held = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, variance = defaultdict(int), {}, defaultdict(float)
    for r in held:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        variance[r["source"]] += r["size"] ** 2 * (r["rate"] % 1) * (1 - r["rate"] % 1)
    # draws are independent: four standard deviations of their sum, and a tenth of the target at this size
    assert all(abs(taken[s] - target[s]) <= min(4 * variance[s] ** 0.5 + 1e-6, 0.1 * target[s]) for s in target)


def test_no_rows(no_docs):
    assert mixed(no_docs).collect() == [] and mix(no_docs).collect() == []
