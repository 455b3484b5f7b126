"""String measures against their definitions, written out plainly, and choices that tie."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.functions import similarity as S
from kinmatch.operators import decode, features, model, ranking, truth

WORDS = st.lists(st.sampled_from(["acme", "acm", "co", "global", "x", "foods", "ab", "ba"]), min_size=1, max_size=5).map(" ".join)
TEXTS = st.text("abc ", min_size=1, max_size=12).filter(str.strip)


def indel(x, y):
    """1 - insertions and deletions by lengths, from the table of common subsequences."""
    held = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            held[i][j] = held[i - 1][j - 1] + 1 if a == b else max(held[i - 1][j], held[i][j - 1])
    return 1 - (len(x) + len(y) - 2 * held[-1][-1]) / (len(x) + len(y)) if x or y else 1.0


@settings(max_examples=300, deadline=None)
@given(TEXTS | WORDS, TEXTS | WORDS)
def test_ratio_and_token_sort(x, y):
    assert S.ratio(x, y) == pytest.approx(indel(x, y))
    tidy = lambda t: " ".join(sorted(t.split()))
    assert S.token_sort_ratio(x, y) == pytest.approx(indel(tidy(x), tidy(y)))


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_token_set(x, y):
    """The best of: the words in both with one side's rest against those with the other's, and each of them against the words in both."""
    a, b = set(x.split()), set(y.split())
    both, left, right = (" ".join(sorted(s)) for s in (a & b, a - b, b - a))
    whole = [" ".join(t for t in (both, r) if t) for r in (left, right)]
    if both and not (left and right):
        want = 1.0
    else:
        want = max(indel(*whole), *([indel(both, w) for w in whole] if both else [0.0]))
    assert S.token_set_ratio(x, y) == pytest.approx(want)


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_partial(x, y):
    """The best ratio of the shorter text with any window of its length, or cut off at an end, of the longer."""

    def best(short, long):
        n = len(short)
        return max(indel(short, long[max(0, e - n) : min(e, len(long))]) for e in range(1, len(long) + n))

    want = max(best(x, y), best(y, x)) if len(x) == len(y) else best(*sorted((x, y), key=len))
    assert S.partial_ratio(x, y) == pytest.approx(want)


MANY = st.lists(st.tuples(st.text("abcé ", max_size=70), st.text("abcé ", max_size=70)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(MANY | st.lists(st.tuples(WORDS, WORDS), max_size=12))
def test_many_at_once(pairs):
    """The measures of a batch are those of its pairs, texts longer than a machine word and empty ones among them."""
    xs, ys = [x for x, _ in pairs], [y for _, y in pairs]
    assert S.lcs_many(xs, ys).tolist() == [S.lcs(x, y) for x, y in pairs]
    assert S.ratio_many(xs, ys) == pytest.approx([S.ratio(x, y) for x, y in pairs])
    assert S.token_set_many(xs, ys) == pytest.approx([S.token_set_ratio(x, y) for x, y in pairs])
    held = [(x, y) for x, y in pairs if x and y]
    assert S.partial_many([x for x, _ in held], [y for _, y in held]) == pytest.approx([S.partial_ratio(x, y) for x, y in held])


def test_the_last_of_equal_thresholds_wins(spark):
    """All thresholds up to the lowest p give the same value: the highest of them is taken, for S2 before S3."""
    pairs = [("a", "x", 0, 0.9, 1), ("a", "y", 1, 0.7, 1), ("b", "z", 0, 0.31, 0)]
    scored = spark.createDataFrame(pairs, "a_id string, b_id string, src int, p double, label int")
    counts = spark.createDataFrame([("a", 2), ("b", 0)], "s1_id string, truth_cnt long")
    best = decode.tune_thresholds(scored, counts)
    assert (best.thr2, best.thr3, best.macro_f05) == (0.9, 0.7, 1.0)
    none = decode.tune_thresholds(scored.where("false"), counts.where("false"))
    assert (none.thr2, none.thr3) == (0.5, 0.5)


def test_positive_rate(spark):
    rows = spark.createDataFrame([(1,), (0,), (0,), (1,), (1,)], "label int")
    assert truth.positive_rate(rows) == pytest.approx(0.6) and truth.positive_rate(rows.where("false")) == 0


@pytest.fixture(scope="module")
def pairs(spark):
    """Feature rows whose label is decided by n_ratio, with missing values in it."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        v = rng.random()
        held = {f: rng.random() for f in features.FEATURES} | {"src": i % 2, "n_ratio": None if i % 10 == 0 else v, "a_id": f"a{i}", "b_id": f"b{i}"}
        rows.append(held | {"label": int(i % 10 != 0 and v > 0.5)})
    schema = ", ".join(["a_id string", "b_id string", "label int", *[f"{f} {'int' if f == 'src' else 'double'}" for f in features.FEATURES]])
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def test_missing_values_have_their_own_mark(pairs):
    held = model.filled(pairs).select("n_ratio", "n_ratio_missing", "src").collect()
    assert all((r["n_ratio"] == model.MISSING) == (r["n_ratio_missing"] == 1.0) for r in held)
    assert sum(r["n_ratio_missing"] for r in held) == 60


def test_fit_score_and_refit(pairs):
    params = model.GbtParams(max_iter=30, max_depth=3)
    train, val = pairs.where("cast(substr(a_id, 2) as int) % 3 > 0"), pairs.where("cast(substr(a_id, 2) as int) % 3 = 0")
    fitted = model.fit(train, params=params, validation=val)
    rows = model.score(val, fitted).collect()
    # the boundary at 0.5 falls between histogram bins, so a few pairs beside it may go wrong
    assert len(rows) == 200 and sum((r["p"] >= 0.5) == (r["label"] == 1) for r in rows) >= 194
    assert model.importances(fitted)[0][0] in ("n_ratio", "n_ratio_missing")
    assert 1 <= model.best_iteration(fitted) <= 30
    assert [model.refit_iterations(x) for x in (1, 43, 44, 100)] == [50, 50, 50, 114]


def test_pruned_columns_are_ignored(pairs):
    kept = ["src", "n_ratio", "a_ratio"]
    fitted = model.fit(pairs, kept, model.GbtParams(max_iter=5, max_depth=2))
    assert {"src", "p", "base"} <= set(model.score(pairs, fitted, kept).columns) and model.score(pairs.drop("base"), fitted, kept).count() == 600


def test_base_is_the_mean_that_ranks_follow(spark):
    rows = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.9), ("a", "z", 0.1), ("b", "x", 0.4)], "a_id string, b_id string, base double")
    got = {(r["a_id"], r["b_id"]): (r["s1_rank"], round(r["s1_gap"], 6)) for r in ranking.add_rank_gap(rows, "a_id", "s1").collect()}
    assert got == {("a", "x"): (1.0, 0.0), ("a", "y"): (1.0, 0.0), ("a", "z"): (3.0, -0.8), ("b", "x"): (1.0, 0.4)}
