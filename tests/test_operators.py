import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinmatch import staging
from kinmatch.operators import blocking, decode, features, metric, model, ranking, records, rescue, split, tfidf, truth

RECORDS = "entity_id string, business_name string, business_address string, country string"


def frame(spark, rows, schema=RECORDS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    words = ["acme", "zenith", "orbit", "pune", "hill", "garden", "temple", "road", "the", "no"]
    make = lambda tag, n: [(f"{tag}-{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), f"{rng.randrange(9)} {rng.choice(words)} Rd, {rng.randrange(10000, 10004)}", rng.choice(["US", " us", "IN", ""])) for i in range(n)]
    return records.build_records(*[frame(spark, make(t, n)) for t, n in (("S1", 25), ("S2", 30), ("S3", 20))]).cache()


def keys_of(r):
    name, address = r["name_core"].replace(" ", ""), r["addr_core"].replace(" ", "")
    out = [("tok", t) for t in r["name_core"].split() if len(t) >= 3 and t not in blocking.COMMON_NAME_WORDS]
    if len(name) >= 4:
        out += [("pre4", name[:4])] + [("ng4", name[i : i + 4]) for i in range(len(name) - 3)]
    out += [("pin", p) for p in r["postal"]] + ([("apre6", address[:6])] if len(address) >= 6 else [])
    out += [("atok", t) for t in r["addr_core"].split() if len(t) >= 4 and not t.isdigit() and t not in blocking.COMMON_ADDRESS_WORDS]
    return out + [("num", n) for n in r["nums"]]


@pytest.mark.parametrize("bucket,cand", [(1000, 50), (6, 3), (5, 4)])
def test_votes_against_a_plain_loop(spark, small, bucket, cand):
    rows, want = small.collect(), {}
    for target in ("S2", "S3"):
        index = defaultdict(list)
        for r in rows:
            if r["source"] == target:
                for k in set(keys_of(r)):
                    index[(r["country_key"], *k)].append(r["entity_id"])
        for r in rows:
            if r["source"] != "S1":
                continue
            got = defaultdict(int)
            for k in keys_of(r):
                held = index.get((r["country_key"], *k), [])
                for b in held if len(held) <= bucket else []:
                    got[b] += blocking.WEIGHTS[k[0]]
            for b, v in sorted(got.items(), key=lambda x: (-x[1], x[0]))[:cand]:
                want[(r["entity_id"], b)] = v
    got = blocking.candidates(small, blocking.BlockingConfig(max_bucket=bucket, max_cand=cand)).collect()
    assert {(r["a_id"], r["b_id"]): r["score"] for r in got} == want


def test_unique_ids(spark, small):
    records.assert_unique(small)
    with pytest.raises(ValueError):
        records.assert_unique(small.union(small))


def test_rank_and_gap(spark):
    rows = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("a", "z", 0.2), ("b", "x", 0.9)], "a_id string, b_id string, base double")
    got = {(r["a_id"], r["b_id"]): (r["s1_rank"], round(r["s1_gap"], 6)) for r in ranking.add_rank_gap(rows, "a_id", "s1").collect()}
    assert got == {("a", "x"): (1, 0.0), ("a", "y"): (1, 0.0), ("a", "z"): (3, -0.3), ("b", "x"): (1, 0.9)}


def f05(p, t):
    if not p and not t:
        return 1.0
    tp = len(p & t)
    if not tp:
        return 0.0
    return 1.25 * (tp / len(p)) * (tp / len(t)) / (0.25 * tp / len(p) + tp / len(t))


def test_golden_metric(spark):
    anchors = spark.createDataFrame([("1",), ("2",), ("3",)], "s1_id string")
    given = spark.createDataFrame([("1", "S2-00047"), ("1", "S2-00193"), ("1", "S3-00812"), ("3", "x")], "a_id string, b_id string")
    due = spark.createDataFrame([("1", "S2-00047"), ("1", "S3-00812")], "s1_id string, t_id string")
    got = {r["s1_id"]: r["f05"] for r in metric.entity_scores(anchors, given, due).collect()}
    assert got == {"1": pytest.approx(0.7142857), "2": 1.0, "3": 0.0}


def test_threshold_search_against_a_plain_loop(spark):
    rng = random.Random(9)
    pairs = [(f"a{rng.randrange(12)}", f"b{i}", rng.randrange(2), round(rng.random(), 2), rng.randrange(2)) for i in range(60)]
    pairs += [(f"a{rng.randrange(12)}", b, s, round(rng.random(), 2), 0) for _, b, s, _, _ in pairs[:25]]
    pairs = list({(a, b): (a, b, s, p, y) for a, b, s, p, y in pairs}.values())
    due = {f"a{i}": sum(y for a, _, _, _, y in pairs if a == f"a{i}") + i % 2 for i in range(13)}
    best = {}
    for a, b, s, p, y in sorted(pairs, key=lambda x: (-x[3], x[0])):
        best.setdefault(b, (a, s, p, y))
    top = (-1.0, 0, 0)
    for t2 in decode.GRID:
        for t3 in decode.GRID:
            kept = [x for x in best.values() if x[2] >= (t3 if x[1] else t2)]
            total = 0.0
            for a, n in due.items():
                mine = [x for x in kept if x[0] == a]
                total += f05(set(range(len(mine))), set(range(sum(x[3] for x in mine))) | set(range(100, 100 + n - sum(x[3] for x in mine))))
            if round(total / len(due), 12) >= top[0]:
                top = (round(total / len(due), 12), t2, t3)
    scored = spark.createDataFrame(pairs, "a_id string, b_id string, src int, p double, label int")
    got = decode.tune_thresholds(scored, spark.createDataFrame(list(due.items()), "s1_id string, truth_cnt long"))
    assert (got.thr2, got.thr3) == top[1:] and got.macro_f05 == pytest.approx(top[0])


def test_truth_and_lists(spark):
    raw = spark.createDataFrame([("a", "x, y,,x"), ("b", ""), ("c", None)], "source1_entity_id string, matched_entity_ids string")
    held = truth.parse_truth(raw)
    assert {r["s1_id"]: r["ids"] for r in held.collect()} == {"a": ["x", "y"], "b": [], "c": []}
    pairs = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "a_id string, b_id string")
    assert {r["s1_id"]: r["m"] for r in decode.id_lists(held.select("s1_id"), pairs, "m").collect()} == {"a": "x,y", "b": "", "c": ""}


def test_terms(spark):
    df = spark.createDataFrame([("a bcd",)], "x string")
    assert df.select(tfidf.char_terms(F.col("x"))).first()[0] == [" a ", " bc", "bcd", "cd ", " bcd", "bcd "]
    assert df.select(tfidf.word_terms(F.col("x"))).first()[0] == ["a", "bcd", "a bcd"]


def test_no_pairs(spark, small):
    none = small.select(F.col("entity_id").alias("a_id"), F.col("entity_id").alias("b_id")).where("false")
    assert tfidf.pair_cosines(small, none).collect() == []


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rescue, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(rescue, "POOL_BLOCK", 5)
    rng = random.Random(2)
    vec = lambda: [rng.random() - 0.5 for _ in range(4)]
    a = [(i, i % 2, vec()) for i in range(10)]
    b = [(i, i % 2, "S2" if i % 3 else "S3", vec()) for i in range(30)]
    got = rescue.nearest(spark.createDataFrame(a, "a_id long, country_key int, vec array<double>"), spark.createDataFrame(b, "b_id long, country_key int, target string, vec array<double>"), 2, 0.1)
    want = set()
    for i, c, v in a:
        for t in ("S2", "S3"):
            sims = sorted(((-round(sum(x * y for x, y in zip(v, w)), 6), j) for j, d, u, w in b if d == c and u == t))[:2]
            want |= {(i, j, -s) for s, j in sims if -s >= 0.1}
    assert {(r["a_id"], r["b_id"], r["sim"]) for r in got.collect()} == want


def test_split_keeps_matches_with_their_anchor(spark):
    s1 = frame(spark, [(f"S1-{i}", "n", "a", "US" if i % 3 else "IN") for i in range(50)])
    s2 = frame(spark, [(f"S2-{i}", "n", "a", "US") for i in range(60)])
    s3 = frame(spark, [(f"S3-{i}", "n", "a", "IN") for i in range(10)])
    gt = spark.createDataFrame([(f"S1-{i}", [f"S2-{i}"]) for i in range(50)], "s1_id string, ids array<string>")
    train, val = split.make_split(split.Tables(s1, s2, s3, gt))
    ids = lambda df: {r[0] for r in df.select("entity_id").collect()}
    assert len(ids(val.s1)) == 10 and not ids(val.s1) & ids(train.s1)
    assert {x for x in ids(val.s2) if int(x[3:]) < 50} == {x.replace("S1", "S2") for x in ids(val.s1)}
    assert {r["s1_id"] for r in val.truth.collect()} == ids(val.s1)
    _, held = split.make_split(split.Tables(s1, s2, s3, gt), holdout_country=" in ")
    assert len(ids(held.s1)) == 17 and ids(held.s3) == ids(s3)
    few = split.subsample(split.Tables(s1, s2, s3, gt), 5)
    assert few.s1.count() == few.truth.count() == 5
    assert split.subsample(split.Tables(s1, s2, s3, gt), 50).s1 is s1


def test_model_takes_missing_values(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"a{i}", f"b{i}", 0, float(i % 2) if rng.random() < 0.8 else None, rng.random(), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "a_id string, b_id string, src int, n_ratio double, base double, label int")
    names = ["src", "n_ratio", "base"]
    fitted = model.fit(df, names, model.GbtParams(max_iter=5), validation=df)
    scored = model.score(df, fitted, names)
    assert scored.columns == ["a_id", "b_id", "label", "src", "p"]
    right = [r for r in scored.collect() if (r["p"] > 0.5) == r["label"]]
    assert len(right) > 150 and model.best_iteration(fitted) >= 1 and model.refit_iterations(100) == 114
    assert model.importances(fitted, names)[0][0] == "n_ratio"


def test_the_query_fits_the_operators_default_model(spark, monkeypatch):
    from kinmatch import queries

    given = []
    fit = model.fit
    monkeypatch.setattr(queries, "_features", lambda spark, sf_dir: spark.range(1))
    monkeypatch.setattr(model, "fit", lambda rows, **more: given.append(more.get("params", fit.__defaults__[1])))
    monkeypatch.setattr(model, "score", lambda rows, fitted: rows)
    queries.gbt_scores(spark, "")
    assert given == [model.GbtParams()]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_once(small):
    assert plan(tfidf.weights(small)).count("Generate explode") == 0  # frequencies and weights read the written counts


def test_vectors_are_made_once(spark, small):
    pairs = frame(spark, [("S1-1", "S2-1"), ("S1-1", "S3-2")], "a_id string, b_id string")
    assert "Window" not in plan(tfidf.pair_cosines(small, pairs))  # both sides of a pair read the written vectors


def test_pairs_meet_texts_not_vectors(spark, small):
    pairs = frame(spark, [("S1-1", "S2-1"), ("S1-1", "S3-2")], "a_id string, b_id string")
    assert "term" not in plan(tfidf.pair_cosines(small, pairs))


def test_cosines_don_t_depend_on_how_many_terms_are_held(spark, monkeypatch):
    rng = random.Random(4)
    name = lambda: " ".join(rng.choice(["acme", "Ünal", "x", "foods", "3m", "a-b_c", "日本", "acme"]) for _ in range(rng.randrange(5)))
    raw = [frame(spark, [(f"S{k}-{i}", name(), name(), "IN") for i in range(20)]) for k in (1, 2, 3)]
    held = records.build_records(*raw)
    pairs = frame(spark, [(f"S1-{i}", f"S{k}-{j}") for i in range(20) for k in (2, 3) for j in range(0, 20, 3)] + [("S1-1", "none")], "a_id string, b_id string")
    cosines = lambda: {tuple(r) for r in tfidf.pair_cosines(held, pairs).collect()}
    some = cosines()
    assert len(some) == 281 and len({r[4] for r in some}) > 20
    monkeypatch.setattr(tfidf, "KEPT", 0)
    assert cosines() == some
    monkeypatch.setattr(tfidf, "VOCABULARY", 0)
    assert cosines() == some and "term" in plan(tfidf.pair_cosines(held, pairs))


def test_features_of_two_records_are_written_once(spark, small):
    pairs = frame(spark, [("S1-1", "S2-1"), ("S1-1", "S3-2")], "a_id string, b_id string")
    assert "aligned(" not in plan(features.build_features(pairs, small))  # cosines and string measures take one shuffle of the pairs


def test_features_read_written_cosines(spark, small):
    pairs = frame(spark, [("S1-1", "S2-1"), ("S1-1", "S3-2")], "a_id string, b_id string")
    made = features.build_features(pairs, small)
    assert "run(" not in plan(made) and made.count() == 2  # dot products are in the written table


def test_tables_of_the_cosines_go_when_read(spark, small):
    at = Path(staging.shared_dir(spark).removeprefix("file:"))
    kept = lambda: {p.name.rpartition("-")[0] for p in at.iterdir() if p not in before}
    before = set(at.iterdir())
    pairs = frame(spark, [("S1-1", "S2-1"), ("S1-1", "S3-2")], "a_id string, b_id string")
    made = features.build_features(pairs, small)
    assert kept() == {"cosines"} and made.count() == 2


def test_votes_and_their_best_take_one_shuffle(spark, small):
    keys = staging.stage(blocking.blocking_keys(small), "keys")
    made = blocking.top_candidates(blocking.votes(keys))._jdf.queryExecution().executedPlan().toString()
    assert made.count("hashpartitioning(a_id") == 1


def test_equal_inputs_are_given_once():
    names = model.inputs(features.FEATURES)
    assert len(names) == 40 and names[-5:] == ["n_ratio_missing", "nfull_tset_missing", "a_ratio_missing", "pc_eq_missing", "num_jacc_missing"]
    assert model.inputs(["src", "n_jw", "n_lev", "base"])[4:] == ["n_jw_missing"]


def test_boosting_starts_on_a_collected_heap(spark, monkeypatch):
    done = []
    monkeypatch.setattr(model, "collect_garbage", lambda session: done.append("collected"), raising=False)
    monkeypatch.setattr(model.Pipeline, "fit", lambda self, rows: done.append("fitted"))
    model.fit(frame(spark, [(0, 0.5, 1)], "src int, base double, label int"), ["src", "base"])
    assert done == ["collected", "fitted"]
