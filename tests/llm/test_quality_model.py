import hashlib
import math
import zlib

import numpy as np
import pytest

from kinmatch.llm import quality_model as q

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = q.op7_pu_quality(spark, DATA).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if r["held_out"]}
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in held if r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) > 0.93 * len(judged)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_risk_finds_the_positives_among_the_unlabelled():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 0.6, (3000, 3)), rng.normal(-1, 0.6, (1000, 3))
    model = q.fit(good[:1000], np.vstack([good[1000:], bad[:667]]), 0.75)
    assert (model.scores(good) >= 0.5).mean() > 0.97 and (model.scores(bad) < 0.5).mean() > 0.97


def test_risk_against_its_definition():
    """The risk by a plain loop, and its direction by differences; below zero the negative part alone is followed, reversed."""
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, (7, 3)), rng.normal(0, 1, (9, 3))
    for prior, shift in ((0.4, 0.0), (0.9, -4.0)):
        params = [rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=4), np.array([shift])]
        if shift:
            params[2] = -np.abs(params[2])

        def parts(params):
            g = lambda x: float(np.tanh(x @ params[0] + params[1]) @ params[2] + params[3][0])
            loss = lambda z: math.log1p(math.exp(-z))
            right = prior * sum(loss(g(x)) for x in p) / len(p)
            return right, sum(loss(-g(x)) for x in u) / len(u) - prior * sum(loss(-g(x)) for x in p) / len(p)

        right, negative = parts(params)
        risk, step = q.step_of(params, p, u, prior)
        assert risk == pytest.approx(right + max(0, negative))
        followed = (lambda x: sum(parts(x))) if negative >= 0 else (lambda x: -parts(x)[1])
        for i, g in enumerate(step):
            for at in np.ndindex(g.shape):
                moved = [[a.copy() for a in params] for _ in range(2)]
                moved[0][i][at] += 1e-5
                moved[1][i][at] -= 1e-5
                assert g[at] == pytest.approx((followed(moved[0]) - followed(moved[1])) / 2e-5, abs=1e-6)


def test_a_negative_part_below_zero():
    z = np.array([4.0, 5.0])
    right, negative = q.parts_of_risk(z, np.array([-3.0]), 0.9)
    assert negative < 0 < right


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_without_negatives(share):
    rng = np.random.default_rng(6)
    good, bad = rng.normal(1.2, 0.7, (6000, 3)), rng.normal(-1.2, 0.7, (4000, 3))
    n = int(4000 * share)
    unl = np.vstack([good[2000 : 2000 + n], bad[: 4000 - n]])
    assert abs(q.estimated_prior(good[:2000], rng.permutation(unl)) - share) < 0.06
    scores = rng.random(50)
    assert q.least_ratio(scores, scores) == 0.99  # equal sides: the ratio is 1 at any threshold


def test_sides_of_the_sample(spark):
    """Positives are held-in ones; unlabelled ids are held in and in no label; an id counts once, however often it occurs."""
    rows = [(i, f"text {i}") for i in range(200)] + [(3, "text 3")] * 50 + [(None, "x")] * 5
    labels = [(i, i % 2) for i in range(100)] + [(150, None), (None, 1), (2, 1)]
    pos, unl = q.samples(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    )
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    order = lambda ids: sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    for got, ids in ((pos, [i for i in held if i < 100 and (i % 2 or i == 2)]), (unl, [i for i in held if i >= 100 and i != 150])):
        want = np.array([q.features(f"text {i}") for i in order(ids)])
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-6)


def test_content_reads_words():
    a, b = (q.features(t)[len(q.SHAPE) :] for t in ("the river runs under the bridge", "xqz kvj wpf zzk qqv jjx"))
    assert np.abs(a - b).max() > 0.2 and np.allclose((a**2).sum(), 1)
    assert (q.features("The RIVER")[len(q.SHAPE) :] == q.features("the river")[len(q.SHAPE) :]).all()


def test_same_model_twice():
    rng = np.random.default_rng(4)
    p, u = rng.normal(size=(50, 4)), rng.normal(size=(80, 4))
    assert (q.fit(p, u, 0.5).scores(u) == q.fit(p, u, 0.5).scores(u)).all()


def test_features_of_plain_cases():
    got = dict(zip(q.SHAPE, q.features("Go go go\nGo go go"), strict=False))
    assert got["distinct"] == 2 / 6 and got["top"] == 4 / 6 and got["repeated_lines"] == 0.5
    assert not q.features("").any() and not q.features(" \n").any() and len(q.features("a")) == q.WIDTH


def test_odd_rows(spark, odd_docs, odd_items, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (8, None), (None, 1), (100, 0), (101, 1), (9999, 1)], "doc_id long, quality int")
    model = q.train(odd_docs, labels)
    scored = odd_docs.select("doc_id", q.score(model).alias("s")).collect()
    assert len(scored) == len(odd_items) and all(0 <= r["s"] <= 1 for r in scored)
    assert q.train(odd_docs, labels.where("false")) is None and q.train(no_docs, labels) is None
    assert {r[0] for r in odd_docs.select(q.score(None)).collect()} == {0.5}
    assert no_docs.select(q.score(model)).collect() == []
