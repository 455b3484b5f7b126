import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from kinmatch.llm import near_dedup as nd
from kinmatch.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, key string, label int, node string"


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(items):
    """Component of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in items]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(items))


def check(spark, items):
    df = spark.createDataFrame([(d, t, "x", 1, "n") for d, t in items], SCHEMA).repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.link_documents(df).collect())
    assert got == brute(items)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10_000)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def crowd():
    """Copies of one text at many distances, a chain of edits, a shared passage in unlike texts and exact copies."""
    rng = random.Random(2)
    base = [f"b{rng.randrange(5000)}" for _ in range(150)]
    items = [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(150)]
    chain = [f"c{rng.randrange(5000)}" for _ in range(120)]
    for i in range(12):
        items.append((200 + i, " ".join(chain)))
        chain = edited(rng, chain, 2).split()
    passage = " ".join(f"p{k}" for k in range(30))
    items += [(300 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60)))) for i in range(150)]
    return items + [(500 + i, "exactly the same text in many rows of this table") for i in range(40)]


def test_against_all_pairs(spark, crowd):
    check(spark, crowd)


def test_small_leaves_and_chunks(spark, crowd, monkeypatch):
    for name, value in (("SMALL", 8), ("LARGEST", 20), ("CHUNK", 10)):
        monkeypatch.setattr(nd, name, value)
    check(spark, crowd)


@pytest.mark.parametrize(("first", "deepest"), [(0, 1), (1, 2)])
def test_oversized_leaves_are_compared_whole(spark, monkeypatch, first, deepest):
    """Pairs that share half of their words with all others."""
    for name, value in (("FIRST", first), ("CHUNK", 4), ("SMALL", 4), ("LARGEST", 4), ("DEPTH", 1), ("DEEPEST", deepest)):
        monkeypatch.setattr(nd, name, value)
    items = []
    for i in range(20):
        words = [f"g{k}" for k in range(100)] + [f"u{i}x{k}" for k in range(60)]
        items += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "end"]))]
    check(spark, items)


def test_odd_rows(spark, odd_items):
    check(spark, [(i, t) for i, t, *_ in odd_items])


def test_rows_without_an_id_link_others(spark):
    rng = random.Random(4)
    items = []
    for i, n in enumerate((1, 3)):  # both ends are near the middle, but not each other; the middle occurs n times
        words = [f"m{i}x{k}" for k in range(100)]
        left, right = [*words], [*words]
        left[20], left[50], right[70], right[95] = "l0", "l1", "r0", "r1"
        items += [(10 * i + 1, " ".join(left)), (10 * i + 2, " ".join(right))] + [(None, " ".join(words))] * n
    rng.shuffle(items)
    check(spark, items)
    assert sorted(c for (_, _, c) in brute(items).elements()) == [1] * 3 + [11] * 5


def test_kept_documents(odd_docs, odd_items):
    kept = nd.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    want = Counter()
    for (d, _, c), n in brute([(i, t) for i, t, *_ in odd_items]).items():
        if d == c:
            want[d] += n
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_rows_go_by_their_text(spark):
    """One id with a copy and another text; components with and without an id; columns named like the operator's own."""
    words = [f"w{k}" for k in range(60)]
    text, near, unlike = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"u{k}" for k in range(60))
    lone = " ".join(f"n{k}" for k in range(60))
    rows = [(1, text, "a"), (2, near, "b"), (2, unlike, "c"), (None, text, "d"), (None, lone, "e"), (None, lone + " end", "f"), (4, None, "g"), (None, "", "h"), (4, " ", "i")]
    kept = nd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    held = {r["row"] for r in kept.collect()}
    assert held - {"e", "f"} == {"a", "c", "g", "h", "i"} and len(held & {"e", "f"}) == 1


def test_copies_of_a_row_count_once(spark, monkeypatch):
    """5,000 copies of one row and of its near copy: as many sets and node rows as with two."""
    words = [f"w{k}" for k in range(60)]
    seen = []
    real_sets, real_near = nd.full_sets, nd.active
    monkeypatch.setattr(nd, "full_sets", lambda *a: seen.append((made := nd.cut(real_sets(*a), "sets")).count()) or made)
    monkeypatch.setattr(nd, "active", lambda *a: seen.append((made := nd.cut(real_near(*a), "active")).count()) or made)
    found = []
    for n in (2, 5000):
        seen.clear()
        docs = spark.range(n).selectExpr("7L AS doc_id", f"'{' '.join(words)}' AS text").union(spark.range(n).selectExpr("3L", f"'{' '.join(words[1:])}'"))
        got = Counter((r["doc_id"], r["component_id"]) for r in nd.link_documents(docs.repartition(4)).collect())
        assert got == {(7, 3): n, (3, 3): n}
        found.append(list(seen))
    assert found[0] == found[1]


def test_a_crowd_of_near_copies_is_not_branched(spark, monkeypatch):
    """Classes of one component leave before the second round's nodes branch: their children don't multiply."""
    rng = random.Random(6)
    base = [f"b{rng.randrange(5000)}" for _ in range(150)]
    items = [(i, edited(rng, base, 2)) for i in range(900)]
    monkeypatch.setattr(nd, "children", lambda rows, sigs: pytest.fail("branched") if rows.count() else rows)
    df = spark.createDataFrame([(d, t, "x", 1, "n") for d, t in items], SCHEMA)
    assert {r["component_id"] for r in nd.link_documents(df).collect()} == {0}


def test_no_rows(no_docs):
    assert nd.link_documents(no_docs).collect() == [] and nd.deduplicate(no_docs).collect() == []


def test_intersections_against_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    got = nd.intersections(sets)
    assert all(got[i, j] == len(set(a) & set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_nodes_that_fill_batches():
    rows = pd.DataFrame({"node": [1] * 5 + [2] * 7 + [3] + [4] * 2, "v": range(15)})
    seen = []
    run = nd.by_node(lambda g: seen.append(g["v"].tolist()))
    for size in range(1, 16):
        seen.clear()
        list(run(iter([rows.iloc[i : i + size].reset_index(drop=True) for i in range(0, 15, size)])))
        assert seen == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9, 10, 11], [13, 14]]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert {r["id"]: r["component"] for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
