import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.llm import substring_dedup as sd
from kinmatch.staging import shared_dir


def brute(texts, length):
    """The bytes that stay and the spans that go, by counting all windows."""
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((bytes(c for c, g in zip(b, gone) if not g), sd.runs(gone)))
    return out


def passages(texts, length):
    """The runs of words that go with windows of `length` words found twice."""
    split = [b.split() for b in texts]
    seen = Counter(tuple(w[p : p + length]) for w in split for p in range(len(w) - length + 1))
    out = []
    for w in split:
        held = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                held[p : p + length] = True
        out.append(sd.runs(held))
    return out


def check(df, items, length, passage=12, **kw):
    plain = lambda spans: str([tuple(s) for s in spans])
    rows = sd.remove_repeats(df, length, passage, **kw).collect()
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), plain(r["spans"]), plain(r["passages"])) for r in rows)
    texts = [(t or "").encode() for _, t in items]
    want = Counter(
        (d, len(b), kept, str(spans), str(said)) for (d, _), b, (kept, spans), said in zip(items, texts, brute(texts, length), passages(texts, passage))
    )
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(1, 9))
def test_transform_against_counting(parts, length):
    seen = Counter(b[p : p + length] for b in parts for p in range(len(b) - length + 1))
    for b, flags in zip(parts, sd.repeated([np.frombuffer(b, np.uint8) for b in parts], length)):
        assert flags.tolist() == [seen[b[p : p + length]] > 1 for p in range(len(b) - length + 1)]


def test_large_and_small_sorts_agree():
    rng = np.random.default_rng(1)
    t = np.r_[rng.integers(1, 5, 3000), rng.integers(1, 5, 300), [0]].astype(np.uint16)
    t = np.r_[t, t[:900]]
    order = sd.suffix_order(t, 50)
    ring = np.r_[t, t, t]
    key = [tuple(ring[i : i + 50]) for i in order]
    assert key == sorted(key) and sorted(order) == list(range(len(t)))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 123) for _ in range(700))
    a, b = b"x" * 50 + shared + b"tail" * 30, bytes(rng.randrange(97, 123) for _ in range(333)) + shared

    def anchor_of(text):
        low, starts, anchor, _ = sd.regions(np.frombuffer(text, np.uint8))
        return np.repeat(anchor, starts)

    assert (anchor_of(a)[50 : 50 + 301] == anchor_of(b)[333 : 333 + 301]).all()


@pytest.fixture(scope="module")
def items():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    shared = [text(n) for n in (60, 120, 300, 47, 48, 49)]
    rows = [(i, text(rng.randrange(0, 80)) + rng.choice(shared) + text(rng.randrange(0, 80)) + rng.choice(shared)) for i in range(60)]
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n))
    said = [say(n) for n in (11, 12, 13, 30)]
    rows += [(200 + i, say(rng.randrange(0, 9)) + "\n" + rng.choice(said) + " \t" + say(rng.randrange(0, 9)) + " " + rng.choice(said)) for i in range(30)]
    rows += [(100, "ab" * 200), (101, text(30)), (102, ""), (103, None), (None, shared[1]), (104, rows[3][1]), (104, rows[3][1]), (105, "z" * 48), (106, "z" * 47)]
    return rows


SCHEMA = "doc_id long, text string, row string, low int"


@pytest.mark.parametrize("kw", [{}, {"bucket": 2000}, {"largest": 500}])
def test_against_counting(spark, items, kw):
    check(spark.createDataFrame([(d, t, "r", 1) for d, t in items], SCHEMA).repartition(3), items, 48, **kw)


def test_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    part = "".join(rng.choice("abcdef") for _ in range(1500))
    rows = [(1, part + "".join(rng.choice("abcdef") for _ in range(2000)) + part[100:900]), (2, part[700:])]
    monkeypatch.setattr(sd, "BLOCK", 256)
    whole = sd.regions(np.frombuffer(rows[0][1].encode(), np.uint8))
    assert whole[1].sum() == len(rows[0][1]) - 399
    check(spark.createDataFrame([(d, t, "r", 1) for d, t in rows], SCHEMA), rows, 400)


def test_copies_of_a_row_are_handled_once(spark, monkeypatch):
    """5,000 equal rows beside a near copy: as many parts and runs as with two of them."""
    rng = random.Random(8)
    text = " ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(300))
    other = text[:700] + "#" + text[701:]
    counts = []
    real = sd.class_parts
    monkeypatch.setattr(sd, "class_parts", lambda *a: counts.append((made := sd.cut(real(*a), "parts")).count()) or made)
    for n in (2, 5000):
        docs = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.range(1).select(F.lit(2).cast("long"), F.lit(other)))
        rows = sd.remove_repeats(docs.repartition(4)).select("doc_id", "n_bytes", F.octet_length("kept").alias("left")).collect()
        assert Counter((r["doc_id"], r["left"]) for r in rows) == {(1, 0): n, (2, len(brute([text.encode(), text.encode(), other.encode()], 400)[2][0])): 1}
    assert counts[1] <= 4 * counts[0]


def test_words_in_blocks(monkeypatch):
    rng = random.Random(9)
    text = " \t".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(200)).encode()
    whole = sd.words(np.frombuffer(text, np.uint8))
    assert len(whole) == 200 and len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.setattr(sd, "BLOCK", 64)
    assert (sd.words(np.frombuffer(text, np.uint8)) == whole).all()
    assert len(sd.words(np.frombuffer(b"x" * 500 + b" y", np.uint8))) == 2
    lines = text.replace(b" \t", b"\n")
    assert (sd.words(np.frombuffer(lines, np.uint8)) == whole).all()


def test_odd_rows(odd_docs, odd_items):
    check(odd_docs, [(i, t) for i, t, *_ in odd_items], 400)


def test_no_rows(no_docs):
    assert sd.remove_repeats(no_docs).collect() == []


def test_tables_go_when_no_step_reads_them(spark):
    at = shared_dir(spark).removeprefix("file:")
    held = lambda: {n for n in os.listdir(at) if n.startswith(("regions-", "anchors-", "classes-"))}
    before = held()
    docs = spark.createDataFrame([(1, "abcdefgh" * 90), (2, "x" + "abcdefgh" * 90)], "doc_id long, text string")
    made = sd.remove_repeats(docs)
    assert held() == before and sorted(r["doc_id"] for r in made.collect()) == [1, 2]
