import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinmatch.llm import packing as p


def test_ids_equal_the_reference_tokenizer(odd_items):
    whole = Tokenizer.from_file(p.default_path())
    whole.encode_special_tokens = True
    texts = [t for _, t, *_ in odd_items if t] + ["<|endoftext|> a", "  \n\n\t x", "can't we'll", "\x00\x01", "a" * 5000, " " * 500, "é" * 300]
    for t in texts:
        assert p.ids_of(t, p.default_path()).tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


MARK = "<|endoftext|>"


@pytest.mark.parametrize("texts", [
    [f"a{MARK}b", MARK, MARK * 3, f"x  {MARK}  y\n", f"<|endof{MARK}text|>", MARK[:-1], MARK + " é " * 3000 + MARK],
    [f"{MARK} " + " " * 1_000_100 + "z", "\n" * 1_000_100],
], ids=["added", "blanks"])
def test_packed_ids_equal_the_tokenizer_at_its_defaults(spark, texts):
    whole = Tokenizer.from_file(p.default_path())
    rows = p.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, p.CLOSE], "<u4")
        want.update((i, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)) for start, n in p.cuts(len(ids)))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=80), st.integers(1, 12))
def test_differencing_keeps_every_item(sizes, k):
    groups = p.karmarkar_karp(sizes, k)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and len(groups) <= k


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 257) for _ in range(600)]
    sums = [sum(sizes[i] for i in g) for g in p.karmarkar_karp(sizes, 40)]
    assert max(sums) - min(sums) <= 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=120))
def test_blocks_fit(sizes):
    groups = p.pack_block(sizes)
    assert all(sum(sizes[i] for i in g) <= p.CAPACITY for g in groups)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))


def test_cuts():
    assert p.cuts(1) == [(0, 1)] and p.cuts(2048) == [(0, 2048)] and p.cuts(2049) == [(0, 2048), (2048, 1)]
    assert sum(n for _, n in p.cuts(99_999)) == 99_999


def test_whole_table(odd_docs, odd_items):
    rows = p.pack(odd_docs).collect()
    want = Counter()
    for i, t, *_ in odd_items:
        ids = p.ids_of(t, p.default_path())
        for start, n in p.cuts(len(ids)):
            want[(i, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= p.CAPACITY
    total = sum(r["length"] for r in rows)
    assert len(held) <= np.ceil(total / p.CAPACITY) + 1


def test_no_rows(no_docs):
    assert p.pack(no_docs).collect() == []
