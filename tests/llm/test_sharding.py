import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from kinmatch.llm import sharding
from kinmatch.llm.sharding import numbered, permuted, shard


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 1023])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert got != list(range(n))


def test_permutation_against_plain_python(spark):
    """The network and the walk, with Spark's hash made from its public definition: XXH64, each value seeded by the hash before it."""

    def hashed(right, j):
        h = xxhash.xxh64_intdigest(struct.pack("<q", right), 42)
        for x in (sharding.SEED, j):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return h - (1 << 64) if h >> 63 else h

    def network(x, a, b):
        left, right = x % a, x // a
        for j in range(sharding.ROUNDS):
            m = a if j % 2 == 0 else b
            left, right = right, (left + hashed(right, j) % m) % m
        return right * a + left

    for n in (1, 7, 100, 1023):
        a = max(1, math.isqrt(max(n, 1) - 1) + 1)
        b = max(1, -(-n // a))
        want = []
        for x in range(n):
            p = network(x, a, b)
            while p >= n:
                p = network(p, a, b)
            want.append(p)
        assert [r[0] for r in spark.range(n).select("id", permuted(F.col("id"), n).alias("p")).orderBy("id").select("p").collect()] == want


def test_copies_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE", 60)
    rows = spark.createDataFrame([(7, 500), (8, 1), (9, 60), (10, 61)], "doc_id long, copies long")
    got = numbered(rows, ["doc_id"], 622, 500).collect()
    assert sorted(r["row_number"] for r in got) == list(range(622))
    assert Counter(r["doc_id"] for r in got) == {7: 500, 8: 1, 9: 60, 10: 61}


def test_whole_table(odd_docs, odd_items):
    rows = shard(odd_docs, 7).collect()
    assert len(rows) == len(odd_items)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in odd_items)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_same_in_any_partitioning(odd_docs):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(shard(odd_docs, 5)) == key(shard(odd_docs.repartition(1), 5))


def test_a_row_repeated_by_most_of_the_table(spark):
    rows = spark.createDataFrame([(7, 500), (8, 1)], "doc_id long, copies long")
    got = numbered(rows, ["doc_id"], 501, 500).collect()
    assert sorted(r["row_number"] for r in got) == list(range(501))


def test_no_rows(no_docs):
    assert shard(no_docs).collect() == []
