import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from kinmatch.llm.exact_dedup import classes, deduplicate

LOWER = {i: i + 32 for i in range(65, 91)}


def groups(items):
    held = defaultdict(list)
    for i, t, *_ in items:
        held[(t or "").translate(LOWER)].append(i)
    return held


def check(rows, items):
    held = groups(items)
    want = sorted((str(i), str(max((x for x in held[(t or "").translate(LOWER)] if x is not None), default=None)), len(held[(t or "").translate(LOWER)])) for i, t, *_ in items)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in rows) == want


def test_against_brute_force(odd_docs, odd_items):
    rows = classes(odd_docs).collect()
    check(rows, odd_items)
    digests = {hashlib.sha256(t.encode()).digest() for t in groups(odd_items)}
    assert {bytes(r["digest"]) for r in rows} == digests


def test_texts_that_share_a_digest_stay_apart(odd_docs, odd_items):
    check(classes(odd_docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).collect(), odd_items)


def test_kept_rows(odd_docs, odd_items):
    kept = deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    texts = [(r["text"] or "").translate(LOWER) for r in rows]
    assert len(texts) == len(set(texts)) == len(groups(odd_items))
    held = groups(odd_items)
    assert all(r["doc_id"] == max((x for x in held[t] if x is not None), default=None) for r, t in zip(rows, texts))


def test_no_rows(no_docs):
    assert classes(no_docs).collect() == [] and deduplicate(no_docs).collect() == []


def test_columns_named_like_the_operators_own(spark):
    rows = [(1, "A text", "p", "q", 5, "r"), (2, "a TEXT", "s", "t", 6, "u"), (3, "b", "v", "w", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, own string, h int, __digest string")
    kept = deduplicate(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[1:])
