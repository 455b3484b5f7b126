import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from kinmatch.llm import packing
from kinmatch.llm.common import cut

from .test_exact_dedup import groups
from .test_mixing import filled
from .test_near_dedup import WORD, brute
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def through(spark, docs, n):
    held = []
    for name, stage in corpus_pipeline.STAGES[:n]:
        docs = cut(stage(spark, docs, DATA), name)
        held.append(docs)
    return held


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    known, unique, apart, mixed = through(spark, docs, 4)
    assert all(x.columns == docs.columns for x in (known, unique, apart, mixed))
    assert known.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    want = {max(ids): None for ids in groups(rows).values()}
    rows = [(r["doc_id"], r["text"]) for r in unique.collect()]
    assert {d for d, _ in rows} == set(want) and len(rows) == len(want)
    assert Counter(r["doc_id"] for r in apart.collect()) == Counter(d for d, _, c in brute(rows).elements() if d == c)
    held = apart.collect()
    sizes = defaultdict(int)
    for r in held:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = filled(sizes)
    rate = {s: target[s] / sizes[s] for s in sizes}
    times = Counter(r["doc_id"] for r in mixed.collect())
    for r in held:
        assert int(rate[r["source"]] + 1e-9) <= times[r["doc_id"]] <= int(rate[r["source"]] + 1e-9) + 1
    taken = defaultdict(int)
    for r in held:
        taken[r["source"]] += times[r["doc_id"]] * len(WORD.findall(r["text"] or ""))
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.1 * sum(sizes.values())
    assert set(times) <= {r["doc_id"] for r in held}
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, DATA).collect()
    pieces = Counter()
    for r in mixed.collect():
        ids = packing.ids_of(r["text"], packing.default_path())
        pieces.update((r["doc_id"], s, n) for s, n in packing.cuts(len(ids)))
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in packed) == pieces


def test_odd_rows(spark, odd_docs, odd_items, no_docs):
    """What stays at each stage of nulls, empty and long texts, copies, ties and repeated rows; names of columns are kept."""
    held = through(spark, odd_docs, 4)
    assert all(x.columns == odd_docs.columns for x in held)
    letters = [(i, t) for i, t, *_ in odd_items if any(map(str.isalpha, t or ""))]
    known = [(r["doc_id"], r["text"]) for r in held[0].collect()]
    assert set(known) <= set(letters) and {5, 4, 11, 16} <= {d for d, _ in known}
    want = {max((x for x in ids if x is not None), default=None) for ids in groups(known).values()}
    unique = [(r["doc_id"], r["text"]) for r in held[1].collect()]
    assert {d for d, _ in unique} == want and len(unique) == len(groups(known))
    apart = Counter(r["doc_id"] for r in held[2].collect())
    stays = Counter(d for d, _, c in brute(unique).elements() if d == c)
    assert {d: n for d, n in apart.items() if d is not None} == {d: n for d, n in stays.items() if d is not None}
    assert {r["doc_id"] for r in held[3].collect()} <= set(apart)
    packed = corpus_pipeline.STAGES[4][1](spark, held[3], DATA)
    assert packed.columns[:3] == ["doc_id", "start", "length"] and {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in held[3].collect()}
    nothing = through(spark, no_docs, 4)
    assert all(x.columns == no_docs.columns and x.isEmpty() for x in nothing)
    assert corpus_pipeline.STAGES[4][1](spark, nothing[-1], DATA).isEmpty()


def test_texts_of_no_language_go(spark):
    """Letters, but none of the n-grams that the corpus' languages have."""
    plain = "the river walks under the old bridge and carries quiet songs"
    rows = [(i, plain, "en", "s", 1, "x") for i in range(30)] + [(100, "\u6f22\u5b57\u304b\u306a " * 9, "en", "s", 1, "y"), (101, "ZZQ XJQ QQX JJZ " * 5, None, "s", 1, "z")]
    rows = [r for r in rows if r[0] != 100] + [(next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 1), *rows[30][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, verdict string")
    kept = corpus_pipeline.keep_identified(spark, docs, DATA)
    assert kept.columns == docs.columns and {r["verdict"] for r in kept.collect()} == {"x"}
