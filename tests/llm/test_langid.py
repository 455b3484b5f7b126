import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import langid
from kinmatch.llm.langid import GramFilters, codes, counted, gram_hashes

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return langid.learn(docs, langid.held_in(F.col("doc_id")))


def built(grams, log2):
    """Filters from grams by language, slot by slot."""
    languages = sorted(grams)
    kind, masks = langid.layout(len(languages))
    bits = kind().itemsize * 8
    table = np.zeros((masks, 1 << log2), kind)
    for k, name in enumerate(languages):
        for i in range(langid.HASHES):
            table[k // bits, langid.slots(grams[name], i, log2)] |= kind(1 << (k % bits))
    return GramFilters.of(languages, table, log2)


def test_filters_hold_their_grams_and_little_else():
    rng = np.random.default_rng(1)
    grams = {name: rng.integers(0, 2**63, 5000, dtype=np.uint64) for name in "abc"}
    f = built(grams, 17)
    for k, name in enumerate("abc"):
        for other in grams:
            mask = f.table[0][langid.slots(grams[other], 0, 17)].copy()
            for i in range(1, langid.HASHES):
                mask &= f.table[0][langid.slots(grams[other], i, 17)]
            share = ((mask >> k) & 1).mean()
            assert share == 1 if other == name else abs(share - f.false_rate[k]) < 0.01


def test_more_than_eight_languages():
    rng = np.random.default_rng(2)
    grams = {f"l{i:02d}": rng.integers(0, 2**63, 50, dtype=np.uint64) for i in range(70)}
    f = built(grams, 12)
    assert f.table.shape[0] == 2 and f.languages[69] == "l69"


@pytest.mark.parametrize("languages", [3, 70])
def test_learning_against_a_plain_count(spark, languages, monkeypatch):
    """The table and the sample: all grams of the chosen documents of each language, and no others."""
    monkeypatch.setattr(langid, "SAMPLE", 5)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 150)
    rng = random.Random(7)
    rows = [(i if i else None, "".join(rng.choice("abcdéß ,") for _ in range(rng.randrange(0, 60))), f"l{rng.randrange(languages):02d}") for i in range(20 * languages)]
    rows += [rows[5]] * 30 + [(9000, None, "l00"), (9001, "abc", None)]
    train = lambda d: zlib.crc32(str(d).encode()) % 3 != 1
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), langid.held_in(F.col("doc_id")), 12)
    grams = {}
    for name in sorted({x for d, t, x in rows if x and t is not None and (d is None or train(d))}):
        held, chars = np.zeros(0, np.uint64), 0
        ids = sorted({d for d, t, x in rows if x == name and t is not None and d is not None and train(d)}, key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
        for d in ids[:5]:
            text = next(t for e, t, _ in rows if e == d)
            if chars >= 150:
                break
            chars += len(text)
            c = codes(text)
            for n in langid.ORDERS:
                found = [gram_hashes(c[i : i + n], n)[0] for i in range(len(c) - n + 1) if not (c[i] == 32 and c[i + 1] == 32)]
                held = np.r_[held, np.array(found, np.uint64)]
        grams[name] = held
    want = built(grams, 12)
    assert model.languages == want.languages and (model.table == want.table).all()


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, "text", f"l{i}") for i in range(20)]
    with pytest.raises(ValueError):
        langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def test_counts_do_not_depend_on_how_texts_are_grouped(model, monkeypatch):
    texts = ["Über den Fluss", "a", "", "the and of with " * 400, "été", "x" * 3000, " . "]
    whole = [counted(model, [t]) for t in texts]
    n, found = counted(model, texts)
    monkeypatch.setattr(langid, "BLOCK", 500)
    n2, found2 = counted(model, texts)
    for i, (a, b) in enumerate(whole):
        assert n[i] == n2[i] == a[0] and (found[i] == b[0]).all() and (found2[i] == found[i]).all()


def test_counts_against_sets(model):
    text = "Eauouon. Enpaeux leaux le ouè eauenaux"
    n, found = counted(model, [text])
    hits = np.zeros(len(model.languages), int)
    total = 0
    c = codes(text)
    for order in langid.ORDERS:
        for i in range(len(c) - order + 1):
            if c[i] == 32 and c[i + 1] == 32:
                continue
            total += 1
            h = gram_hashes(c[i : i + order], order)
            mask = ~np.uint8(0)
            for j in range(langid.HASHES):
                mask = mask & model.table[0][langid.slots(h, j, model.log2)][0]
            hits += [(int(mask) >> k) & 1 for k in range(len(hits))]
    assert n[0] == total and (found[0] == hits).all()


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.op10_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if r["held_out"]}
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd_docs, odd_items, model):
    rows = odd_docs.select("*", langid.identifier(spark, model)(F.col("text")).alias("v")).collect()
    assert len(rows) == len(odd_items)
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["v"]["lang"] == "und") == (not letters) and (letters or r["v"]["score"] == 0)


def test_nothing_to_learn_from(spark, no_docs, odd_docs):
    empty = langid.learn(no_docs, langid.held_in(F.col("doc_id")))
    verdict = langid.identifier(spark, empty)(F.col("text")).alias("v")
    assert {r["v"]["lang"] for r in odd_docs.select(verdict).collect()} == {"und"}
    assert no_docs.select(verdict).collect() == []
