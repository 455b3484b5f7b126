import re
from collections import Counter

from kinmatch.llm.quality_rules import LEAST, PRIOR, RULES, SPREAD, TAIL, bounds, judge, measure, sketch_bin, sketches, thresholds
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    again = {i + k for i, g in enumerate(windows) if seen[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_counts_against_brute_force(odd_docs, odd_items):
    rows = measure(odd_docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((i, *counts(t)) for i, t, *_ in odd_items)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)


def test_bins(spark):
    got = spark.range(0, 100_000, 37).select("id", sketch_bin(F.col("id")).alias("b")).collect()
    assert all(b <= i and i - b <= i / 512 and (i >= 1024 or i == b) for i, b in got)


def test_sketches_merge(odd_docs):
    held = measure(odd_docs)
    total = lambda df: {(r["rule"], r["bin"]): r["n"] for r in df.groupBy("rule", "bin").agg(F.sum("n").alias("n")).collect()}
    parts = sketches(held.where("doc_id % 2 = 0")).unionByName(sketches(held.where("doc_id % 2 <> 0 OR doc_id IS NULL")))
    assert total(parts) == total(sketches(held))


def test_outliers_go_and_plain_texts_stay(spark):
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(words[(i * 7 + k * (i % 5 + 1)) % 400] for k in range(80)), "en" if i % 2 else None, "web") for i in range(200)]
    rows += [(900, " ".join(f"{w}###" for w in words[:80]), "en", "web"), (901, " ".join(words[:80]).upper(), None, "web"), (902, " ".join(words[:80]), "xx", None)]
    judged = judge(measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()
    assert {r["doc_id"] for r in judged if not r["kept"]} == {900, 901}


def test_a_small_group_leans_on_its_language(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words, "en", "big") for i in range(40)] + [(99, words.replace("w", "w#"), "en", "small")]
    held = measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    by = {r["source"]: r for r in thresholds(sketches(held)).collect()}
    # own bounds: a median of 0 without any spread (the floor, 100), and 1000 plus a quarter
    assert by["big"]["high_symbols"] == 100 and by["small"]["high_symbols"] == (1250 + PRIOR * 100) // (1 + PRIOR)
    assert {r["doc_id"] for r in judge(held).collect() if not r["kept"]} == {99}


def plain_bounds(values, sides, floor):
    """The bounds of one rate by sorting all its values, without a sketch."""
    held = sorted(values)
    q = lambda p: next(v for i, v in enumerate(held, 1) if 100 * i >= p * len(held))
    out = {}
    for side, near, far in (("low", 25, 10), ("high", 75, 90)):
        reach = max(SPREAD * abs(q(near) - q(50)) or TAIL * abs(q(far) - q(50)), q(50) // LEAST) or floor
        out[side] = max(0, q(50) - reach) if side == "low" else q(50) + reach
    return {s: out[s] for s in ("low", "high") if sides in ("±", "-" if s == "low" else "+")}


def test_bounds_against_sorted_values(spark):
    """Rates below 1024 have bins of their own, so the sketch's bounds are those of all values."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = measure(docs)
    rows = [r for r in held.collect() if not r["base_failed"]]
    got = {r["lang"]: r for r in bounds(sketches(held), ["lang"]).collect()}
    assert len(got) > 1
    for rule, (sides, floor) in RULES.items():
        if rule == "length":  # above 1024
            continue
        for lang, b in got.items():
            want = plain_bounds([r[rule] for r in rows if r["lang"] == lang and r[rule] < 1024] if rule != "symbols" else [r[rule] // 2 * 2 if 1024 <= r[rule] < 2048 else r[rule] // 4 * 4 if r[rule] >= 2048 else r[rule] for r in rows if r["lang"] == lang], sides, floor)
            assert {s: b[f"{s}_{rule}"] for s in want} == want


def test_no_rows(no_docs):
    assert judge(measure(no_docs)).collect() == []
