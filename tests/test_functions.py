import random
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.functions import similarity as S
from kinmatch.functions import text as T


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expression.alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def test_normal_forms(spark):
    x = F.col("x")
    folded = T.lower_folded(x)
    assert column(spark, ["Été & Co.", "हिन्दी", "a_b  c", "", None], T.basic(folded)) == ["ete and co", "ह न द", "a b c", "", None]
    assert column(spark, ["Acme Tech Pvt Ltd", "The Co", "A.B.C. Intl"], T.name_norm(folded)) == ["acme technologies private limited", "the company", "a b c international"]
    core = T.name_core(T.name_norm(folded))
    assert column(spark, ["Acme Tech Pvt Ltd", "The Co"], core) == ["acme technologies", "the company"]
    assert column(spark, ["International Business Machines Corp", ""], T.acronym(core)) == ["ibm", ""]
    addresses = ["5 Hill Rd, Near SBI ATM, Pune", "near the well", "46 R Henri", "Opp. Mall; 3 N St"]
    assert column(spark, addresses, T.address_core(folded)) == ["5 hill road pune", "near the well", "46 rue henri", "3 north street"]


def test_digit_runs(spark):
    raw = ["5600012 560001 १२३४५ 12-3", "no", "00501 00501 7"]
    assert column(spark, raw, F.array_join(T.postal_codes(F.col("x")), ",")) == ["560001,१२३४५", "", "00501"]
    assert column(spark, raw, F.array_join(T.numbers(F.col("x")), ",")) == ["12,3,5600012", "", "7"]


def test_char_grams(spark):
    assert column(spark, ["abcde", "abcd", "abc", ""], F.array_join(T.char_grams(F.col("x"), 4), ",")) == ["abcd,bcde", "abcd", "", ""]


@settings(max_examples=200)
@given(st.text(alphabet="aeéèñçÅक़्हिंñ́̈ĳﬁ 1", max_size=12))
def test_folding_drops_marks_of_latin_letters_only(text):
    out = T.fold_text(text)
    for i, c in enumerate(out):
        if unicodedata.combining(c):
            assert i == 0 or ord(out[i - 1]) >= 0x250
    assert T.fold_text(out) == out


def slow_lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
def test_alignment_measures(x, y):
    assert S.lcs(x, y) == slow_lcs(x, y)
    if not x or not y:
        return
    short, long = sorted((x, y), key=len)
    windows = {long[max(0, e - len(short)) : e] for e in range(1, len(long) + len(short))} - {""}
    if len(x) == len(y):
        best = max(max(S.ratio(short, w) for w in windows), max(S.ratio(long, short[max(0, e - len(long)) : e] or "#") for e in range(1, len(short) + len(long))))
    else:
        best = max(S.ratio(short, w) for w in windows)
    assert S.partial_ratio(x, y) == pytest.approx(best)
    assert S.partial_ratio(x, y) == S.partial_ratio(y, x)
    assert 0 <= S.token_set_ratio(x, y) <= 1 and 0 <= S.jaro_winkler(x, y) <= 1


def test_known_values():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("abxx", "abyyzzww") == pytest.approx(0.583333, abs=1e-6)
    assert S.token_set_ratio("acme foods", "acme foods pune") == 1.0
    assert S.token_sort_ratio("b a", "a b") == 1.0
    assert S.partial_ratio("abc", "xxabcxx") == 1.0


def test_levenshtein_and_jaccard(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))), "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))) for _ in range(50)]
    df = spark.createDataFrame(pairs, "x string, y string")
    for r in df.select("x", "y", S.levenshtein_similarity(F.col("x"), F.col("y")).alias("v")).collect():
        d = list(range(len(r["y"]) + 1))
        for i, a in enumerate(r["x"], 1):
            last, d[0] = d[0], i
            for j, b in enumerate(r["y"], 1):
                last, d[j] = d[j], min(last + (a != b), d[j] + 1, d[j - 1] + 1)
        assert r["v"] == pytest.approx(1 - d[-1] / max(len(r["x"]), len(r["y"])))
    sets = spark.sql("SELECT array('a','b') AS x, array('b','c') AS y, CAST(array() AS array<string>) AS z")
    assert tuple(sets.select(S.jaccard(F.col("x"), F.col("y")), S.jaccard(F.col("x"), F.col("z"))).first()) == (1 / 3, None)


def test_short_names_are_matched_together(monkeypatch):
    names = [("martha", "marhta"), ("abxx", "abyyzzww"), ("a", "b"), ("dixon", "dicksonx"), ("é😀b", "b😀é"), ("ab", "ab"), ("a" * 64, "a" * 63 + "b")]
    want = [S.jaro_winkler(x, y) for x, y in names]
    one = pd.Series([x for x, _ in names]), pd.Series([y for _, y in names])
    monkeypatch.setattr(S, "jaro_winkler", None)  # no pair is worked on alone
    assert S.aligned.func(*one * 3)["n_jw"].tolist() == want
