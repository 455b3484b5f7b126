"""Quality rules whose thresholds adapt to each language and source.

Every text gets counts (words, symbols, repeated lines, repeated three-word windows, ...) in SQL functions alone. From these
come rates in thousandths. A sketch of a rate is a histogram whose bins keep the ten leading bits of a value, so a quantile is
right to 0.2 %, sketches of parts add up to the sketch of the whole, and the same rows give the same sketch in any order.
Sketches are summed per language and source, and from there per language and for the whole table. A text is kept unless a rate lies beyond
its group's bounds: the median plus or minus SPREAD times the distance to the quartile, or, where the quartile is the median, TAIL times the
distance to the decile, and in any case one LEASTth of the median, so that groups of much the same texts don't lose harmless ones. Only where all
three are 0, as the median and the decile are 0, RULES' floor stands in for them: such a sketch says nothing about how far is too far.
A group's bounds are averaged with its language's, which count as PRIOR documents, and a language's likewise with the table's; so
small groups lean on larger ones without a size at which the rule changes.

Defined cases: a null or empty text, or one without words, has counts 0 and fails the base rule. Null languages and sources
are values of their own. Repeated rows each count. Ties don't matter, as a sketch has no order of rows. Very long texts are counted whole, in one row.
An empty table gives an empty result. Further columns are ignored. Windows of a text are told apart by a 64-bit hash of their three words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, GAP, cut, documents, sized

#: rate: sides checked ("+" above, "-" below, "±" both), and the distance from the median where the sketch has no spread, in thousandths.
RULES = {
    "symbols": ("+", 100),
    "capitals": ("+", 200),
    "repeats": ("+", 250),
    "lines": ("+", 400),
    "distinct": ("-", 300),
    "length": ("±", 2500),
}
SPREAD = 10
TAIL = 20
LEAST = 4
PRIOR = 30


def measure(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source): the counts and rates of every text, as a table from cut().

    It is written for two reasons: it is read twice, and a filter pushed below would put the sort of windows inside a lambda.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    core = F.btrim(text, F.lit(BLANKS))
    m = docs.select(
        "doc_id",
        "lang",
        "source",
        F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, GAP)).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    m = m.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.when(
            F.size("w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("grams"),
    )
    # Only texts with a repeated window pay for the sort.
    again = F.size("grams") > F.size(F.array_distinct("grams"))
    found = F.when(again, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    m = m.withColumn("sorted", found.otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("grams")
    twice = lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"])
    at = F.transform(F.filter("sorted", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])
    m = m.withColumn("at", F.sort_array(at)).drop("sorted")
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"))
    m = m.withColumn("n_repeat_words", F.aggregate("at", none, step, lambda acc: acc["n"]).cast("long")).drop("at")
    m = m.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.expr("coalesce(1000 * n_symbols div nullif(n_words, 0), 0)").alias("symbols"),
        F.expr("coalesce(1000 * n_capitals div nullif(word_chars, 0), 0)").alias("capitals"),
        F.expr("coalesce(1000 * n_repeat_words div nullif(n_words, 0), 0)").alias("repeats"),
        F.expr("coalesce(1000 * n_dup_lines div nullif(n_lines, 0), 0)").alias("lines"),
        F.expr("coalesce(1000 * n_distinct div nullif(n_words, 0), 0)").alias("distinct"),
        F.expr("coalesce(1000 * word_chars div nullif(n_words, 0), 0)").alias("length"),
    )
    return cut(m, "measured")


def sketch_bin(v: Column) -> Column:
    """The lower end of v's bin: v without its bits below the ten leading ones."""
    drop = F.greatest(F.length(F.bin(v)) - 10, F.lit(0))
    width = F.pow(F.lit(2), drop).cast("long")
    return v - F.pmod(v, width)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n): one mergeable sketch per language, source and rule, of texts that pass the base rule."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])).alias("x")
    rows = measured.where(~F.col("base_failed")).select("lang", "source", rates)
    return rows.groupBy("lang", "source", F.col("x.rule").alias("rule"), sketch_bin(F.col("x.v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bounds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows and for each rule r: low_r, high_r."""
    merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    merged = merged.select("*", F.sum("n").over(group).alias("rows"), F.sum("n").over(group.orderBy("bin")).alias("below"))
    q = lambda p: F.min(F.when(100 * F.col("below") >= p * F.col("rows"), F.col("bin"))).alias(f"q{p}")
    marks = merged.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), *map(q, (10, 25, 50, 75, 90)))
    up, up_tail, down, down_tail = F.col("q75") - F.col("q50"), F.col("q90") - F.col("q50"), F.col("q50") - F.col("q25"), F.col("q50") - F.col("q10")

    def reach(near: Column, far: Column, floor: int) -> Column:
        out = F.greatest(F.when(near > 0, SPREAD * near).otherwise(TAIL * far), F.expr(f"q50 div {LEAST}"))
        return F.when(out > 0, out).otherwise(F.lit(floor))

    out = []
    for rule, (sides, floor) in RULES.items():
        here = F.col("rule") == rule
        if sides != "+":
            out.append(F.max(F.when(here, F.greatest(F.lit(0), F.col("q50") - reach(down, down_tail, floor)))).alias(f"low_{rule}"))
        if sides != "-":
            out.append(F.max(F.when(here, F.col("q50") + reach(up, up_tail, floor))).alias(f"high_{rule}"))
    return marks.groupBy(*keys).agg(F.max("rows").alias("rows"), *out)


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and the bounds that hold there: the group's own, averaged with its language's and the table's."""
    own, by_lang, overall = bounds(sketch, ["lang", "source"]), bounds(sketch, ["lang"]), bounds(sketch, [])
    names = [c for c in own.columns if c.startswith(("low_", "high_"))]
    lean = lambda mine, wider: F.expr(f"(rows * {mine} + {PRIOR} * {wider}) div (rows + {PRIOR})")
    by_lang = by_lang.join(F.broadcast(overall.select(*[F.col(c).alias(f"o_{c}") for c in names])))  # one row
    by_lang = by_lang.select(F.col("lang").alias("of"), *[lean(c, f"o_{c}").alias(f"m_{c}") for c in names])
    both = own.join(by_lang, own["lang"].eqNullSafe(by_lang["of"]))
    return both.select("lang", "source", *[lean(c, f"m_{c}").alias(c) for c in names])


def judge(measured: DataFrame) -> DataFrame:
    """measured (a table from cut()) with `kept`."""
    held = sized(cut(thresholds(sketches(measured)), "thresholds").withColumnsRenamed({"lang": "of_lang", "source": "of_source"}))
    rows = measured.join(held, measured["lang"].eqNullSafe(held["of_lang"]) & measured["source"].eqNullSafe(held["of_source"]), "left")
    within = [F.col(r) >= F.col(f"low_{r}") for r, (s, _) in RULES.items() if s != "+"] + [F.col(r) <= F.col(f"high_{r}") for r, (s, _) in RULES.items() if s != "-"]
    fine = ~F.col("base_failed")
    for x in within:
        fine = fine & F.coalesce(x, F.lit(True))
    return rows.select(*measured.columns, fine.alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(measure(documents(spark, sf_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    levels = {"g": "lang, source, rule", "m": "lang, rule", "o": "rule"}
    parts = [
        r"""WITH d AS (
    SELECT doc_id, lang, source, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        CAST(coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS BIGINT) AS n_symbols,
        CAST(coalesce(len(regexp_extract_all(text, '[A-Z]')), 0) AS BIGINT) AS n_capitals
    FROM documents
), win AS (
    SELECT doc_id, CAST(i AS BIGINT) AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), dup AS (
    SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
    SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), c AS (
    SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        n_symbols, n_capitals, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, coalesce(rep.n, 0) AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id)
), m AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        coalesce(1000 * n_symbols // n_words, 0) AS symbols, coalesce(1000 * n_capitals // word_chars, 0) AS capitals,
        coalesce(1000 * n_repeat_words // n_words, 0) AS repeats, coalesce(1000 * n_dup_lines // n_lines, 0) AS lines,
        coalesce(1000 * n_distinct // n_words, 0) AS "distinct", coalesce(1000 * word_chars // n_words, 0) AS length
    FROM c
), v AS (
"""
        + "\n    UNION ALL ".join(f"""SELECT lang, source, '{r}' AS rule, CAST("{r}" AS BIGINT) AS v FROM m WHERE NOT base_failed""" for r in RULES)
        + """
), s AS (
    SELECT lang, source, rule, v - v % CAST(pow(2, greatest(0, length(CASE WHEN v = 0 THEN '0' ELSE bin(v) END) - 10)) AS BIGINT) AS bin, count(*) AS n
    FROM v GROUP BY ALL
)"""
    ]
    for p, keys in levels.items():
        group = keys.rpartition("rule")[0].rstrip(", ")
        cols = []
        for r, (sides, floor) in RULES.items():
            reach = lambda near, far: f"coalesce(nullif(greatest(CASE WHEN {near} > 0 THEN {SPREAD} * ({near}) ELSE {TAIL} * ({far}) END, q50 // {LEAST}), 0), {floor})"
            down, up = reach("q50 - q25", "q50 - q10"), reach("q75 - q50", "q90 - q50")
            low = f"max(greatest(0, q50 - {down})) FILTER (rule = '{r}') AS low_{r}"
            high = f"max(q50 + {up}) FILTER (rule = '{r}') AS high_{r}"
            cols += [low] * (sides != "+") + [high] * (sides != "-")
        parts.append(f"""{p}1 AS (SELECT {keys}, bin, sum(n) AS n FROM s GROUP BY ALL
), {p}2 AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS rows, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS below FROM {p}1
), {p}3 AS (SELECT {keys}, max(rows) AS rows, {', '.join(f'min(bin) FILTER (100 * below >= {q} * rows) AS q{q}' for q in (10, 25, 50, 75, 90))} FROM {p}2 GROUP BY ALL
), {p} AS (SELECT {group + ', ' if group else ''}max(rows) AS rows, {', '.join(cols)} FROM {p}3 {'GROUP BY ' + group if group else ''})""")
    names = [f"{side}_{r}" for r, (s, _) in RULES.items() for side in (["low"] * (s != "+") + ["high"] * (s != "-"))]
    lean = lambda t, c, wider: f"({t}.rows * {t}.{c} + {PRIOR} * {wider}.{c}) // ({t}.rows + {PRIOR}) AS {c}"
    parts[2] = parts[2].replace("), m AS (", "), m_ AS (")
    parts.append(f"ml AS (SELECT m_.lang, {', '.join(lean('m_', c, 'o') for c in names)} FROM m_, o)")
    parts.append(f"t AS (SELECT g.lang, g.source, {', '.join(lean('g', c, 'ml') for c in names)} FROM g JOIN ml ON g.lang IS NOT DISTINCT FROM ml.lang)")
    tests = [f'coalesce(m."{c.split("_")[1]}" {">=" if c.startswith("low") else "<="} t.{c}, TRUE)' for c in names]
    return ", ".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""


OP8_SQL = _sql()
