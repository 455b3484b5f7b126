"""Language ID with language-bitmask n-gram filters.

A Bloom filter per language, sliced by bit: slot s of one table holds a mask with a bit for each language whose filter has
bit s set. AND over a gram's HASHES slots gives all languages that contain it in HASHES reads, whatever their number. A
text's count for a language is the popcount of that language's bit over the text's n-grams; of n grams, a filter with
false positive rate f is expected to report n * f wrongly, so the corrected count is (hits - n * f) / (1 - f).

Training reads a bounded sample of each language: of the documents whose crc32(id) mod 3 is not 1, those with the smallest md5 of
their id, SAMPLE at most, and no further one once SAMPLE_CHARS code points are passed. A language's filter holds every gram of its sample, so
it answers which languages contain a gram. The table has a fixed size, so what is sent to executors doesn't grow with the data: 2 MB for up to 8
languages, else 16 MB for each 64; MOST_LANGUAGES are accepted (128 MB), more are an error. It is put together from pieces of PIECE slots, each made in a task of its own.

Defined cases: a null text or one without letters is `und` with score 0. Where no gram counts for any language, the
first language by name is predicted with score 0; of languages with equal counts the first by name. Without training rows everything is `und`.
Repeated rows are scored alike; rows without an id are held in, but not sampled. An empty table gives an empty result. Further columns, whatever
their names, are left alone. Very long texts are counted in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, documents, uniform

ORDERS = (2, 3, 4)
SAMPLE = 1000
SAMPLE_CHARS = 8_000_000
SLOTS_LOG2 = 21
PIECE = 4096
HASHES = 3
MOST_LANGUAGES = 512
BLOCK = 1 << 19
#: A document is rejected if a smaller share of its grams than this is known to its language.
LEAST_COVER = 0.2

_ASCII = np.array([ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)], np.uint32)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def codes(text: str) -> np.ndarray:
    """Lower-case code points, with a space for every ASCII character that isn't a letter and one at either end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, _ASCII[np.minimum(c, 127)], c)


def gram_hashes(c: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram of c."""
    with np.errstate(over="ignore"):
        wide = c.astype(np.uint64)
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h += wide[i : len(c) - n + 1 + i] * _MULTIPLIERS[i]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def slots(h: np.ndarray, i: int, log2: int) -> np.ndarray:
    """The i-th slot of each gram: another cut of its hash."""
    return ((h >> np.uint64(i * 21)) & np.uint64((1 << log2) - 1)).astype(np.int64)


@dataclass
class GramFilters:
    languages: list[str]
    table: np.ndarray  # words x slots
    false_rate: np.ndarray  # by language
    log2: int

    @classmethod
    def of(cls, languages: list[str], table: np.ndarray, log2: int) -> GramFilters:
        bits = table.itemsize * 8
        fill = [((table[k // bits] >> table.dtype.type(k % bits)) & table.dtype.type(1)).mean() for k in range(len(languages))]
        return cls(languages, table, np.array(fill) ** HASHES, log2)

    def hits(self, c: np.ndarray, starts: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the texts that begin at starts in c: grams, and grams reported by each language's filter. With a limit, of those grams
        that begin in the first `limit` characters of the first text."""
        bits = self.table.itemsize * 8
        n, found = np.zeros(len(starts), np.int64), np.zeros((len(starts), len(self.languages)), np.int64)
        owner = np.searchsorted(starts, np.arange(len(c)), "right") - 1
        for order in ORDERS:
            if len(c) < order:
                continue
            own = owner[: len(c) - order + 1]
            keep = own == owner[order - 1 :]  # no gram runs over into the next text
            blank = c == 32
            keep &= ~(blank[: len(own)] & blank[1 : len(own) + 1])  # runs of blanks are no evidence
            if limit is not None:
                keep[limit:] = False
            h, own = gram_hashes(c, order)[keep], own[keep]
            if not len(h):
                continue
            at = [slots(h, i, self.log2) for i in range(HASHES)]
            n += np.bincount(own, minlength=len(starts))
            for w in range(len(self.table)):
                mask = self.table[w][at[0]]
                for x in at[1:]:
                    mask &= self.table[w][x]
                for k in range(w * bits, min(len(self.languages), (w + 1) * bits)):
                    found[:, k] += np.bincount(own[((mask >> mask.dtype.type(k % bits)) & mask.dtype.type(1)) > 0], minlength=len(starts))
        return n, found

    def corrected(self, n: np.ndarray, found: np.ndarray) -> np.ndarray:
        return np.maximum(0, (found - n[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9))


def counted(model: GramFilters, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """hits() of many texts, in blocks of about BLOCK characters; a longer text is counted piece by piece."""
    n, found = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages)), np.int64)
    group: list[int] = []
    arrays: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            starts = np.cumsum([0, *[len(a) for a in arrays[:-1]]])
            for i, (x, y) in enumerate(zip(*model.hits(np.concatenate(arrays), starts), strict=True)):
                n[group[i]] += x
                found[group[i]] += y
        group.clear()
        arrays.clear()
        size = 0

    for i, text in enumerate(texts):
        c = codes(text)
        if len(c) > BLOCK:
            # pieces overlap, so that each gram is whole in the piece where it begins
            for at in range(0, len(c), BLOCK):
                x, y = model.hits(c[at : at + BLOCK + max(ORDERS) - 1], np.zeros(1, np.int64), BLOCK)
                n[i] += x[0]
                found[i] += y[0]
            continue
        group.append(i)
        arrays.append(c)
        size += len(c)
        if size >= BLOCK:
            flush()
    flush()
    return n, found


def layout(languages: int) -> tuple[type, int]:
    """The type of a mask and the number of masks of a slot."""
    kind = np.uint8 if languages <= 8 else np.uint64
    return kind, max(1, -(-languages // (kind().itemsize * 8)))


def grams_of(text: str) -> np.ndarray:
    """The distinct n-grams of a text, as hashes; runs of blanks are none."""
    c, found = codes(text), [np.zeros(0, np.uint64)]
    for at in range(0, len(c), BLOCK):
        part = c[at : at + BLOCK + max(ORDERS) - 1]
        blank = part == 32
        for n in ORDERS:
            if len(part) >= n:
                found.append(np.unique(gram_hashes(part, n)[~(blank[: len(part) - n + 1] & blank[1 : len(part) - n + 2])]))
    return np.unique(np.concatenate(found))


def sampled(docs: DataFrame, train: Column) -> tuple[list[str], DataFrame]:
    """The languages of the rows of docs (doc_id, text, lang) where train holds, and their samples (lang, text)."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.length("text").alias("chars"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # about twice the sample by hash, then exactly the smallest: what a task has to order doesn't grow with the corpus
    share = F.lit(1.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, (2 * SAMPLE + 100) / r["n"]))).otherwise(share)
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    near = rows.where(F.col("doc_id").isNotNull() & (uniform(F.col("doc_id")) < share)).groupBy("lang", "doc_id").agg(F.max("chars").alias("chars"))
    before = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")
    chosen = near.select("doc_id", "lang", F.row_number().over(order).alias("at"), before.alias("before"))
    chosen = chosen.where((F.col("at") <= SAMPLE) & (F.col("before") < SAMPLE_CHARS)).select("doc_id", "lang")
    # SAMPLE ids a language at most: that bounds the broadcast
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    return sorted(r["lang"] for r in counts), sample


def learn(docs: DataFrame, train: Column, log2: int = SLOTS_LOG2) -> GramFilters:
    """Filters from the rows of docs (doc_id, text, lang) where train holds."""
    languages, sample = sampled(docs, train)
    kind, masks = layout(len(languages))
    bits, number = kind().itemsize * 8, {x: k for k, x in enumerate(languages)}
    piece = min(PIECE, 1 << log2)

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, texts in batch.groupby("lang")["text"]:
                grams = np.unique(np.concatenate([grams_of(t) for t in texts]))
                at = np.unique(np.concatenate([slots(grams, i, log2) for i in range(HASHES)]))
                edge = np.flatnonzero(np.diff(at // piece, prepend=-1))
                out += [(number[lang], int(x[0] // piece), (x % piece).astype("<u2").tobytes()) for x in np.split(at, edge[1:]) if len(x)]
            yield pd.DataFrame(out, columns=["language", "piece", "slots"])

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((masks, piece), kind)
        for k, x in zip(rows["language"], rows["slots"], strict=True):
            held[int(k) // bits, np.frombuffer(x, "<u2")] |= kind(1 << (int(k) % bits))
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "held": [held.tobytes()]})

    pieces = sample.mapInPandas(set_bits, "language int, piece int, slots binary").groupBy("piece").applyInPandas(put_together, "piece int, held binary")
    table = np.zeros((masks, 1 << log2), kind)
    for r in pieces.collect():  # the table itself, whose size is fixed
        table[:, r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["held"], kind).reshape(masks, piece)
    return GramFilters.of(languages, table, log2)


def identifier(spark: SparkSession, model: GramFilters) -> Callable[[Column], Column]:
    """A column function of a text: struct of lang, score (share of the evidence) and cover (share of grams known)."""
    shipped = spark.sparkContext.broadcast(model)

    def verdicts(texts: pd.Series) -> pd.DataFrame:
        filters = shipped.value
        texts = [x if isinstance(x, str) else "" for x in texts]
        lang, score, cover = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        spoken = [i for i, x in enumerate(texts) if any(map(str.isalpha, x))]
        if spoken and filters.languages:
            n, found = counted(filters, [texts[i] for i in spoken])
            real = filters.corrected(n, found)
            best, total = real.argmax(axis=1), real.sum(axis=1)
            top = real[np.arange(len(spoken)), best]
            score[spoken] = np.clip(np.where(total > 0, top / np.maximum(total, 1e-9), 0), 0, 1)
            cover[spoken] = np.clip(top / np.maximum(n, 1), 0, 1)
            for i, b in zip(spoken, best, strict=True):
                lang[i] = filters.languages[b]
        return pd.DataFrame({"lang": lang, "score": score, "cover": cover})

    return F.pandas_udf(verdicts, "lang string, score double, cover double")


def held_in(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 3) != 1, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, held_in(F.col("doc_id")))
    return docs.select("doc_id", identifier(spark, model)(F.col("text")).alias("v")).select(
        "doc_id", (~held_in(F.col("doc_id"))).alias("held_out"), F.col("v.lang").alias("lang_pred"), "v.score", "v.cover"
    )
