"""Removal of repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

A byte goes if it is covered by a 400-byte string that also starts anywhere else. Beside that, passages are reported: runs of 50 words
that also start anywhere else, whatever their length in bytes; nothing is removed for them. Both are found in one way, over two kinds
of units (bytes, words). One transform of a whole corpus can't be held by a machine, so windows that could be equal are first brought
together, exactly:

1. Every window is assigned to one anchor: its rightmost gram (32 bytes, 8 words) with the smallest hash. This depends on the window's
   units alone, so equal windows have equal anchors at the same distance. Neighbouring windows with one anchor form a region, about
   one in 185 bytes or 22 words. Regions whose anchor occurs once are done: nothing equals their windows.
2. Equal regions count as one class, a string with a multiplicity. All windows of a class that occurs twice repeat: each is an interval
   of two suffixes. An anchor with one class alone is done with that.
3. Otherwise the classes' units go to buckets by anchor. A window lies around the anchor, so two classes can share one only if they agree
   on one of a few stretches around it; classes that agree with none on any are left out. In a bucket the transform of the others'
   concatenation is built, and from the interval of the empty string intervals are extended backwards, breadth first: the step from
   strings of length l finds exactly the places where neighbouring suffixes share l units. It stops at the window's length; places that
   were not reached then have longer common prefixes, and the windows beside them repeat.
4. An anchor whose classes have more than LARGEST bytes can't be given to one task. Its windows are compared one by one, by their hash, so
   that no group of them grows with the data.

Defined cases: null text is empty; texts shorter than a window lose nothing, and neither do empty ones. Repeated rows are repeats of each
other. An empty table gives an empty result. Further columns are ignored. Long texts are cut into overlapping blocks for hashing and stay
whole for the result. Regions and windows are told apart by 64-bit hashes next to the anchor's, words by 64-bit hashes; null ids are ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, release

LENGTH = 400
PASSAGE = 50
BUCKET = 1_500_000
LARGEST = 12_000_000
BLOCK = 1 << 20
#: Stretches around an anchor that two classes may agree on.
STRETCHES = 8
#: Bits of a position in a block; the hash has the others.
AT = np.uint64(24)
UNSET = -2

_C = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


@dataclass(frozen=True)
class Units:
    """What a window is made of: `length` units of `width` bytes, with grams of `gram` (a power of two) of them."""

    kind: int
    length: int
    gram: int
    width: int

    def of(self, text: bytes) -> np.ndarray:
        return words(np.frombuffer(text, np.uint8)) if self.width > 1 else np.frombuffer(text, np.uint8)

    def read(self, part: bytes) -> np.ndarray:
        return np.frombuffer(part, "<u8" if self.width > 1 else np.uint8)


def kinds(length: int = LENGTH, passage: int = PASSAGE) -> tuple[Units, Units]:
    return Units(0, length, 32, 1), Units(1, passage, 8, 8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _powers[:] = made
    return _powers


def _blank(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def words(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, whole texts in blocks that end between words."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(b):
        end = len(b)
        if end - at > BLOCK:
            for low in range(at + BLOCK, len(b), BLOCK):
                gap = np.flatnonzero(_blank(b[low : low + BLOCK]))
                if len(gap):
                    end = low + int(gap[0])
                    break
        part = b[at:end]
        held = np.r_[False, ~_blank(part), False]
        edge = np.flatnonzero(held[1:] != held[:-1])
        first, past = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            power, inverse = _power_tables(len(part) + 1)
            prefix = np.r_[np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], dtype=np.uint64)]
            out.append(_mix((prefix[past] - prefix[first]) * inverse[first] + (past - first).astype(np.uint64) * _C))
        at = end
    return np.concatenate(out)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` units at each place, by doubling."""
    with np.errstate(over="ignore"):
        h = _mix(b.astype(np.uint64) + np.uint64(1))
        width = 1
        while width < gram:
            h = h[:-width] * (_C + np.uint64(2 * width)) + h[width:]
            width *= 2
        return _mix(h ^ np.uint64(gram))


def window_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span, out = 1, key
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(key) - width + 1], out[width - span :])


def window_hashes(h: np.ndarray, first: np.ndarray, grams: np.ndarray | int) -> np.ndarray:
    """Of gram hashes h: a hash of the `grams` of them from each place `first` on."""
    power, inverse = _power_tables(len(h) + 1)
    prefix = np.r_[np.uint64(0), np.cumsum(h * power[: len(h)], dtype=np.uint64)]
    return (prefix[first + grams] - prefix[first]) * inverse[first]


def regions(b: np.ndarray, length: int = LENGTH, gram: int = 32) -> tuple[np.ndarray, ...]:
    """Of a text's units: start, number of windows, anchor hash and region hash of each region."""
    out = []
    with np.errstate(over="ignore"):
        for at in range(0, len(b) - length + 1, BLOCK):
            part = b[at : at + BLOCK + length - 1]
            h = gram_hashes(part, gram)
            mask = (np.uint64(1) << AT) - np.uint64(1)
            key = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
            anchor = (mask - (window_least(key, length - gram + 1) & mask)).astype(np.int64)
            low = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            starts = np.diff(np.r_[low, len(anchor)])
            body = window_hashes(h, low, starts + length - gram)
            place = (anchor[low] - low).astype(np.uint64) * np.uint64(1 << 20) + starts.astype(np.uint64)
            out.append((low + at, starts, h[anchor[low]].view(np.int64), _mix(body ^ _mix(place)).view(np.int64)))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 4


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of t sorted by their first `depth` symbols at least, by doubling the sorted depth.

    Where two ranks and a position fit in 64 bits, values are sorted that hold their position; that is several times faster than
    sorting positions by value.
    """
    n = len(t)
    symbols, code = np.unique(t, return_inverse=True)
    bits, width = int(n).bit_length(), max(1, (len(symbols) - 1).bit_length())
    packed = 3 * bits <= 64
    h = max(1, min(2 * bits if packed else 63, 63) // width)
    place = np.arange(n, dtype=np.uint64)
    code = code.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = (key << np.uint64(width)) | np.roll(code, -(j % n))
    while True:
        if packed:
            held = np.sort((key << np.uint64(bits)) | place)
            order = (held & np.uint64((1 << bits) - 1)).astype(np.int64)
            held >>= np.uint64(bits)
        else:
            order = np.argsort(key)
            held = key[order]
        new = np.empty(n, bool)
        new[0] = False
        np.not_equal(held[1:], held[:-1], out=new[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        if h >= depth or np.count_nonzero(new) == n - 1:
            return order
        key = (rank << np.uint64(bits)) | np.roll(rank, -(h % n))
        h *= 2


def unreached(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix order, whether its suffix shares `length` symbols or more with the one before it.

    Breadth-first backward extension: an interval of suffixes that begin with w, |w| = l, and a symbol c that precedes some of them give
    the interval of cw. If the common prefix at that interval's end is still unknown, it is l, and the interval is extended in turn.
    Strings that run over a separator (symbol 0) are not extended.
    """
    n = len(t)
    bits = int(n).bit_length()
    bwt = t[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    first = bwt[by_symbol]
    common = np.full(n + 1, UNSET, np.int32)
    common[0] = common[n] = -1
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for l in range(length):  # noqa: E741
        if not len(low):
            break
        sizes = high - low + 1
        wide = sizes > 1
        # an interval of one suffix has one symbol before it
        begin = end = step[low[~wide]]
        if wide.any():
            low, sizes = low[wide], sizes[wide]
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(low)), sizes)
            key = (owner << bits) | step[np.arange(ends[-1]) + np.repeat(low - ends + sizes, sizes)]
            key.sort()
            owner, to = key >> bits, key & ((1 << bits) - 1)
            symbol = first[to]
            edge = np.flatnonzero((owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))
            begin, end = np.concatenate([begin, to[:1], to[edge + 1]]), np.concatenate([end, to[edge], to[-1:]])
        new = common[end + 1] == UNSET
        if l:
            new &= first[begin] != 0
        low, high = begin[new], end[new]
        common[high + 1] = l
    return common[:n] == UNSET


def repeated(parts: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each part (an array of units), whether the window at each of its places also starts elsewhere in the parts."""
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if flat.dtype != np.uint8:  # words get dense numbers
        flat = np.unique(flat, return_inverse=True)[1].astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    t = np.zeros(len(flat) + len(parts) + 1, np.uint16 if flat.dtype == np.uint8 else np.uint32)
    t[1 + np.arange(len(flat)) + np.repeat(np.arange(len(parts)), [len(p) for p in parts])] = flat.astype(t.dtype) + t.dtype.type(1)
    order = suffix_order(t, length)
    same = unreached(t, order, length)
    flag = np.zeros(len(t), bool)
    flag[order] = same | np.r_[same[1:], False]
    starts = ends + np.arange(1, len(parts) + 1) - [len(p) for p in parts]
    return [flag[at : at + max(0, len(p) - length + 1)] for at, p in zip(starts, parts, strict=True)]


def meeting(anchors: np.ndarray, parts: list[np.ndarray], units: Units) -> np.ndarray:
    """Which parts (classes of anchors) may share a window with another of their anchor.

    A window with d units before the anchor has length - gram - d after it. For d in a range of `step`, classes that share one agree on
    the least number before and the least after, so one hash for each range tells them.
    """
    around = units.length - units.gram
    step = max(1, around // STRETCHES)
    gap = np.zeros(units.gram, parts[0].dtype)
    h = gram_hashes(np.concatenate([x for p in parts for x in (p, gap)]), units.gram).view(np.int64)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + units.gram)
    starts = ends - sizes - units.gram
    owner = np.repeat(np.arange(len(parts)), sizes + units.gram)[: len(h)]
    hit = np.flatnonzero(h == anchors[owner])
    hit = hit[hit + units.gram <= (starts + sizes)[owner[hit]]]
    at = np.zeros(len(parts), np.int64)
    at[owner[hit]] = hit - starts[owner[hit]]  # the last occurrence: a later one would have been the anchor
    seen: dict[tuple, int] = {}
    keep = np.zeros(len(parts), bool)
    for i, (part, anchor, a) in enumerate(zip(parts, anchors.tolist(), at.tolist(), strict=True)):
        for before in range(0, around + 1, step):
            past = a + units.gram + max(0, around - before - step + 1)
            if before <= a and past <= len(part):
                other = seen.setdefault((anchor, before, xxhash.xxh3_64_intdigest(part[a - before : past].tobytes())), i)
                if other != i:
                    keep[i] = keep[other] = True
    return keep


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and `row`, which is the same for equal rows only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row"))


def all_regions(rows: DataFrame, over: tuple[Units, ...]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                b = text.encode("utf-8", "surrogatepass")
                for units in over:
                    u = units.of(b)
                    if len(u) >= units.length:
                        low, starts, anchor, region = regions(u, units.length, units.gram)
                        yield pd.DataFrame({"kind": units.kind, "row": row, "low": low, "starts": starts, "anchor": anchor, "region": region})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for x in run(batches):
            held.append(x)
            n += len(x)
            if n >= 20_000:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    least = min(2 * u.length if u.width > 1 else u.length for u in over)  # a word takes a byte and a blank at least
    long_enough = rows.where(F.octet_length("text") >= least - 1).select("row", "text")
    return long_enough.mapInPandas(joined, "kind byte, row long, low long, starts int, anchor long, region long")


def class_parts(rows: DataFrame, wanted: DataFrame, over: tuple[Units, ...]) -> DataFrame:
    """wanted (kind, row, low, starts, anchor, region): kind, anchor, region, part (the region's units)."""
    per = wanted.groupBy("row").agg(F.collect_list(F.struct("kind", "low", "starts", "anchor", "region")).alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()  # equal rows would only repeat a class
        for batch in batches:
            out = []
            for row, text, held in zip(batch["row"], batch["text"], batch["held"], strict=True):
                if row in done:
                    continue
                done.add(row)
                b = text.encode("utf-8", "surrogatepass")
                made = {u.kind: u.of(b) for u in over if any(x["kind"] == u.kind for x in held)}
                out += [
                    (x["kind"], x["anchor"], x["region"], made[x["kind"]][x["low"] : x["low"] + x["starts"] + over[x["kind"]].length - 1].tobytes()) for x in held
                ]
            yield pd.DataFrame(out, columns=["kind", "anchor", "region", "part"])

    # always by shuffle, so that a larger corpus runs as this one
    found = rows.join(per.hint("merge"), "row").select("row", "text", "held")
    return found.mapInPandas(run, "kind byte, anchor long, region long, part binary")


def by_transform(parts: DataFrame, buckets: dict[int, int], over: tuple[Units, ...]) -> DataFrame:
    """parts (kind, anchor, region, part): anchor, region, first, past: runs of windows that repeat. buckets: their number by kind."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates(["anchor", "region"])
        units = over[int(batch["kind"].iloc[0])]
        held = [units.read(x) for x in batch["part"]]
        keep = meeting(batch["anchor"].to_numpy(np.int64), held, units)
        batch, held = batch.loc[keep], [p for p, k in zip(held, keep, strict=True) if k]
        out = []
        for anchor, region, flags in zip(batch["anchor"], batch["region"], repeated(held, units.length) if held else [], strict=True):
            out += [(anchor, region, a, b) for a, b in runs(flags)]
        return pd.DataFrame(out, columns=["anchor", "region", "first", "past"])

    n = F.when(F.col("kind") == 0, F.lit(buckets[0])).otherwise(F.lit(buckets[1]))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("anchor"), n))
    return parts.groupBy("kind", "bucket").applyInPandas(run, "anchor long, region long, first long, past long")


def one_by_one(rows: DataFrame, hot: DataFrame, over: tuple[Units, ...]) -> DataFrame:
    """hot (kind, row, low, starts): kind, row, first, past for the windows of these regions that repeat, without grouping regions."""
    hot = hot.groupBy("kind", "row", "low", "starts").agg(F.count(F.lit(1)).alias("n"))
    per = hot.groupBy("row").agg(F.collect_list(F.struct("kind", "low", "starts", "n")).alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for batch in batches:
            for row, text, held in zip(batch["row"], batch["text"], batch["held"], strict=True):
                if row in done:
                    continue
                done.add(row)
                b = text.encode("utf-8", "surrogatepass")
                made = {u.kind: u.of(b) for u in over if any(x["kind"] == u.kind for x in held)}
                for x in held:
                    units = over[x["kind"]]
                    first = np.arange(x["starts"])
                    with np.errstate(over="ignore"):
                        h = gram_hashes(made[x["kind"]][x["low"] : x["low"] + x["starts"] + units.length - 1], units.gram)
                        wide = _mix(window_hashes(h, first, units.length - units.gram + 1))
                    gram = h[first].view(np.int64)
                    yield pd.DataFrame({"kind": units.kind, "row": row, "n": x["n"], "first": first + x["low"], "window": wide.view(np.int64), "gram": gram})

    windows = rows.join(per.hint("merge"), "row").select("row", "text", "held")
    windows = cut(windows.mapInPandas(run, "kind byte, row long, n long, first long, window long, gram long"), "windows")
    # a split join may give a row's windows twice, so places are told apart rather than counted
    place = F.struct("row", "first")
    twice = windows.groupBy("kind", "window", "gram").agg(F.max("n").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).where("n > 1 or a != b")
    return windows.join(twice.select("kind", "window", "gram"), ["kind", "window", "gram"]).select("kind", "row", "first", (F.col("first") + 1).alias("past"))


def repeated_runs(rows: DataFrame, over: tuple[Units, ...], bucket: int = BUCKET, largest: int = LARGEST) -> DataFrame:
    """rows from keyed(): (kind, row, first, past), runs of places whose window also starts elsewhere."""
    every = cut(all_regions(rows, over), "regions")
    # written first: an aggregate beside the join would keep Spark from splitting a hot anchor
    shared = cut(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    found = cut(every.join(shared.hint("merge"), "anchor"), "shared")
    release(every, shared)
    per_class = found.groupBy("kind", "anchor", "region").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "low", "starts")).alias("one"))
    classes = cut(per_class.select("kind", "anchor", "region", "n", "one.*"), "classes")
    size = F.when(F.col("kind") == 0, F.col("starts") + over[0].length).otherwise(8 * (F.col("starts") + over[1].length))
    anchors = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.sum(size).alias("bytes"))
    several = cut(classes.join(anchors.where("classes > 1"), "anchor"), "several")
    small = several.where(F.col("bytes") <= largest)
    total = {r["kind"]: r["n"] for r in small.groupBy("kind").agg(F.sum(size).alias("n")).collect()}
    whole = classes.where("n > 1").select("anchor", "region", F.lit(0).cast("long").alias("first"), F.col("starts").cast("long").alias("past"))
    buckets = {u.kind: max(1, total.get(u.kind, 0) // bucket) for u in over}
    flagged = cut(whole.union(by_transform(class_parts(rows, small, over), buckets, over)), "flagged")
    release(classes)  # before the texts are shuffled once more
    out = found.join(flagged, ["anchor", "region"]).select(
        "kind", "row", (F.col("low") + F.col("first")).alias("first"), (F.col("low") + F.col("past")).alias("past")
    )
    hot = several.where(F.col("bytes") > largest).select("anchor").distinct()
    if not hot.isEmpty():
        out = out.union(one_by_one(rows, found.join(hot, "anchor").select("kind", "row", "low", "starts"), over))
    return out


def covered(found: list, length: int) -> list[tuple[int, int]]:
    """The maximal runs of units covered by windows at the given runs of places."""
    out: list[list[int]] = []
    for first, past in sorted(found):
        end = past - 1 + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, bucket: int = BUCKET, largest: int = LARGEST) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, spans (of bytes that go), passages (of words, reported only), both array<struct<start, stop>>,
    and kept (binary: the bytes that stay). One window is enough for a span or a passage."""
    over = kinds(length, passage)
    rows = keyed(docs)
    # a set, as equal rows give equal runs
    spans = repeated_runs(rows, over, bucket, largest).groupBy("row").agg(F.collect_set(F.struct("kind", "first", "past")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, found in zip(batch["text"], batch["found"], strict=True):
                b = text.encode("utf-8", "surrogatepass")
                found = found if found is not None else []
                gone, said = (covered([(x["first"], x["past"]) for x in found if x["kind"] == u.kind], u.length) for u in over)
                at, kept = 0, []
                for start, stop in gone:
                    kept.append(b[at:start])
                    at = stop
                out.append((len(b), *([{"start": s, "stop": e} for s, e in x] for x in (gone, said)), b"".join([*kept, b[at:]])))
            made = pd.DataFrame(out, columns=["n_bytes", "spans", "passages", "kept"])
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield made

    # ids as text: pandas holds integers with nulls among them as floats
    held = rows.join(spans.hint("merge"), "row", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "found")
    span = "array<struct<start:bigint,stop:bigint>>"
    made = held.mapInPandas(run, f"doc_id string, n_bytes long, spans {span}, passages {span}, kept binary")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op9_bwt_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        total("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        total("passages").alias("n_passage_words"),
    )
