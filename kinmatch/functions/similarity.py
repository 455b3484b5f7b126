"""String similarities of candidate pairs.

Built-in expressions cover everything but the alignment measures (indel ratios, partial ratio, Jaro-Winkler), which share one
Arrow UDF and so one crossing to Python; there a batch's distinct pairs are worked on together, a machine word of a text at a time. Values are
definition-equal to the usual ones; all are NULL unless both sides are non-empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import compact, tokens


def lcs(x: str, y: str) -> int:
    """Length of the longest common subsequence, a machine word (here: an integer of any size) at a time."""
    if len(x) > len(y):
        x, y = y, x
    full = (1 << len(x)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | (1 << i)
    v = full
    for c in y:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def ratio(x: str, y: str) -> float:
    return 2 * lcs(x, y) / (len(x) + len(y)) if x or y else 1.0


def token_sort_ratio(x: str, y: str) -> float:
    return ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split())))


def token_set_ratio(x: str, y: str) -> float:
    a, b = set(x.split()), set(y.split())
    both = a & b
    if both and (a <= b or b <= a):
        return 1.0
    only_a, only_b = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    shared = sum(map(len, both)) + max(0, len(both) - 1)
    gap = 1 if both else 0
    len_a, len_b = shared + gap + len(only_a), shared + gap + len(only_b)
    distance = len(only_a) + len(only_b) - 2 * lcs(only_a, only_b)
    best = 1 - distance / (len_a + len_b) if len_a + len_b else 0.0
    if both:
        best = max(best, 2 * shared / (shared + len_a), 2 * shared / (shared + len_b))
    return best


def _best_window(short: str, long: str) -> float:
    n, chars, best = len(short), set(short), 0.0
    for end in range(1, len(long) + n):
        start = max(0, end - n)
        window = long[start : min(end, len(long))]
        # a window that gains no usable character is no better than its neighbour
        if (end <= len(long) and window[-1] not in chars) or (end > len(long) and window[0] not in chars):
            continue
        if 2 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


def partial_ratio(x: str, y: str) -> float:
    """The best ratio of the shorter text with a window of the longer, windows cut off at the ends included."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if short in long:
        return 1.0
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(x) == len(y) else best


def jaro_winkler(x: str, y: str) -> float:
    if x == y:
        return 1.0
    reach = max(0, max(len(x), len(y)) // 2 - 1)
    taken, mine = [False] * len(y), []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not taken[j] and y[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(a != b for a, b in zip(mine, (c for c, t in zip(y, taken, strict=True) if t), strict=True)) // 2
    score = (m / len(x) + m / len(y) + (m - swaps) / m) / 3
    prefix = 0
    for a, b in zip(x[:4], y[:4], strict=False):
        if a != b:
            break
        prefix += 1
    return score + prefix * 0.1 * (1 - score) if score > 0.7 else score


#: Texts up to this length fit a machine word; pairs are worked on in blocks of about BLOCK places.
WORD = 64
BLOCK = 1 << 18


class Texts:
    """Distinct texts as code points, of which rows() gives any as rows of one width."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer("".join([*texts, " "]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)

    def rows(self, i: np.ndarray, fill: int) -> np.ndarray:
        n, place = self.n[i], np.arange(int(self.n[i].max(initial=0)))
        out = self.flat[np.minimum(self.start[i][:, None] + place, len(self.flat) - 1)]
        out[place >= n[:, None]] = fill
        return out


def _matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row and place of y, a word with a bit for each place of x that has the same code point."""
    out = np.zeros(y.shape, np.uint64)
    for i in range(x.shape[1]):
        out |= (x[:, i : i + 1] == y).astype(np.uint64) << np.uint64(i)
    return out


def _step(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    u = v & at
    return (v + u) | (v - u)


def _unset(v: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How many of the low `bits` (1 to 64) of each word are not set: the length of the common subsequence so far."""
    low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(WORD) - bits.astype(np.uint64))
    return bits - np.bitwise_count(v & low).astype(np.int64)


def _blocks(places: np.ndarray) -> Iterator[np.ndarray]:
    """Indices in blocks of rows of about equal length."""
    order, lo = np.argsort(places, kind="stable"), 0
    held = np.maximum(1, places[order])
    while lo < len(held):
        last = min(len(held), lo + max(1, BLOCK // int(held[lo]))) - 1
        hi = min(last + 1, lo + max(1, BLOCK // int(held[last])))
        yield order[lo:hi]
        lo = hi


def _common(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    v = np.full(len(x), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(y.shape[1]):
        v = _step(v, at[:, j])
    return _unset(v, n)


def _windows(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The best ratio of x with a window of y. The windows from all places grow together, by one place a step."""
    places = np.arange(y.shape[1])
    v, best = np.full(y.shape, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(x))
    for t in range(x.shape[1]):
        ahead = np.zeros_like(at)
        ahead[:, : y.shape[1] - t] = at[:, t:]
        ahead[n <= t] = 0  # a window is no longer than the shorter text
        v = _step(v, ahead)
        size = np.minimum(t + 1, n)  # of the window at the start, which may be cut off there
        best = np.maximum(best, 2 * _unset(v[:, 0], n) / (n + size))
    size = np.minimum(n[:, None], m[:, None] - places)  # cut off at the end
    found = np.where(size > 0, 2 * _unset(v, n[:, None]) / (n[:, None] + np.maximum(size, 1)), 0.0)
    return np.maximum(best, found.max(axis=1))


def _partial(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    out, same = _windows(x, n, y, m, at), np.flatnonzero(n == m)
    if len(same):
        wide = int(n[same].max())
        x, y = x[same, :wide], y[same, :wide]
        out[same] = np.maximum(out[same], _windows(y, n[same], x, m[same], _matches(y, x)))
    return out


class Pairs:
    """Pairs of texts by their places i and j among distinct texts."""

    def __init__(self, texts: list[str], i: np.ndarray, j: np.ndarray):
        self.texts, self.i, self.j = Texts(texts), i, j
        self.n, self.m = self.texts.n[i], self.texts.n[j]

    @classmethod
    def of(cls, xs: list[str], ys: list[str]) -> Pairs:
        place = {t: k for k, t in enumerate({t: None for t in [*xs, *ys]})}
        return cls(list(place), *(np.fromiter((place[t] for t in side), np.int64, len(side)) for side in (xs, ys)))

    def mapped(self, f: Callable[[str], str]) -> Pairs:
        made = [f(t) for t in self.texts.texts]
        place = {t: k for k, t in enumerate(dict.fromkeys(made))}
        to = np.fromiter((place[t] for t in made), np.int64, len(made))
        return Pairs(list(place), to[self.i], to[self.j])

    def by_word(self, *measures: tuple[Callable, Callable[[str, str], float]]) -> list[np.ndarray]:
        """Each measure by its function of (shorter, longer) texts in blocks; pairs whose shorter text is empty or longer than a word go to the
        plain one, one by one."""
        swap = self.n > self.m
        short, long = np.where(swap, self.j, self.i), np.where(swap, self.i, self.j)
        n, m = self.texts.n[short], self.texts.n[long]
        out = [np.zeros(len(n)) for _ in measures]
        fits = (n > 0) & (n <= WORD)
        fit = np.flatnonzero(fits)
        for block in _blocks(m[fit]):
            rows = fit[block]
            x, y = self.texts.rows(short[rows], -1), self.texts.rows(long[rows], -2)
            at = _matches(x, y)
            for (f, _), held in zip(measures, out, strict=True):
                held[rows] = f(x, n[rows], y, m[rows], at)
        for k in np.flatnonzero(~fits).tolist():
            for (_, plain), held in zip(measures, out, strict=True):
                held[k] = plain(self.texts.texts[short[k]], self.texts.texts[long[k]])
        return out

    def ratio_of(self, common: np.ndarray) -> np.ndarray:
        both = self.n + self.m
        return np.where(both > 0, 2 * common / np.maximum(both, 1), 1.0)

    def token_set(self, sorted_common: np.ndarray | None = None) -> np.ndarray:
        """token_set_ratio(). The common subsequences of what only one side has are found together; sorted_common has them for pairs without a
        common or repeated word, as those of the sorted texts."""
        words = [t.split() for t in self.texts.texts]
        sets = [set(w) for w in words]
        once = np.array([len(w) == len(s) for w, s in zip(words, sets, strict=True)], bool)
        i, j = self.i.tolist(), self.j.tolist()
        apart = np.array([sets[a].isdisjoint(sets[b]) for a, b in zip(i, j, strict=True)], bool) & once[self.i] & once[self.j]
        tidy = np.fromiter((sum(map(len, s)) + max(0, len(s) - 1) for s in sets), np.int64, len(sets))
        na, nb, common = tidy[self.i], tidy[self.j], np.zeros(len(i))
        shared, both = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        if sorted_common is None:
            apart[:] = False
        common[apart] = sorted_common[apart] if sorted_common is not None else 0
        rest = np.flatnonzero(~apart)
        only_a, only_b = [], []
        for k in rest.tolist():
            a, b = sets[i[k]], sets[j[k]]
            same = a & b
            only_a.append(" ".join(sorted(a - same)))
            only_b.append(" ".join(sorted(b - same)))
            both[k], shared[k] = bool(same), sum(map(len, same)) + max(0, len(same) - 1)
        if len(rest):
            left = Pairs.of(only_a, only_b)
            na[rest], nb[rest], common[rest] = left.n, left.m, left.by_word((_common, lcs))[0]
        gap = both.astype(np.int64)
        la, lb = shared + gap + na, shared + gap + nb
        best = np.where(la + lb > 0, 1 - (na + nb - 2 * common) / np.maximum(la + lb, 1), 0.0)
        some = np.maximum(best, 2 * shared / np.maximum(shared + np.minimum(la, lb), 1))
        return np.where(both, np.where((na == 0) | (nb == 0), 1.0, some), best)

    def four_ratios(self) -> list[np.ndarray]:
        """Ratio, token sort, token set and partial ratio."""
        common, partial = self.by_word((_common, lcs), (_partial, partial_ratio))
        tidy = self.mapped(lambda t: " ".join(sorted(t.split())))
        sorted_common = tidy.by_word((_common, lcs))[0]
        return [self.ratio_of(common), tidy.ratio_of(sorted_common), self.token_set(sorted_common), partial]

    def jaro_winkler(self) -> np.ndarray:
        """jaro_winkler(): each place of x takes the first free place of y within reach, in all pairs at once. Pairs with an empty text or one
        longer than a word are worked on one by one."""
        out, one = np.zeros(len(self.n)), np.uint64(1)
        fits = (self.n > 0) & (self.n <= WORD) & (self.m > 0) & (self.m <= WORD)
        fit = np.flatnonzero(fits)
        for block in _blocks(np.maximum(self.n, self.m)[fit]):
            rows = fit[block]
            x, y, n, m = self.texts.rows(self.i[rows], -1), self.texts.rows(self.j[rows], -2), self.n[rows], self.m[rows]
            at, reach = _matches(y, x), np.maximum(0, np.maximum(n, m) // 2 - 1)
            taken, mine = np.zeros(len(rows), np.uint64), np.zeros(x.shape, bool)
            for i in range(x.shape[1]):
                low, high = np.minimum(np.maximum(0, i - reach), WORD - 1).astype(np.uint64), np.minimum(i + reach + 1, WORD).astype(np.uint64)
                inside = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(WORD) - high)) & (np.uint64(0xFFFFFFFFFFFFFFFF) << low)
                free = at[:, i] & inside & ~taken
                bit = free & (~free + one)
                taken |= bit
                mine[:, i] = bit != 0
            theirs = (taken[:, None] >> np.arange(y.shape[1], dtype=np.uint64)) & one != 0
            found = mine.sum(axis=1)
            swaps = np.bincount(np.nonzero(mine)[0], x[mine] != y[theirs], len(rows)).astype(np.int64) // 2
            score = (found / n + found / m + (found - swaps) / np.maximum(found, 1)) / 3
            k = min(4, x.shape[1], y.shape[1])
            prefix = np.cumprod(x[:, :k] == y[:, :k], axis=1).sum(axis=1)
            score = np.where(score > 0.7, score + prefix * 0.1 * (1 - score), score)
            out[rows] = np.where(found == 0, 0.0, np.where(self.i[rows] == self.j[rows], 1.0, score))
        for k in np.flatnonzero(~fits).tolist():
            out[k] = jaro_winkler(self.texts.texts[self.i[k]], self.texts.texts[self.j[k]])
        return out


def lcs_many(xs: list[str], ys: list[str]) -> np.ndarray:
    """lcs() of many pairs."""
    return Pairs.of(xs, ys).by_word((_common, lcs))[0]


def ratio_many(xs: list[str], ys: list[str]) -> np.ndarray:
    pairs = Pairs.of(xs, ys)
    return pairs.ratio_of(pairs.by_word((_common, lcs))[0])


def token_set_many(xs: list[str], ys: list[str]) -> np.ndarray:
    """token_set_ratio() of many pairs."""
    return Pairs.of(xs, ys).token_set()


def partial_many(xs: list[str], ys: list[str]) -> np.ndarray:
    """partial_ratio() of many pairs."""
    return Pairs.of(xs, ys).by_word((_partial, partial_ratio))[0]


def jaro_winkler_many(xs: list[str], ys: list[str]) -> np.ndarray:
    """jaro_winkler() of many pairs."""
    return Pairs.of(xs, ys).jaro_winkler()


ALIGNED = ("n_ratio", "n_tsort", "n_tset", "n_partial", "n_jw", "nfull_tset", "a_ratio", "a_tsort", "a_tset", "a_partial")


def _distinct(x: pd.Series, y: pd.Series, measures: Callable[[Pairs], list[np.ndarray]], width: int) -> np.ndarray:
    """`measures` of the batch's distinct pairs; missing where a side is empty."""
    places, texts = pd.factorize(pd.concat([x, y], ignore_index=True))
    i, j = places[: len(x)], places[len(x) :]
    empty = np.array([t == "" for t in texts], bool)
    some = np.flatnonzero((i >= 0) & (j >= 0))
    some = some[~empty[i[some]] & ~empty[j[some]]]
    out = np.full((len(x), width), np.nan)
    if len(some):
        keys, which = np.unique(i[some] * len(texts) + j[some], return_inverse=True)
        out[some] = np.column_stack(measures(Pairs(list(texts), *np.divmod(keys, len(texts)))))[which]
    return out


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ALIGNED]))
def aligned(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
    """name_core, name_norm and addr_core of both sides."""
    names = _distinct(x, y, lambda t: [*t.four_ratios(), t.jaro_winkler()], 5)
    parts = [names, _distinct(nx, ny, lambda t: [t.token_set()], 1), _distinct(p, q, Pairs.four_ratios, 4)]
    out = pd.DataFrame(np.hstack(parts), columns=list(ALIGNED)).astype(object)
    return out.where(out.notna(), None)


def jaccard(x: Column, y: Column) -> Column:
    """Missing, not 0, if either set is empty."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def levenshtein_similarity(x: Column, y: Column) -> Column:
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))


def length_ratio(x: Column, y: Column) -> Column:
    return F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))


def flag(condition: Column) -> Column:
    return condition.cast("double")


def native_features(a: str = "a", b: str = "b") -> dict[str, Column]:
    """The features that need no UDF, of records in struct columns a and b."""
    f = lambda side, name: F.col(f"{side}.{name}")
    x, y, p, q = f(a, "name_core"), f(b, "name_core"), f(a, "addr_core"), f(b, "addr_core")
    names, addresses = (x != "") & (y != ""), (p != "") & (q != "")
    xc, yc = compact(x), compact(y)
    initials = ((F.length(xc) >= 2) & (f(b, "name_acr") == xc)) | ((F.length(yc) >= 2) & (f(a, "name_acr") == yc))
    posts = (F.size(f(a, "postal")) > 0) & (F.size(f(b, "postal")) > 0)
    return {
        "n_lev": F.when(names, levenshtein_similarity(x, y)),
        "n_len_ratio": F.when(names, length_ratio(x, y)),
        "n_tok_jacc": F.when(names, jaccard(tokens(x), tokens(y))),
        "n_first_tok": F.when(names, flag(F.get(F.split(x, " "), 0) == F.get(F.split(y, " "), 0))),
        "n_compact_eq": F.when(names, flag(xc == yc)),
        "n_acr": F.when(names, flag(initials)),
        "n_len_a": F.length(x).cast("double"),
        "n_len_b": F.length(y).cast("double"),
        "a_tok_jacc": F.when(addresses, jaccard(tokens(p), tokens(q))),
        "a_len_ratio": F.when(addresses, length_ratio(p, q)),
        "a_missing": flag(~addresses),
        "pc_both": flag(posts),
        "pc_eq": F.when(posts, flag(F.arrays_overlap(f(a, "postal"), f(b, "postal")))),
        "num_jacc": jaccard(f(a, "nums"), f(b, "nums")),
        "num_common": F.size(F.array_intersect(f(a, "nums"), f(b, "nums"))).cast("double"),
    }
