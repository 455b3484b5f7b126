"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document is tokenised whole and closed with one id. It is cut where every PIECE ids end; pieces of the full window stand alone,
smaller ones are packed. Pieces are dealt to blocks of about BLOCK_TOKENS tokens. In a block, each piece starts as a partition of the block's
windows with one filled; the two partitions with the largest differences are merged again and again, the fullest window of one with the
emptiest of the other, until one is left. If one of its windows exceeds the capacity, the block is solved again with one window more.

Only piece lengths move between machines; ids are made once, where the text is read, and a piece keeps their checksum.

Ids are those of `tokenizers` at its defaults: the added tokens of the vocabulary are matched inside texts and give their own ids.

Defined cases: null and empty texts are the closing id alone. Repeated rows are packed as often as they occur; null ids are ids. An
empty table gives an empty result. Further columns are ignored. A very long text makes many full windows and one remainder.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, with_text_ids

CAPACITY = 2048
CLOSE = 1
#: Remainders of documents are cut at multiples of this, so that a window gets several pieces and differences can cancel.
PIECE = 256
BLOCK_TOKENS = 2_000_000
TOKENIZER = "byte_bpe_50k.json"
#: The byte-level alphabet of this family of vocabularies keeps these ranges of bytes and moves the rest above 255.
KEPT_BYTES = ((33, 126), (161, 172), (174, 255))
#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE of the vocabulary in `path` with its added tokens, run by tiktoken: the same ids, several times faster."""
    import tiktoken

    kept = [b for low, high in KEPT_BYTES for b in range(low, high + 1)]
    moved = [b for b in range(256) if b not in kept]
    byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    added = {x["content"]: x["id"] for x in held["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in held["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take blanks or whole words only are not supported")
    vocab = held["model"]["vocab"]
    ranks = {bytes(byte[x] for x in word): i for word, i in vocab.items() if all(x in byte for x in word) and i < 50_256}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=4)
def reference(path: str, added: bool):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added
    return whole


def ids_of(text: str | None, path: str, added: bool = False) -> np.ndarray:
    """The ids of a text and the closing one. With `added`, added tokens inside the text give their own ids; else they are read as text."""
    if not text:
        ids = np.zeros(0, np.uint32)
    else:
        try:
            ids = encoder(path).encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=())
        except ValueError:  # tiktoken's pattern gives up on runs of about a million bytes of white space
            ids = np.array(reference(path, added).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids, np.uint32(CLOSE)).astype("<u4")


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full windows first, then pieces."""
    full = n // capacity * capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(piece, n - s)) for s in range(full, n, piece)]


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Splits the items into k groups with near-equal sums, by differencing; returns the items of each."""
    # A partition: descending sums less their least, and for each a tree of items. Heap: largest spread first.
    heap: list[tuple[int, int, list[int], list]] = []
    for i, size in enumerate(sizes):
        heapq.heappush(heap, (-size, i, [size], [i]))  # the k - 1 empty windows are not written out
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        if len(a) + len(b) <= k:  # all of one partition fits beside the other: the empty windows of each take the other's
            sums, trees = a + b, ta + tb
        else:
            pad = k - len(a)
            sums, trees = a + [0] * pad, ta + [None] * pad
            for j, (size, tree) in enumerate(zip(b, tb, strict=True), 1):
                sums[k - j] += size
                trees[k - j] = tree if trees[k - j] is None else (trees[k - j], tree)
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        low = sums[order[-1]] if len(sums) == k else 0
        sums = [sums[x] - low for x in order]
        trees = [trees[x] for x in order]
        while sums and sums[-1] == 0 and trees[-1] is None:
            sums.pop(), trees.pop()
        heapq.heappush(heap, (-sums[0] if sums else 0, serial, sums, trees))
        serial += 1
    groups: list[list[int]] = []
    for tree in heap[0][3] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                items.append(x)
        groups.append(items)
    return groups


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity` tokens: differencing with the least count, one more each time it is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = karmarkar_karp(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text): one row per piece. `salt` spreads repeated rows over blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = ids_of(text if isinstance(text, str) else None, path, added=True)
                serial += 1
                for start, length in cuts(len(ids)):
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), serial))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return with_text_ids(docs).mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    made = cut(pieces(docs, path or default_path()), "pieces")
    total = made.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    blocks = max(1, total // BLOCK_TOKENS)
    block = F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(blocks)).alias("block")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # a fixed order, so that a lost task's second run gives the same windows
        rows = rows.assign(_id=rows["doc_id"].fillna("")).sort_values(["_id", "start", "ids_crc32", "salt"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        small = [i for i, n in enumerate(sizes) if n < CAPACITY]
        groups = [[i] for i, n in enumerate(sizes) if n >= CAPACITY] + [[small[j] for j in g] for g in pack_block([sizes[i] for i in small])] if sizes else []
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for s, group in enumerate(groups):
            at = 0
            for i in sorted(group):
                sequence[i], offset[i] = s, at
                at += sizes[i]
        return rows.assign(sequence_id=rows["block"].astype(np.int64) * (1 << 32) + sequence, offset=offset)[out]

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = made.withColumn("block", block).groupBy("block").applyInPandas(
        run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op3_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
