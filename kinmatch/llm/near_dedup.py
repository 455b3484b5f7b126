"""Near-duplicate detection by a chosen-path similarity join over sets of five-word shingles.

1. Each text becomes its set of shingle hashes. Rows with the same set form a class and go on as one.
2. A class has SIGNATURE minwise values. In each tree the root sends it, for every root position, to the node named by its value there.
3. The first round takes FIRST of the TREES * BRANCHES root paths and doesn't branch: nodes are cut into chunks of at most CHUNK classes by a
   hash that differs from node to node, and chunks are compared exhaustively. Copies of one text, however many, mostly become one component here:
   a chunk connects its members, and those members connect the chunks of the other path.
4. The second round takes the other paths. A node whose classes are all connected already is left out. One with more than SMALL classes outside
   its one large component branches on BRANCHES positions chosen by the node, down to DEPTH levels, or DEEPEST while it has more than LARGEST classes.
   Then every class outside the large component is compared with all of the node; that component is cut into chunks that each meet all
   the others. What is still larger than LARGEST at DEEPEST levels has all pairs of its chunks compared, so nothing is left out.
5. Comparing is in two steps. Signatures are compared exhaustively, and classes without a partner outside their component with an estimate of FLOOR
   or more leave. The standard error at 0.75 is 0.038, so a true link is lost here with a chance of about 7.5e-5. What is left meets in the
   same nodes with its full sets, where all intersections are counted and links are confirmed. A node returns a spanning forest of its links, not its pairs.

A pair with similarity s stays together at a branching with probability 1 - (1 - s)^BRANCHES. At s = 0.75 it is separated in all root paths, each
with all its levels, with a probability below 1e-6.

Defined cases: null and empty texts, and texts without words, have no shingles and are linked with nothing. With fewer than five words the whole
sequence is the one shingle. Equal sets are linked whatever their order or ids; repeated rows fall into one class. Rows with a null id link
and are linked like others; a null id never names a component that has another id, and has a null component_id in one that has none. One id with
several texts: each row is linked by its own text. An empty table gives an empty result. Further columns are carried by deduplicate() and ignored otherwise.
Very long texts are hashed in blocks. Shingles are told apart by 64-bit and sets by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, sized
from .components import components

SHINGLE = 5
PERCENT = 75
SIGNATURE = 128
TREES, BRANCHES, DEPTH, DEEPEST = 4, 3, 3, 6
#: Root paths of the first round, and its largest chunk.
FIRST, CHUNK = 2, 512
#: What a node may hold outside its large component and be compared exhaustively. Comparing a signature with 512 others takes less than
#: making, dealing and counting three children of it.
SMALL = 512
LARGEST = 2048
FLOOR = 0.6

_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
_A = np.random.default_rng(20_240_501).integers(1, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. bytes.lower and bytes.split know only ASCII letters and blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = min(SHINGLE, len(words))
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        s = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            s = s * _K + w[i : len(w) - n + 1 + i]
        return np.unique(_mix(s))


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise values of a non-empty set."""
    with np.errstate(over="ignore"):
        return np.minimum.reduce([(s[i : i + 4096, None] * _A).min(axis=0) for i in range(0, len(s), 4096)])


def short(values: np.ndarray) -> np.ndarray:
    """16 bits of each minwise value, for comparing."""
    with np.errstate(over="ignore"):
        return (_mix(values) >> np.uint64(48)).astype("<u2")


def key_of(s: np.ndarray) -> tuple[bytes, int]:
    digest = xxhash.xxh3_128_digest(s.astype("<u8").tobytes())
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def row_hash() -> Column:
    """Tells rows apart by id and text. A null id has one too, so that its text can be found again."""
    return F.xxhash64("doc_id", "text").alias("row")


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, key, digest, sig, roots of every row; without shingles the key is 0 and the last three are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = _mix(np.arange(1, TREES * BRANCHES + 1, dtype=np.uint64))
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text if isinstance(text, str) else None)
                if len(s):
                    values = signature(s)
                    digest, key = key_of(s)
                    roots = _mix(values[: len(salt)] ^ salt).view(np.int64)
                    rows.append((len(s), key, digest, short(values).tobytes(), roots))
                else:
                    rows.append((0, 0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "key", "digest", "sig", "roots"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "row", batch["row"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType
    held = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", row_hash())  # ids as in with_text_ids()
    rows = held.mapInPandas(run, "doc_id string, row long, n_shingles long, key long, digest binary, sig binary, roots array<long>")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def by_node(each: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Applies `each` to the rows of each node, from batches that are sorted by node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None and len(rest):
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            nodes = batch["node"].to_numpy()
            last = np.searchsorted(nodes, nodes[-1])  # the last node may go on in the next batch
            rest = batch.iloc[last:].reset_index(drop=True)
            yield from apply(batch.iloc[:last])
        if rest is not None:
            yield from apply(rest)

    def apply(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):  # a node may fill a whole batch
            return
        nodes = rows["node"].to_numpy()
        ends = np.r_[np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, len(nodes)]
        out = [x for a, b in zip([0, *ends[:-1]], ends, strict=True) if b - a > 1 and (x := each(rows.iloc[a:b])) is not None]
        if out:
            yield pd.concat(out, ignore_index=True)

    return run


def children(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """rows (node, key, label, big) of large nodes: for each BRANCHES rows with the child nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            node = batch["node"].to_numpy().view(np.uint64)
            sig = np.frombuffer(b"".join(batch["sig"]), "<u2").reshape(-1, SIGNATURE)
            # the node alone chooses its positions: a start and an odd step, so they differ
            first, step = _mix(node ^ _K), _mix(node + _K) | np.uint64(1)
            for b in range(BRANCHES):
                at = ((first + np.uint64(b) * step) % np.uint64(SIGNATURE)).astype(np.int64)
                value = sig[np.arange(len(sig)), at].astype(np.uint64)
                child = _mix(_mix(node + np.uint64(b + 1)) ^ (value + (at.astype(np.uint64) << np.uint64(16))))
                yield pd.DataFrame({"node": child.view(np.int64), "key": batch["key"], "label": batch["label"], "big": batch["big"]})

    return rows.join(sigs, "key").select("node", "key", "label", "big", "sig").mapInPandas(run, "node long, key long, label long, big boolean")


def chunk_of(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("key", "node"), chunks).cast("int")


def unbranched(rows: DataFrame) -> DataFrame:
    """rows (node, key, label) at the roots: the same with nodes cut into chunks of about CHUNK classes."""
    size = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    node = F.when(chunks > 1, F.xxhash64("node", chunk_of(chunks))).otherwise(F.col("node"))
    return rows.join(sized(size), "node").select(node.alias("node"), "key", "label")


def met(rows: DataFrame) -> DataFrame:
    """rows (node, key, label, size, most, main) of leaves: (node, key, label) so that each class outside the largest component meets all others."""
    few = F.col("size") - F.col("most") <= SMALL
    # few others: each chunk of the main component gets all of them; many: every pair of chunks
    chunks = F.ceil(F.when(few, F.col("most")).otherwise(F.col("size")) / LARGEST).cast("int")
    every = F.sequence(F.lit(0), chunks - 1)
    chunk = chunk_of(chunks)
    pair = lambda o: F.xxhash64("node", F.least(chunk, o), F.greatest(chunk, o))
    one = F.xxhash64("node", chunk)
    nodes = (
        F.when(chunks <= 1, F.array("node"))
        .when(few & (F.col("label") == F.col("main")), F.array(one))
        .when(few, F.transform(every, lambda o: F.xxhash64("node", o)))
        .otherwise(F.transform(every, pair))
    )
    return rows.select(F.explode(nodes).alias("node"), "key", "label")


def branched(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """rows (node, key, label, big) at the roots: (node, key, label) of all leaves that hold more than one component.

    Only a component that is big (more than SMALL classes in all), and the only one of these in a node, can leave SMALL classes or fewer
    outside it there, so one aggregate by node tells which nodes branch.
    """
    found = []
    of_big = F.when(F.col("big"), F.col("label"))
    for depth in range(1, DEEPEST + 1):
        several = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"),
            F.count(of_big).alias("most"), F.min(of_big).alias("main"), F.max(of_big).alias("other"),
        ).where("low != high")
        several = several.select("node", "size", F.when(F.col("main") == F.col("other"), F.col("most")).otherwise(F.lit(0)).alias("most"), "main")
        held = cut(rows.join(sized(cut(several, "sizes")), "node"), "nodes")
        found.append(held.where(F.col("size") <= SMALL).select("node", "key", "label"))
        large = held.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        due = F.col("size") - F.col("most") > SMALL  # to be branched
        due &= F.lit(depth < DEEPEST) & (F.lit(depth < DEPTH) | (F.col("size") > LARGEST))
        found.append(met(large.where(~due)))
        if depth < DEEPEST:
            rows = cut(children(large.where(due).select("node", "key", "label", "big"), sigs), "children")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near(sig: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of a node's signatures, which have another with a different label whose estimated similarity is FLOOR or more."""
    need = int(np.ceil(FLOOR * SIGNATURE))
    if len(sig) == 2:
        return np.full(2, label[0] != label[1] and int((sig[0] == sig[1]).sum()) >= need)
    hit = np.zeros(len(sig), bool)
    _, label, counts = np.unique(label, return_inverse=True, return_counts=True)
    others = np.flatnonzero(label != counts.argmax())  # each pair with two labels has one of these
    step = max(1, 4_000_000 // (len(sig) * SIGNATURE))
    for i in range(0, len(others), step):
        at = others[i : i + step]
        close = ((sig[at, None, :] == sig[None, :, :]).sum(axis=2) >= need) & (label[at, None] != label[None, :])
        hit[at] |= close.any(axis=1)
        hit |= close.any(axis=0)
    return hit


def active(found: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows (node, key, label) that have a partner of another component by estimate."""

    def each(rows: pd.DataFrame) -> pd.DataFrame | None:
        hit = near(np.frombuffer(b"".join(rows["sig"]), "<u2").reshape(-1, SIGNATURE), rows["label"].to_numpy())
        return rows.loc[hit, ["node", "key", "label"]] if hit.any() else None

    rows = found.join(sigs, "key").select("node", "key", "label", "sig").repartition("node").sortWithinPartitions("node")
    return rows.mapInPandas(by_node(each), "node long, key long, label long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a node's sets."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    df = np.diff(np.r_[start, len(flat)])
    for d in np.unique(df[df > 1]):
        at = start[df == d]
        if d <= 16:
            held = owner[at[:, None] + np.arange(d)]
            for i in range(d):
                for j in range(i + 1, d):
                    np.add.at(out, (held[:, i], held[:, j]), 1)
    out = np.maximum(out, out.T)
    wide = np.flatnonzero(df > 16)  # members of many sets: a product of zeros and ones
    for i in range(0, len(wide), 4096):
        part = wide[i : i + 4096]
        held = np.zeros((m, len(part)), np.float32)
        held[owner[np.arange(df[part].sum()) + np.repeat(start[part] - np.cumsum(df[part]) + df[part], df[part])], np.repeat(np.arange(len(part)), df[part])] = 1
        out += (held @ held.T).astype(np.int32)
    return out


def linked(labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between different labels of a node."""
    n = np.array([len(s) for s in sets])
    both = intersections(sets)
    link = (100 * both >= PERCENT * (n[:, None] + n[None, :] - both)) & (both > 0)
    link |= labels[:, None] == labels[None, :]
    out, left = [], np.ones(len(n), bool)
    while left.any():
        first = int(np.flatnonzero(left)[0])
        left[first] = False
        edge = np.array([first])
        while len(edge):
            reach = link[edge].any(axis=0) & left
            left[reach] = False
            edge = np.flatnonzero(reach)
            out.extend((int(labels[first]), int(x)) for x in np.unique(labels[edge]) if x != labels[first])
    return out


def full_sets(docs: DataFrame, reps: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, members): the full sets of the classes in keys, made again from one text of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shingle_set(t if isinstance(t, str) else None) for t in batch["text"]]
            held = [(key_of(s)[1], s.astype("<u8").tobytes()) for s in made if len(s)]
            yield pd.DataFrame(held, columns=["key", "members"])

    wanted = cut(reps.join(keys, "key", "left_semi").select("row"), "wanted")
    rows = docs.select("text", row_hash()).join(sized(wanted), "row", "left_semi")
    one = rows.groupBy("row").agg(F.first("text").alias("text"))  # repeated rows: one of them goes on
    return one.select("text").mapInPandas(run, "key long, members binary")


def confirm(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (node, key, label): links (u, v) between labels, confirmed on full sets."""

    def each(rows: pd.DataFrame) -> pd.DataFrame | None:
        label = rows["label"].to_numpy()
        if (label == label[0]).all():
            return None
        found = linked(label, [np.frombuffer(x, "<u8") for x in rows["members"]])
        return pd.DataFrame(found, columns=["u", "v"]) if found else None

    rows = rows.join(sets, "key").select("node", "label", "members")
    return rows.repartition("node").sortWithinPartitions("node").mapInPandas(by_node(each), "u long, v long")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, (key, label) of the classes with a link)."""
    rows = cut(sketch(docs), "sketch")
    reps = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("row"), F.first("key").alias("key"), F.first("sig").alias("sig"), F.first("roots").alias("roots"))
    reps = cut(reps, "classes")
    sigs = reps.select("key", "sig")
    roots = lambda named, low, high: named.select(F.explode(F.slice("roots", low + 1, high - low)).alias("node"), *[c for c in named.columns if c != "roots"])
    held = cut(active(unbranched(roots(reps.select("roots", "key", F.col("key").alias("label")), 0, FIRST)), sigs), "active")
    sets = cut(full_sets(docs, reps, held.select("key").distinct()), "sets")
    labels = components(confirm(held, sets)).select(F.col("id").alias("key"), F.col("component").alias("label"))
    labels = cut(labels, "labels")
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) > SMALL).alias("big"))
    named = reps.select("key", "roots").join(labels.join(sizes, "label"), "key", "left")
    named = named.select("roots", "key", F.coalesce("label", "key").alias("label"), F.coalesce("big", F.lit(False)).alias("big"))
    held = cut(active(branched(roots(named, FIRST, TREES * BRANCHES), sigs), sigs), "active")
    if not held.isEmpty():
        more = held.select("key").distinct().join(sets.select("key"), "key", "left_anti")
        sets = sets.union(cut(full_sets(docs, reps, more), "sets"))
        found = cut(components(confirm(held, sets)).select("id", F.col("component").alias("to")), "found")
        moved = labels.join(found, labels["label"] == found["id"], "left").select("key", F.coalesce("to", "label").alias("label"))
        fresh = found.join(labels, found["id"] == labels["key"], "left_anti").select(F.col("id").alias("key"), F.col("to").alias("label"))
        labels = cut(moved.union(fresh), "labels")
    return rows, labels


def linked_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, row, n_shingles, component_id, stays for every row. Of a component without ids, the rows with the least hash stay."""
    rows, labels = classes_of(docs)
    named = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("row").alias("first"))
    named = named.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    named = named.drop("first").join(least, "label").select("key", "component_id", "first")
    alone = F.col("n_shingles") == 0
    keyed = F.when(~alone, F.col("key")).alias("key")
    own = F.when(F.col("component_id").isNull(), F.col("row") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows.select("doc_id", "row", "n_shingles", keyed).join(named, "key", "left").select(
        "doc_id", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | own).alias("stays")
    )


def link_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id for every row."""
    return linked_rows(docs).select("doc_id", "n_shingles", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the document with the smallest id.

    Rows go by id and text, so that an id with several texts loses only those that are copies. Repeated rows of a document that stays all stay.
    """
    gone = cut(linked_rows(docs).where("not stays").select("doc_id", "row").distinct(), "gone")
    row = F.xxhash64(docs["doc_id"], docs["text"])
    held = sized(gone)
    return docs.join(held, (row == held["row"]) & docs["doc_id"].eqNullSafe(held["doc_id"]), "left_anti")


def op2_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
