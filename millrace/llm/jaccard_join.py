"""N-gram Jaccard join by chosen paths.

1. A document is the set of its word shingles. Equal sets meet by fingerprint and go on as one class with its copies
   counted. Each class gets a sketch: `TOKENS` minima, so two sets agree on a token with probability J.
2. In every run, each node of a tree lets a set go down along those of its tokens that a hash of (node, token) picks,
   1 / threshold of them on average, so similar sets keep meeting along shared tokens. Nodes of up to `LEAF` sets are
   leaves; larger ones are split again, up to `depth` times; what is still larger then (many sets all alike) is compared
   in blocks. Runs are repeated until a pair at the threshold is missed with less than 1 - recall.
3. Leaves are brute-forced on sketches, and pairs that come near the threshold on exact shingle sets. A pair belongs to
   the first leaf that both its sets are in, so no pair is counted twice, and none is written out: a leaf gives each set
   its number of links and the smallest set it hangs together with.
4. The smallest sets spread over the links until nothing changes; they name the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lowered, mix, steps, tidy, window_hashes, word_hashes

TOKENS, LEAF, BLOCK, MARGIN = 128, 256, 256, 0.14


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of 1 to n - 1 words is one shingle, one of none is empty."""
    words, at = word_hashes(texts)
    all_ = window_hashes(words, list(range(n)))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(all_[a : b - n + 1]))
        else:
            out.append(window_hashes(words[a:b], list(range(b - a))) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of TOKENS uint32 minima for each non-empty set: one permutation, a token a bin; empty bins borrow from a bin
    that a hash of (bin, try) names, the same for every set."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    h = mix(np.concatenate(sets) + np.uint64(0x5851F42D4C957F2D)) if len(sets) else np.zeros(0, np.uint64)
    low = np.full(len(sets) * TOKENS, 1 << 32, dtype=np.int64)
    np.minimum.at(low, row * TOKENS + (h & np.uint64(TOKENS - 1)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64))
    low = low.reshape(-1, TOKENS)
    full = low < 1 << 32
    out, left, tries = low.copy(), np.argwhere(~full & (sizes > 0)[:, None]), 0
    while len(left):
        tries += 1
        donor = (mix(np.uint64(tries * 1000) + left[:, 1].astype(np.uint64)) % np.uint64(TOKENS)).astype(np.int64)
        has = full[left[:, 0], donor]
        r, c = left[has].T
        out[r, c] = (mix((low[r, donor[has]] * 4096 + tries).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        left = left[~has]
    return (out & 0xFFFFFFFF).astype(np.uint32)


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = lowered(b.column("text")), b.column("doc_id")
            for first, last in steps([len(t) for t in texts]):
                sets = shingle_sets(texts[first:last], n)
                with np.errstate(over="ignore"):
                    f = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                    g = np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], dtype=np.uint64)
                sk = sketches(sets)
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), pa.array([r.tobytes() for r in sk], pa.binary())], names=["doc_id", "size", "f", "g", "sketch"])

    return run


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def children(node: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for the tokens of each row that its node picks."""
    with np.errstate(over="ignore"):
        h = mix(mix(node)[:, None] ^ tokens)
    row, col = np.nonzero(h < np.uint64(2**64 / (threshold * TOKENS)))
    return row, mix(h[row, col] + np.uint64(1))


def _descend(threshold: float, roots: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                if not part.num_rows:
                    continue
                sk = _matrix(part.column("sketch"), "<u4").astype(np.uint64)
                tokens = mix(sk | (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)))
                ids = part.column("rep").to_numpy()
                for node in [np.full(len(ids), r) for r in roots] if roots is not None else [part.column("node").to_numpy().view(np.uint64)]:
                    row, child = children(node, tokens, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[row])], names=["node", "rep"])

    return run


def shared_counts(lists: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Matrix of the numbers of common elements of any two lists (without repeats), as products of blocks of columns."""
    both = lists if others is None else lists + others
    sizes = np.array([len(x) for x in both])
    flat = np.concatenate(both) if len(both) else np.zeros(0)
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    common = n[col] > 1
    row, col = row[common], col[common]
    _, col = np.unique(col, return_inverse=True)
    a, b = len(lists), len(lists) if others is None else len(others)
    out = np.zeros((a, b), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 2048
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, (first, first + width))
        m = np.zeros((len(both), width), dtype=np.float32)
        m[row[lo:hi], col[lo:hi] - first] = 1
        out += m[:a] @ (m if others is None else m[a:]).T
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal `keys`, over batches; the rows come sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ks = np.stack([b.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((ks[:, 1:] != ks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and any(held[0].column(k)[0] != b.column(k)[a] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both sides of a block: the same rows on the diagonal."""
    side = table.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _first_here(leaves: list[np.ndarray], node: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair of sets has no smaller leaf in common."""
    less = [x[x < node] for x in leaves]
    return shared_counts([less[i] for i in a], [less[i] for i in b]) == 0


def _near(threshold: float):
    """Leaves whose sketches come near the threshold: (node, left, right, rep) of the sets to compare exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["node", "left", "right"]):
            a, b = _sides(t)
            diagonal = not len(b)
            b = a if diagonal else b
            if not len(a) or len(a) + len(b) < 2:
                continue
            sk = _matrix(t.column("small").combine_chunks(), "u1")
            size = t.column("size").to_numpy().astype(np.float64)
            agree = np.zeros((len(a), len(b)), dtype=np.int32)
            for k in range(TOKENS):
                agree += sk[a, k][:, None] == sk[b, k][None, :]
            near = agree >= (threshold - MARGIN) * TOKENS
            near &= np.minimum(size[a][:, None], size[b][None, :]) >= threshold * np.maximum(size[a][:, None], size[b][None, :])
            if diagonal:
                np.fill_diagonal(near, False)
            if near.any():
                near &= _first_here([np.asarray(x) for x in t.column("leaves").to_pylist()], int(t.column("node")[0].as_py()), a, b)
            rows = np.concatenate([a[near.any(axis=1)], b[near.any(axis=0)]])
            rows = np.unique(rows)
            if len(rows):
                yield from t.select(["node", "left", "right", "side", "rep"]).take(pa.array(rows)).combine_chunks().to_batches()

    return run


def _small_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte a token: enough to tell near pairs from others."""
    for b in batches:
        if b.num_rows:
            small = mix(_matrix(b.column("sketch"), "<u4").astype(np.uint64)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("size"), b.column("copies"), pa.array([r.tobytes() for r in small], pa.binary())], names=["rep", "size", "copies", "small"])


def _with_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = lowered(b.column("text"))
            places, leaves = b.column("places").to_pylist(), b.column("leaves")
            for first, last in steps([len(t) for t in texts]):
                rows, sets = [], shingle_sets(texts[first:last], n)
                for i in range(first, last):
                    data = (sets[i - first] >> np.uint64(32)).astype("<u4").tobytes()
                    rows += [(p["node"], p["left"], p["right"], p["side"], i, len(sets[i - first]), data) for p in places[i]]
                cols = list(zip(*rows))
                at = pa.array(cols[4])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(cols[:4], (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)] + [b.column("rep").take(at), b.column("copies").take(at), leaves.take(at), pa.array(list(cols[5]), pa.int64()), pa.array(list(cols[6]), pa.binary())],
                    names=["node", "left", "right", "side", "rep", "copies", "leaves", "size", "set"],
                )

    return run


def _verify(threshold: float):
    """(rep, links, root) of each leaf: copies of the sets linked here for the first time, and the smallest set that hangs
    together with it here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["node", "left", "right"]):
            a, b = _sides(t)
            diagonal = not len(b)
            b = a if diagonal else b
            if not len(a):
                continue
            sets = [np.frombuffer(x, dtype="<u4") for x in t.column("set").to_pylist()]
            size, copies, rep = (t.column(c).to_numpy() for c in ("size", "copies", "rep"))
            both = shared_counts([sets[i] for i in a], None if diagonal else [sets[i] for i in b])
            alike = both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-6
            if diagonal:
                np.fill_diagonal(alike, False)
            if not alike.any():
                continue
            new = alike & _first_here([np.asarray(x) for x in t.column("leaves").to_pylist()], int(t.column("node")[0].as_py()), a, b)
            links = np.zeros(t.num_rows, dtype=np.int64)
            np.add.at(links, a, new @ copies[b])
            if not diagonal:
                np.add.at(links, b, new.T @ copies[a])
            root, before = rep.copy(), None
            while before is None or (root != before).any():  # smallest of the neighbours, again until it stands
                before = root.copy()
                np.minimum.at(root, a, np.where(alike, root[b][None, :], np.iinfo(np.int64).max).min(axis=1))
                if not diagonal:
                    np.minimum.at(root, b, np.where(alike, root[a][:, None], np.iinfo(np.int64).max).min(axis=0))
            rows = np.flatnonzero((links > 0) | (root != rep))
            yield pa.RecordBatch.from_arrays([pa.array(rep[rows]), pa.array(links[rows]), pa.array(root[rows])], names=["rep", "links", "root"])

    return run


def spread_smallest(links: DataFrame, parts: int) -> DataFrame:
    """(rep, class_id): the smallest member of each connected component of the pairs (rep, root)."""
    pairs = links.where("rep <> root").select("rep", "root").distinct()
    edges = cut(pairs.union(pairs.select("root", "rep")))
    label = cut(edges.groupBy("rep").agg(F.min("root").alias("m")).select("rep", F.least("rep", "m").alias("class_id")))
    while True:
        seen = edges.join(label.withColumnRenamed("rep", "root"), "root").groupBy("rep").agg(F.min("class_id").alias("m"))
        near = label.join(seen, "rep").select("rep", F.least("class_id", "m").alias("to"), F.col("class_id").alias("was"))
        jump = label.select(F.col("rep").alias("to"), F.col("class_id").alias("next"))
        new = cut(near.join(jump, "to", "left").select("rep", F.least("to", F.coalesce("next", "to")).alias("class_id"), "was"))
        if not new.where("class_id <> was").limit(1).count():
            return new.drop("was")
        label = new.drop("was")


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of leaves with (left, right, side): one block of up to LEAF sets, or pairs of blocks of about BLOCK sets."""
    m = members.join(sizes, "node").withColumn("blocks", F.when(F.col("n") <= LEAF, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    m = m.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select("node", "rep", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def jaccard_join(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, recall: float = 0.99, depth: int = 3, seed: int = 29) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that hangs together with it by links) and n_links of every document.

    A link is another row whose set of shingles has Jaccard similarity >= `threshold`; `shingle` words make a shingle,
    words are lower-cased runs of letters, digits and underscores. Equal sets are linked. A document of fewer words is
    one shingle; one of no words (null, empty) has no links and is its own class. Repeated rows are rows of their own,
    linked to each other (a doc_id names one text). Rows with a null doc_id are left out. Links found are exact; a pair at the threshold is missed
    with less than 1 - `recall`, closer pairs are missed less.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = cut(rows.mapInArrow(tidy(_sign(shingle)), "doc_id long, size long, f long, g long, sketch binary"))
    some = signed.where("size > 0")
    classes = some.groupBy("f", "g").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = cut(classes)
    # a run keeps a pair at the threshold to depth d with the probability of a branching process of mean 1
    kept = 1.0
    for _ in range(depth):
        kept = 1 - math.exp(-kept)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - kept))
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) + np.uint64(seed * 1000))
    nodes = classes.select("rep", "sketch").mapInArrow(tidy(_descend(threshold, roots)), "node long, rep long")
    leaves = None
    for level in range(1, depth + 1):
        nodes = cut(nodes)
        counts = cut(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        ended = counts if level == depth else counts.where(F.col("n") <= LEAF)
        found = nodes.join(ended.select("node"), "node", "left_semi")
        leaves = found if leaves is None else leaves.union(found)
        sizes = ended if level == 1 else sizes.union(ended)
        large = counts.where(F.col("n") > LEAF).select("node")
        if level == depth or not large.limit(1).count():
            break
        deeper = nodes.join(large, "node", "left_semi").join(classes.select("rep", "sketch"), "rep")
        nodes = deeper.select("node", "rep", "sketch").mapInArrow(tidy(_descend(threshold, None)), "node long, rep long")
    members = cut(leaves.distinct())
    lists = members.groupBy("rep").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    about = cut(classes.select("rep", "size", "copies", "sketch").mapInArrow(tidy(_small_sketch), "rep long, size long, copies long, small binary").join(lists, "rep"))
    placed = _blocks(members, sizes)
    key = ["node", "left", "right"]
    near = placed.join(about.select("rep", "size", "small", "leaves"), "rep").repartition(parts, *key).sortWithinPartitions(*key)
    near = cut(near.mapInArrow(tidy(_near(threshold)), "node long, left int, right int, side int, rep long"))
    places = near.groupBy("rep").agg(F.collect_list(F.struct(*key, "side")).alias("places")).join(about.select("rep", "copies", "leaves"), "rep")
    held = rows.join(places, F.col("doc_id") == F.col("rep")).select("rep", "text", "copies", "leaves", "places").dropDuplicates(["rep"])
    sets = held.mapInArrow(tidy(_with_sets(shingle)), "node long, left int, right int, side int, rep long, copies long, leaves array<long>, size long, set binary")
    links = cut(sets.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(tidy(_verify(threshold)), "rep long, links long, root long"))
    classed = classes.select("f", "g", "rep", "copies")
    total = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classed.join(total, "rep", "left").join(spread_smallest(links, parts), "rep", "left")
    named = named.select("f", "g", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = signed.select("doc_id", "size", "f", "g").join(named, ["f", "g"], "left")
    return whole.select("doc_id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("size") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
