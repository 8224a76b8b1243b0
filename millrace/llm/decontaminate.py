"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a span of words: the hash of the words under its ones. Two passages that differ by
substituted words still agree on a seed whose ignored positions (or whose place) the substitutions miss. Seeds of the
benchmark's items and of every document are joined by hash; each hit fixes an alignment of the item with the document,
and the words around it are compared under that alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lowered, mix, steps, tidy, window_hashes, word_hashes

#: 1: the word counts, 0: it may be anything. In every window of 10 to 24 words, at least one place of one of them is
#: free of any floor(n / 4) substituted words; so are windows of 8 and 9 words with none and one.
MASKS = ("111011", "110100011", "10010111", "111000101", "11111")
#: The same for items of LEAST_ITEM to LONG - 1 words.
SHORT = ("1111", "11101", "11011", "10111", "100111")
LEAST_ITEM, LONG = 5, 10
#: Equal words that a document shorter than the window needs at least.
LEAST_EQUAL = 8
#: Characters of items that one pass takes: what is broadcast is bounded by this, whatever the benchmark holds.
BLOCK_CHARS = 8_000_000
#: Pairs of equal seeds that are held at once.
PAIRS = 1 << 20
BITS = 22

_KINDS = {"string": pa.string(), "int32": pa.int32()}


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _index(items: list[tuple], masks: tuple[str, ...]) -> dict:
    """Tables of one block of the benchmark: its words, and its seeds sorted by hash for each mask."""
    hashes, at = word_hashes([t.lower().encode() for _, t in items])
    n = np.repeat(np.diff(at), np.diff(at))  # for every word, the words of its item and those from it to the end
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(hashes))
    seeds = []
    for mask, fits in [(m, n >= LONG) for m in masks] + [(m, (n >= LEAST_ITEM) & (n < LONG)) for m in SHORT]:
        place = np.flatnonzero(fits & (left >= len(mask)))
        h = window_hashes(hashes, offsets(mask))[place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        seeds.append((offsets(mask), h[order], place[order]))
    used = np.zeros(1 << BITS, dtype=bool)
    used[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return {"ids": [i for i, _ in items], "words": hashes, "at": at, "seeds": [s for s in seeds if len(s[1])], "used": used}


def _hits(words: np.ndarray, index: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in `words`, place in the items' words) of equal seeds, about PAIRS at a time: a repetitive text meets a
    repetitive item at as many pairs as the product of their lengths."""
    known = index["used"][(words >> np.uint64(64 - BITS)).astype(np.int64)]
    for offs, seeds, at in index["seeds"]:
        n = len(words) - offs[-1]
        if n <= 0:
            continue
        maybe = known[:n].copy()
        for o in offs[1:]:
            maybe &= known[o : o + n]
        p = np.flatnonzero(maybe)
        h = np.zeros(len(p), dtype=np.uint64)
        for o in offs:
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[p + o]
        h = mix(h)
        a, b = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        p, a, n = p[b > a], a[b > a], (b - a)[b > a]
        ends = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ends, np.arange(PAIRS, ends[-1] + PAIRS, PAIRS), "right")) if len(n) else []
        for x, y in zip([0, *cuts], [*cuts, len(n)]):
            if y > x:
                m = n[x:y]
                yield np.repeat(p[x:y], m), at[np.repeat(a[x:y] - np.cumsum(m) + m, m) + np.arange(m.sum())]


def _laid(words: np.ndarray, at: np.ndarray, index: dict, doc: np.ndarray, item: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For items laid on documents from `start`: best share of equal words in a window of the item; words equal and compared.

    Places outside the document are unequal. A shorter document is a window itself, if LEAST_EQUAL words are equal.
    """
    first, n = index["at"][item], index["at"][item + 1] - index["at"][item]
    a, b = np.maximum(start, at[doc]), np.minimum(start + n, at[doc + 1])
    begin = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - begin[row]
    place = start[row] + within
    inside = np.flatnonzero((place >= a[row]) & (place < b[row]))
    equal = np.zeros(len(row) + 1, dtype=np.int64)
    equal[1 + inside] = words[place[inside]] == index["words"][(first[row] + within)[inside]]
    equal = np.cumsum(equal)
    size = np.minimum(window, n)
    ends = np.arange(1, len(row) + 1)
    sums = np.where(within + 1 >= size[row], equal[ends] - equal[np.maximum(ends - size[row], 0)], 0)
    best, total, length = np.maximum.reduceat(sums, begin) / size, equal[begin + n] - equal[begin], at[doc + 1] - at[doc]
    short = (length < size) & (total >= LEAST_EQUAL)
    return np.where(short, np.maximum(best, total / np.maximum(length, 1)), best), total, b - a


def _once(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """The distinct rows of (document, item, start)."""
    doc, item, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
    return [(doc[new], item[new], start[new])]


def _find(shared, window: int, share: float, like: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts, ids = lowered(batch.column("text")), batch.column("doc_id")
            found: dict[tuple[int, int], tuple] = {}
            for first, last in steps([len(t) for t in texts]):
                words, at = word_hashes(texts[first:last])
                laid = []  # (document, item, start) of each alignment once; there are fewer than words of both
                for place, item_place in _hits(words, index):
                    doc, item = np.searchsorted(at, place, "right") - 1, np.searchsorted(index["at"], item_place, "right") - 1
                    start = place - (item_place - index["at"][item])
                    laid = _once([*laid, (doc, item, start)])
                if not laid:
                    continue
                doc, item, start = laid[0]
                for x, y in steps(np.diff(index["at"])[item].tolist()):
                    got = _laid(words, at, index, doc[x:y], item[x:y], start[x:y], window)
                    for k in np.flatnonzero(got[0] >= share).tolist():
                        d, i = int(doc[x + k]), int(item[x + k])
                        at_doc = max(0, int(start[x + k]) - int(at[d]))
                        row = (float(got[0][k]), int(got[1][k]), int(got[2][k]), -at_doc)
                        found[first + d, i] = max(found.get((first + d, i), (0,)), row)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([d for d, _ in found])), pa.array([index["ids"][i] for _, i in found], _KINDS.get(like, pa.int64()))] + [pa.array([v[k] for v in found.values()], pa.float64() if k == 0 else pa.int64()) for k in range(3)] + [pa.array([-v[3] for v in found.values()], pa.int64())],
                    names=["doc_id", "item_id", "share", "n_equal", "n_compared", "word_at"],
                )

    return run


def _clean(shared, window: int, share: float, kind: str):
    find = _find(shared, window, share, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(range(batch.num_rows), pa.int64())
            asked = pa.RecordBatch.from_arrays([rows, batch.column("text")], names=["doc_id", "text"])
            gone = {i for found in find(iter([asked])) for i in found.column("doc_id").to_pylist()}
            yield batch.filter(pa.array([i not in gone for i in range(batch.num_rows)], pa.bool_()))

    return run


def _over_blocks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], step) -> Iterator[DataFrame]:
    """`step`(what a block leaves to be read, its broadcast tables) for each block of the benchmark.

    Blocks are dealt out by hash and hold about BLOCK_CHARS characters; the driver and the workers hold one of them at a
    time, since with several the result of each is written before the next is collected.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(n):
        rows = sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())
        shared = docs.sparkSession.sparkContext.broadcast(_index(rows, masks))
        docs, found = step(docs, shared)
        if n > 1:
            found = cut(found)
            docs = found if docs is None else docs
            shared.unpersist()
        yield found


def _kind(benchmark: DataFrame) -> str:
    return {"string": "string", "int": "int32"}.get(dict(benchmark.dtypes)["item_id"], "int64")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 24, share: float = 0.75, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """The rows of `docs` that overlap no benchmark item (see leaks), with all their columns, whatever their names;
    decided where they are read. Rows with a null or empty text, or a null doc_id, are judged by their text like others,
    so the former stay; repeated rows fare alike; an empty table gives no rows, an empty benchmark keeps all.
    """
    out = docs
    for out in _over_blocks(docs, benchmark, masks, lambda rest, shared: (None, rest.mapInArrow(tidy(_clean(shared, window, share, _kind(benchmark))), docs.schema))):
        pass
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 24, share: float = 0.75, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """doc_id, item_id, share, n_equal, n_compared, word_at: a row for each document and benchmark item that overlap.

    They overlap if, under the alignment of some shared seed, `share` of a window of min(`window`, the item's words)
    words are equal; places of the window outside the document are unequal. A document of fewer words than the window is
    a window itself, of which LEAST_EQUAL words at least have to be equal. MASKS and SHORT leave no overlap of a share of
    0.75 in 24 words out. Words are lower-cased runs of letters, digits and underscores. Items of fewer than five words,
    null texts and empty texts overlap nothing; of repeated doc_ids or item_ids the best overlap is returned, rows of a
    null doc_id as one. Very long texts are taken in one step each, repetitive ones by bounded numbers of equal seeds;
    other columns are not read; an empty table or benchmark gives no rows. The benchmark goes by in blocks of
    BLOCK_CHARS characters, each broadcast and held against all documents.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, share double, n_equal long, n_compared long, word_at long"
    found = None
    for part in _over_blocks(rows, benchmark, masks, lambda all_, shared: (all_, all_.mapInArrow(tidy(_find(shared, window, share, _kind(benchmark))), schema))):
        found = part if found is None else found.union(part)
    best = F.max(F.struct("share", "n_equal", "n_compared", (-F.col("word_at")).alias("w"))).alias("m")
    out = found.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "m.share", "m.n_equal", "m.n_compared", (-F.col("m.w")).alias("word_at"))
