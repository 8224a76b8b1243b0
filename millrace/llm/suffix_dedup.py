"""Suffix-array dedup: remove bytes covered by strings of `length` bytes that also start earlier.

1. Every window of `length` bytes is filed under one anchor: the least hash of the `GRAM`-byte strings in it (leftmost of
   equals), a choice that depends on the window's content alone. Windows that follow each other share anchors, so a
   document becomes runs of windows, about one for every 35 bytes, each the context of one anchor.
2. Runs meet by (anchor hash, context hash). Equal contexts are equal window by window: all but the earliest are removed
   whole. Copies are matched within each batch before the shuffle, so a context that a third of all documents hold
   reaches its reducer once a batch.
3. Contexts that differ but share an anchor may still share some windows. Windows are told apart by how far before the
   anchor they start, in PARTS ranges; all windows of one range hold the same stretch around the anchor, its core. Two
   contexts that share a window share the core of its range, so a context none of whose cores is in another context of
   its anchor is done: most anchors that meet by chance, whose number grows faster than the input, end here.
4. The bytes of the others go, shard by shard of anchor hashes, through a suffix array: induced sorting, then permuted
   common prefixes. Neighbours with common prefixes of `length` bytes are the same window; all but the earliest are
   removed.
5. The removed windows of each document are merged into spans and cut from its bytes.

Anchors that many documents hold in different contexts (headers, licences) would make one large shard. A sample of the
documents names them, and those that it missed are counted before step 4; their windows are filed apart, each under its
own hash. The sample only chooses the route: both routes find the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, cut, mix, powers, prefix_hash, tidy
from .suffix_array import permuted_prefixes, suffix_array

GRAM = 32
#: Bytes of one suffix array; a shard ends at the first anchor past this.
SHARD_BYTES = 1 << 20
#: An anchor is filed by windows if it is in this share of the sampled documents, or has so many contexts left in step 3.
HOT_SHARE, HOT_LEAST, WIDE_CONTEXTS, SAMPLE = 0.005, 32, 4_096, 16
#: Ranges of a window's start before its anchor; each core is kept as 16 bits of hash, 0 where the context has no window.
PARTS = 4
#: Contexts of one anchor that are held to compare their cores; if there are more, all of them go on to step 4.
HELD = 1 << 18
ROUTED = "h long, c long, doc_id long, at long, n int, cores long, known boolean"
PLACED = "h long, c long, doc_id long, at long, n int, bytes binary"


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, place, bytes) of about STEP_BYTES; long documents in parts that overlap by length - 1."""
    out, total = [], 0
    for d, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), 4 * STEP_BYTES):
            p = t[a : a + 4 * STEP_BYTES + length - 1] if len(t) > 4 * STEP_BYTES else t
            if len(p) < length:
                continue
            if total and total + len(p) > STEP_BYTES:
                yield out
                out, total = [], 0
            out.append((d, a, p))
            total += len(p)
    if out:
        yield out


def _cores(sums: np.ndarray, down: np.ndarray, s: np.ndarray, n: np.ndarray, a: np.ndarray, length: int) -> np.ndarray:
    """16 bits of each core of the runs of `n` windows from `s` on, whose anchors are at `a`."""
    out = np.zeros(len(s), dtype=np.uint64)
    span = length - GRAM + 1
    width = -(-span // PARTS)
    for k in range(PARTS):
        low, high = k * width, min((k + 1) * width, span) - 1
        i = np.flatnonzero((a - s >= low) & (a - s - n < high)) if low <= high else np.zeros(0, dtype=np.int64)
        begin = a[i] - low
        bits = mix((sums[a[i] - high + length] - sums[begin]) * down[begin]) >> np.uint64(48)
        out[i] |= np.maximum(bits, np.uint64(1)) << np.uint64(16 * k)
    return out


def context_runs(texts: list[bytes], length: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(h, c, document, at, n, cores) of all runs of windows; the runs of `hot` anchors window by window, without cores."""
    out = [[] for _ in range(6)]
    span = length - GRAM + 1  # grams of a window
    for piece in _pieces(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in piece), dtype=np.uint8)
        sums, (up, down) = prefix_hash(data), powers(len(data) + 1)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
        key = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)  # leftmost of equals
        low, width = key, 1
        while width * 2 <= span:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        sizes = np.array([len(p) for _, _, p in piece])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        edge = np.ones(len(anchor), dtype=bool)
        edge[1:] = anchor[1:] != anchor[:-1]
        edge[begins[begins < len(edge)]] = True
        over = ends - length + 1  # first start that would cross the end
        edge[over[over < len(edge)]] = True
        s = np.flatnonzero(edge)
        n = np.diff(np.append(s, len(anchor)))
        k = np.searchsorted(ends, s, "right")
        fits = s < over[np.minimum(k, len(over) - 1)]
        s, n, k = s[fits], n[fits], k[fits]
        a = anchor[s]
        h = grams[a]
        if len(hot):
            wide = np.isin(h, hot)
            if wide.any():
                times = np.where(wide, n, 1)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                s, k, a, h = np.repeat(s, times) + step, np.repeat(k, times), np.repeat(a, times), np.repeat(h, times)
                n = np.where(np.repeat(wide, times), 1, np.repeat(n, times))
        else:
            wide = np.zeros(len(s), dtype=bool)
        whole = mix((sums[s + n + length - 1] - sums[s]) * down[s])
        c = mix(whole ^ mix((n * 4096 + (a - s)).astype(np.uint64)))
        cores = _cores(sums, down, s, n, a, length)
        if wide.any():  # a window alone is filed under its own hash
            alone = np.isin(h, hot)
            h, c, cores = np.where(alone, c, h), np.where(alone, mix(h + whole), c), np.where(alone, np.uint64(0), cores)
        doc, place = np.array([d for d, _, _ in piece]), np.array([x for _, x, _ in piece])
        for o, v in zip(out, (h, c, doc[k], place[k] + s - begins[k], n, cores), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _batch(h, c, doc, at, n, cores, known) -> pa.RecordBatch:
    h, c, cores = (pa.array(np.asarray(v).astype(np.uint64).view(np.int64)) for v in (h, c, cores))
    arrays = [h, c, pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(np.asarray(n).astype(np.int32)), cores, pa.array(known, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["h", "c", "doc_id", "at", "n", "cores", "known"])


def merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, those that follow each other in a document joined."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])
    begin = np.flatnonzero(first)
    return doc[begin], at[begin], np.add.reduceat(n, begin) if len(begin) else n


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, _, doc, *_ = context_runs(_bytes(b.column("text")), length, np.zeros(0, np.uint64))
            pairs = np.unique(np.stack([h.view(np.int64), doc.astype(np.int64)], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0])], names=["h"])

    return run


def _runs(length: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array(b.column("doc_id").to_pylist(), dtype=np.int64)
            h, c, doc, at, n, cores = context_runs(_bytes(b.column("text")), length, shared.value)
            if not len(h):
                continue
            doc = ids[doc]
            order = np.lexsort((at, doc, c, h))
            h, c, doc, at, n, cores = (v[order] for v in (h, c, doc, at, n, cores))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            later = ~new & ((doc != doc[first]) | (at != at[first]))
            yield _batch(h[new], c[new], doc[new], at[new], n[new], cores[new], np.zeros(int(new.sum()), bool))
            d, a, m = merged(doc[later], at[later], n[later])
            yield _batch(mix(d.astype(np.uint64) + np.uint64(1)), d * 0, d, a, m, m * 0, np.ones(len(d), bool))

    return run


def _meets(h: np.ndarray, cores: np.ndarray) -> np.ndarray:
    """Of contexts in the order of `h`: those with a core that another context of their anchor has too."""
    out = np.zeros(len(h), dtype=bool)
    anchor = np.cumsum(np.append(True, h[1:] != h[:-1])).astype(np.uint64) << np.uint64(16)
    for k in range(PARTS):
        bits = cores >> np.uint64(16 * k) & np.uint64(0xFFFF)
        i = np.flatnonzero(bits)
        key = anchor[i] | bits[i]
        order = np.argsort(key)
        key, i = key[order], i[order]
        same = key[1:] == key[:-1]
        out[i[1:][same]] = out[i[:-1][same]] = True
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by (h, c, doc_id, at): removed runs (known), and contexts with a core of another one of their anchor."""
    names = ("h", "c", "doc_id", "at", "n", "cores")
    held, crowded = None, None  # contexts of the last anchor met, which may go on; an anchor that has more than HELD
    for b in batches:
        cols = {k: b.column(k).to_numpy(zero_copy_only=False) for k in b.schema.names}
        if cols["known"].any():
            k = cols["known"]
            yield _batch(*(cols[x][k] for x in names), np.ones(int(k.sum()), bool))
        rows = [cols[x][~cols["known"]] for x in names]
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
        h, c, doc, at, n, cores = rows
        if not len(h):
            continue
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        f = np.flatnonzero(new)
        first = f[np.cumsum(new) - 1]
        later = ~new & ((doc != doc[first]) | (at != at[first]))
        if later.any():
            d, a, m = merged(doc[later], at[later], n[later])
            yield _batch(d, d * 0, d, a, m, m * 0, np.ones(len(d), bool))
        stays = h[f] == h[-1]
        if stays.sum() > HELD:
            crowded = h[-1]
        many = h[f] == crowded if crowded is not None else np.zeros(len(f), dtype=bool)
        stays &= ~many
        stays[-1] = True  # its followers are compared with it
        out = f[(_meets(h[f], cores[f].view(np.uint64)) | many) & ~stays]
        yield _batch(*(x[out] for x in rows), np.zeros(len(out), bool))
        held = [x[f[stays]] for x in rows]
    if held is not None:
        out = _meets(held[0], held[5].view(np.uint64)) | (held[0] == crowded if crowded is not None else False)
        yield _batch(*(x[out] for x in held), np.zeros(int(out.sum()), bool))


def _contexts(length: int):
    """Each document's contexts: (h, 0, doc_id, at, n, bytes); wide ones window by window, under two hashes and without bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, contexts in zip(b.column("doc_id").to_pylist(), _bytes(b.column("text")), b.column("contexts").to_pylist(), strict=True):
                for x in contexts:
                    data = text[x["at"] : x["at"] + x["n"] + length - 1]
                    if x["wide"]:
                        sums = prefix_hash(np.frombuffer(data, dtype=np.uint8))
                        whole = mix((sums[length:] - sums[:-length]) * powers(x["n"])[1])
                        keys = mix(whole + np.array([x["h"]]).view(np.uint64))
                        out += [(h, c, doc, x["at"] + i, 1, None) for i, (h, c) in enumerate(zip(keys.view(np.int64).tolist(), whole.view(np.int64).tolist(), strict=True))]
                    else:
                        out.append((x["h"], 0, doc, x["at"], x["n"], data))
                if len(out) > 20_000:
                    yield _context_batch(out)
                    out = []
            if out:
                yield _context_batch(out)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["h", "c", "doc_id", "at", "n", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows), kinds, strict=True)], names=names)


def repeated_windows(contexts: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, at) of the windows of these contexts (doc_id, at, n, bytes) that also start earlier in one of them."""
    sizes = np.array([len(x[3]) + 1 for x in contexts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"\x00".join(x[3] for x in contexts) + b"\x00", dtype=np.uint8).astype(np.int64) + 2
    data[ends - 1] = 1  # ends of contexts; equal to each other, smaller than all bytes
    t = np.append(data, 0)
    sa = suffix_array(t)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    inside = np.arange(len(data)) - (ends - sizes)[owner]
    is_window = np.append(inside < np.array([x[2] for x in contexts])[owner], False)
    _, plcp = permuted_prefixes(t, sa, length, is_window)
    # suffixes between two that share `length` bytes share them too, so they are windows: others cannot part a group
    place = sa[is_window[sa]]
    group = np.cumsum(plcp[place] < length)
    k = owner[place]
    doc, at = np.array([x[0] for x in contexts], dtype=np.int64)[k], np.array([x[1] for x in contexts], dtype=np.int64)[k] + inside[place]
    order = np.lexsort((at, doc, group))
    group, doc, at = group[order], doc[order], at[order]
    new = np.ones(len(group), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    later = (doc != doc[first]) | (at != at[first])
    return doc[later], at[later]


def _shards(length: int):
    """Runs removed of contexts sorted by (h, c, doc_id, at): by suffix array, or, where there are no bytes, by (h, c)."""
    def removed(doc, at):
        d, a, n = _unit_runs(np.asarray(doc, dtype=np.int64), np.asarray(at, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(np.asarray(n).astype(np.int32))], names=["doc_id", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, total, last, window = [], 0, None, None
        for b in batches:
            later = []
            for h, c, doc, at, n, data in zip(*(b.column(x).to_pylist() for x in ("h", "c", "doc_id", "at", "n", "bytes")), strict=True):
                if data is None:
                    if window is None or window[:2] != (h, c):
                        window = (h, c, doc, at)
                    elif window[2:] != (doc, at):
                        later.append((doc, at))
                    continue
                if total > SHARD_BYTES and h != last:
                    yield removed(*repeated_windows(contexts, length))
                    contexts, total = [], 0
                contexts.append((doc, at, n, data))
                total, last = total + len(data), h
            if later:
                yield removed(*zip(*later))
        if contexts:
            yield removed(*repeated_windows(contexts, length))

    return run


def _unit_runs(doc: np.ndarray, at: np.ndarray):
    pairs = np.unique(np.stack([doc, at]), axis=1)
    return merged(pairs[0], pairs[1], np.ones(pairs.shape[1], dtype=np.int64))


def _cut_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, n_spans, kept, sizes = [], [], [], []
            for text, runs in zip(_bytes(b.column("text")), b.column("runs").to_pylist(), strict=True):
                parts, end, gone, spans = [], 0, 0, 0
                for at, z in sorted((x["at"], x["at"] + x["n"] + length - 1) for x in runs or ()):
                    if at > end or not spans:
                        spans += 1
                        parts.append(text[end:at])
                        gone += z - at
                    else:
                        gone += max(0, z - end)
                    end = max(end, z)
                parts.append(text[end:])
                sizes.append(len(text))
                removed.append(gone)
                n_spans.append(spans)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs) of every document.

    Texts are UTF-8 bytes, null ones empty. A string starts earlier in a smaller doc_id or earlier in the same document;
    matches overlap freely and never cross documents. A doc_id names one text: its repeated rows fare alike and do not
    count as earlier than each other. Rows with a null doc_id keep everything and are earlier than none. Hashes of 64
    bits pair up (anchor and context, or window and anchor), so equality is by 128 bits where it is not by the suffix array.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named, unnamed = rows.where("doc_id is not null"), rows.where("doc_id is null")
    sample = named.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SAMPLE)) == 0)
    # an anchor in HOT_SHARE of the sampled documents: at most (anchors a document) / HOT_SHARE of them
    least = max(HOT_LEAST, int(HOT_SHARE * sample.count()))
    seen = sample.mapInArrow(tidy(_anchors(length)), "h long").groupBy("h").count().where(F.col("count") >= least)
    hot = np.array([r.h for r in seen.collect()], dtype=np.int64).view(np.uint64)
    runs = named.mapInArrow(tidy(_runs(length, spark.sparkContext.broadcast(np.sort(hot)))), ROUTED)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judged = cut(runs.repartition(n, "h").sortWithinPartitions("h", "c", "doc_id", "at").mapInArrow(tidy(_compare), ROUTED))
    gone = judged.where("known").select("doc_id", "at", "n")
    open_ = judged.where("not known").drop("known")
    wide = open_.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") >= WIDE_CONTEXTS).select("h", F.lit(True).alias("wide"))
    open_ = open_.join(wide, "h", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    by_doc = open_.groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", "n", "wide")).alias("contexts"))
    placed = named.repartition(n, "doc_id")  # both joins read this exchange
    contexts = placed.join(by_doc, "doc_id").select("doc_id", "text", "contexts").mapInArrow(tidy(_contexts(length)), PLACED)
    found = contexts.repartition(n, "h").sortWithinPartitions("h", "c", "doc_id", "at").mapInArrow(tidy(_shards(length)), "doc_id long, at long, n int")
    flags = gone.union(found).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    joined = placed.join(flags, "doc_id", "left").select("doc_id", "text", "runs")
    joined = joined.union(unnamed.select("doc_id", "text", F.lit(None).cast(joined.schema["runs"].dataType)))
    return joined.mapInArrow(tidy(_cut_spans(length)), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
