"""Token ids in directly addressable codes: chunk levels, continuation bitmaps and rank directories.

File format `DAC1`, little-endian. An id is split into a low chunk of `width` bits (level 0) and the remaining high bits
(level 1). Level 0 stores a chunk for every token, bit-packed, and a bitmap that says which tokens continue; level 1
stores a chunk for those only. A rank directory keeps the number of set bits before every 512 bits of the bitmap, so
token i is read with one chunk of level 0, one bit, one directory entry and one chunk of level 1: no block is decoded.

    magic 4s | width0 u8 | width1 u8 | pad u16 | n_tokens u64 | n_docs u64
    doc_id i64[n_docs] | doc_start u64[n_docs + 1] | level 0 | bitmap | rank u64[] | level 1   (each padded to 8 bytes)
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, tidy, worker_state

MAGIC, HEAD, RANK_BITS = b"DAC1", "<4sBBHQQ", 512
#: Pieces no pre-token of a byte-level BPE crosses: a word with at most one space before it, or white space. The class
#: is Unicode's White_Space, as the tokenizer's own pattern has it.
_W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
IRREGULAR = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: About so many bytes of words and their ids are remembered by a worker; a word takes some 150 besides its own.
REMEMBERED, WORD_BYTES = 80 << 20, 150
#: Tokens that one step of the file format takes.
CHUNK = 1 << 18
_TWOS = 1 << np.arange(32, dtype=np.int64)


def pack(values: np.ndarray, width: int) -> bytes:
    """`values` as consecutive `width`-bit numbers, least significant bit first, in 64-bit words and one word over."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, dtype=np.uint64)
    for k, step, word, shift in _phases(width):
        v = values[k::step].astype(np.uint64)
        stride = step * width // 64
        out[word::stride][: len(v)] |= v << np.uint64(shift)
        if shift + width > 64:
            out[word + 1 :: stride][: len(v)] |= v >> np.uint64(64 - shift)
    return out.tobytes()


def _phases(width: int):
    """(first value, step, first word, shift) of the values that share a place within a word."""
    step = 64 // int(np.gcd(64, width)) if width else 0
    for k in range(step):
        yield k, step, k * width // 64, k * width % 64


def unpack_run(words: np.ndarray, width: int, a: int, b: int) -> np.ndarray:
    """Numbers a to b - 1 of packed `words`."""
    lead = a % 64  # 64 numbers fill `width` words, whatever the width
    words, n = words[(a - lead) * width // 64 :], b - a + lead
    out = np.zeros(n, dtype=np.uint64)
    for k, step, word, shift in _phases(width):
        count, stride = (n - k + step - 1) // step, step * width // 64
        if count > 0:
            v = words[word::stride][:count] >> np.uint64(shift)
            if shift + width > 64:
                v |= words[word + 1 :: stride][:count] << np.uint64(64 - shift)
            out[k::step] = v & np.uint64((1 << width) - 1)
    return out[lead:]


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Numbers at any places `at` of packed `words`."""
    if not width:
        return np.zeros(len(at), dtype=np.uint64)
    bit = at.astype(np.uint64) * np.uint64(width)
    w, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    high = np.where(shift > 0, words[np.minimum(w + 1, len(words) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[w] >> shift) | high) & np.uint64((1 << width) - 1)


def best_width(ids: np.ndarray) -> tuple[int, int]:
    """Widths of both levels that take the fewest bits for these ids."""
    lengths = np.zeros(33, dtype=np.int64)  # of ids by their bits
    for a in range(0, len(ids), CHUNK):
        lengths += np.bincount(np.searchsorted(_TWOS, ids[a : a + CHUNK], "right"), minlength=33)
    top = max(1, int(np.flatnonzero(lengths).max(initial=0)))
    beyond = len(ids) - np.cumsum(lengths)  # ids of more than b bits
    cost = {b: len(ids) * (b + 1) + int(beyond[b]) * (top - b) for b in range(1, top + 1)}
    width = min(cost, key=lambda b: (cost[b], b))
    return width, top - width


def encoded(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """One file of these documents' ids, in pieces; beyond `ids`, no more than a level is held at once."""
    w0, w1 = best_width(ids)
    yield struct.pack(HEAD, MAGIC, w0, w1, 0, len(ids), len(doc_ids))
    yield doc_ids.astype("<i8").tobytes()
    yield np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(lengths, dtype=np.uint64)]).tobytes()
    low = np.uint32((1 << w0) - 1)
    for a in range(0, len(ids), CHUNK):  # whole words: CHUNK is a multiple of 64
        yield pack(ids[a : a + CHUNK] & low, w0)[:-8]
    yield bytes(8)
    bits, more = [], []
    for a in range(0, len(ids), CHUNK):
        high = ids[a : a + CHUNK] >> np.uint32(w0)
        bits.append(np.packbits(high > 0, bitorder="little"))
        more.append(high[high > 0])
    bits.append(np.zeros(-sum(map(len, bits)) % (RANK_BITS // 8), dtype=np.uint8))
    whole = np.concatenate(bits)
    yield whole.tobytes()
    ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint64)
    yield np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ones, dtype=np.uint64)]).tobytes()
    yield pack(np.concatenate(more) if more else np.zeros(0, dtype=np.uint32), w1)


def encode(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    return b"".join(encoded(doc_ids, lengths, ids.astype("<u4", copy=False)))


class DacFile:
    """Random access to a file's tokens. `data` is the file's content, read or memory-mapped."""

    def __init__(self, data) -> None:
        magic, self.w0, self.w1, _, self.n, n_docs = struct.unpack_from(HEAD, data, 0)
        if magic != MAGIC:
            raise ValueError("not a DAC1 file")
        at = struct.calcsize(HEAD)

        def take(kind, count):
            nonlocal at
            a = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += a.nbytes
            return a

        self.doc_ids, self.start = take("<i8", n_docs), take("<u8", n_docs + 1)
        self.level0 = take("<u8", (self.n * self.w0 + 63) // 64 + 1)
        blocks = ((self.n + 7) // 8 + RANK_BITS // 8 - 1) // (RANK_BITS // 8)
        self.bits, self.rank = take("u1", blocks * (RANK_BITS // 8)), take("<u8", blocks + 1)
        self.level1 = np.frombuffer(data, dtype="<u8", offset=at)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Ids of the tokens at any positions, each found on its own."""
        at = np.asarray(at, dtype=np.int64)
        ids = unpack(self.level0, self.w0, at)
        more = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        if more.any():
            p = at[more]
            block = p // RANK_BITS
            words = self.bits.view(np.uint64)
            rank = self.rank[block].astype(np.int64)
            for k in range(RANK_BITS // 64):  # whole words before p in its block, then the bits before p in its word
                word = np.minimum(block * (RANK_BITS // 64) + k, len(words) - 1)
                here = (p // 64) - block * (RANK_BITS // 64)
                mask = np.where(k < here, np.uint64(0xFFFFFFFFFFFFFFFF), np.where(k == here, (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1), np.uint64(0)))
                rank += np.bitwise_count(words[word] & mask).astype(np.int64)
            ids[more] |= unpack(self.level1, self.w1, rank) << np.uint64(self.w0)
        return ids.astype(np.uint32)

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids of tokens a to b - 1: the positions follow each other, so one rank serves them all."""
        ids = unpack_run(self.level0, self.w0, a, b)
        lead = a & 7
        more = np.unpackbits(self.bits[a >> 3 : (b + 7) >> 3], bitorder="little")[lead : lead + b - a] == 1
        n = int(np.count_nonzero(more))
        if n:
            block = a // RANK_BITS
            head = np.unpackbits(self.bits[block * RANK_BITS // 8 : (a + 7) >> 3], bitorder="little")[: a - block * RANK_BITS]
            first = int(self.rank[block]) + int(head.sum())
            ids[more] |= unpack_run(self.level1, self.w1, first, first + n) << np.uint64(self.w0)
        return ids.astype(np.uint32)


#: The printable stand-ins that byte-level BPE models use for bytes: printable Latin-1 stays, others follow from 256 on.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


class _Known(dict):
    """Ids of words as they stand in a line: "w" follows a space, "\\nw" begins a line. Filled as they are met."""

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, self.line_end = self.tokenizer.model, self.whole("\n")
        self.marks = {c: self.whole(c) for c in ",.!|"}
        self.room = REMEMBERED

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def piece(self, p: str) -> bytes:
        """One space at most, then no white space."""
        word = p[1:] if p[0] == " " else p
        if word.isalpha():  # one pre-token, so the library's model takes it directly
            named = p.encode().decode("latin-1").translate(BYTE_NAMES)
            return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()
        if word[-1] in ",.!|" and word[:-1].isalpha():  # a letter and such a mark never share a pre-token
            return (self[word[:-1]] if p[0] == " " else self.piece(p[:-1])) + self.marks[word[-1]]
        return self.whole(p)

    def __missing__(self, key: str) -> bytes:
        ids = self.line_end + self.piece(key[1:]) if key[0] == "\n" else self.piece(" " + key)
        if self.room > 0:
            self[key] = ids
            self.room -= WORD_BYTES + len(key) + len(ids)
        return ids


def encoder(tokenizer_path: str):
    """texts -> bytes of each one's uint32 ids, equal to the tokenizer's own encoding of the whole text.

    A text is cut where no pre-token of a byte-level BPE goes across, and words that were seen are looked up: texts
    repeat most words. Texts with other or repeated white space are cut by the pattern PIECES.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    known = worker_state(tokenizer_path, lambda: _Known(tokenizer_path))
    skip = len(known.line_end)

    def ids_of(text: str) -> bytes:
        lines = "\n" + text
        if " " == text[-1:] or irregular(lines) or not text.isascii() and IRREGULAR.search(text):
            return b"".join([known.piece(p) if not p.isspace() else known.whole(p) for p in PIECES.findall(text)])
        return b"".join(map(known.__getitem__, lines.replace("\n", " \n").split(" ")[1:]))[skip:]

    return ids_of


def irregular(lines: str) -> bool:
    return "  " in lines or "\n\n" in lines or " \n" in lines or "\n " in lines or lines[-1] == "\n" or "\t" in lines or "\r" in lines or "\x0b" in lines or "\x0c" in lines


def _write(tokenizer_path: str, out: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, docs, lengths, ids = encoder(tokenizer_path), [], [], bytearray()
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            docs.append(b.column("doc_id").to_numpy())
            for a in range(0, b.num_rows, 256):
                for t in b.column("text").slice(a, 256).to_pylist():
                    before = len(ids)
                    ids += ids_of(t or "")
                    ids += end
                    lengths.append((len(ids) - before) // 4)
        if not lengths:
            return
        task = TaskContext.get()
        store, path = fs.FileSystem.from_uri(out)
        name, draft = f"{path}/part-{task.partitionId():06d}.dac", f"{path}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store.create_dir(path, recursive=True)
        with store.open_output_stream(draft) as f:
            for piece in encoded(np.concatenate(docs), np.array(lengths, dtype=np.int64), np.frombuffer(ids, dtype="<u4")):
                f.write(piece)
        store.move(draft, name)  # whole files only: a lost or repeated attempt leaves none or the same one
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "tokens": pa.array([len(ids) // 4], pa.int64()), "docs": pa.array([len(lengths)], pa.int64())})

    return run


def _read(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(out)
        for b in batches:
            for part, before in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{path}/part-{part:06d}.dac") as f:
                    file = DacFile(f.read())
                start = file.start.astype(np.int64)
                crc = [c for a, z in _runs(start) for c in _crcs(file, start[a : z + 1])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids), "start": pa.array(start[:-1] + before), "n_tokens": pa.array(np.diff(start)), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def _runs(start: np.ndarray, tokens: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `tokens` tokens, which one call of span decodes."""
    a = 0
    while a < len(start) - 1:
        z = max(a + 1, int(np.searchsorted(start, start[a] + tokens, "right")) - 1)
        yield a, z
        a = z


def _crcs(file: DacFile, start: np.ndarray) -> list[int]:
    first = int(start[0])
    data = memoryview(file.span(first, int(start[-1])).astype("<u4").tobytes())
    ends = ((start - first) * 4).tolist()
    return [zlib.crc32(data[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, parts: int = 0) -> DataFrame:
    """Encode every whole text, append `end_id`, and write the ids to `out` in ascending doc_id order, a file a range.

    Returns part, tokens, docs, and `before`: the tokens of all files before. A null text counts as empty; rows with a
    null doc_id have no place in the order and are left out; repeated doc_ids keep all their rows, ordered by text, and
    are dealt out by their texts' beginnings as well, so many rows of one doc_id make many files. A very long text is
    encoded whole within its task; other columns are not read; an empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(n, "doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(tidy(_write(tokenizer_path, out, end_id)), "part long, tokens long, docs long")
    sizes = sorted((r.part, r.tokens, r.docs) for r in made.collect())  # a row a file, no tokens
    before, table = 0, []
    for part, tokens, n_docs in sizes:
        table.append((part, tokens, n_docs, before))
        before += tokens
    files = spark.createDataFrame(table, "part long, tokens long, docs long, before long")
    return files.repartition(max(1, len(table)), "part") if table else files


def read_tokens(files: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32), read back from the files."""
    return files.select("part", "before").mapInArrow(tidy(_read(out)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_binary(docs: DataFrame, tokenizer_path: str, end_id: int = 0, out: str = "") -> DataFrame:
    """Write `docs` as DAC1 files (to the shared folder unless `out` names another) and read them back."""
    out = out or shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, tokenizer_path, out, end_id), out)
