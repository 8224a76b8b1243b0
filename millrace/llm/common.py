"""Helpers shared by the operators: shared-folder tables, byte hashing, native word and line expressions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
#: Text bytes that one vectorised step takes; a longer document makes a step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or, in local mode, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage then starts at files that outlive executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_ids(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Up to `n` distinct keys, the first by hash: of a size that may be broadcast whatever the table holds."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(n)


def let(value: Column, fn) -> Column:
    """Bind `value` to a name inside one expression, so that it is evaluated once however often `fn` uses it."""
    return F.transform(F.array(value), fn)[0]


def words(text: Column) -> Column:
    """Words `[^\x20\x09-\x0D]+` of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS_CLASS + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def worker_state(key: str, make):
    """What `make` returns, once in the life of a Python worker: tasks that follow in it find it again."""
    holder = sys.modules.setdefault("_millrace_worker", types.ModuleType("_millrace_worker"))
    if key not in holder.__dict__:
        holder.__dict__[key] = make()
    return holder.__dict__[key]


def tidy(run):
    """`run` for mapInArrow, after whose task freed memory goes back to the system: the worker waits for others' tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError):  # other C libraries have none
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    table = worker_state("powers", dict)
    if len(table.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, STEP_BYTES + 1024), base, dtype=np.uint64)
            a[0] = 1
            table[name] = np.multiply.accumulate(a)
    return table["up"][:n], table["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = the polynomial of data[i:j], scaled by base**i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


_IS_WORD = np.zeros(256, dtype=np.int8)
_IS_WORD[[c for c in range(256) if c >= 128 or chr(c).isalnum() or c == 95]] = 1


def steps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about STEP_BYTES."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > STEP_BYTES:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased texts, and where each text's words begin.

    A word is a run of ASCII letters, digits, underscores and non-ASCII bytes.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    flags = np.zeros(len(data) + 1, dtype=np.int8)
    flags[1:] = _IS_WORD[data]
    edge = np.diff(flags)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = prefix_hash(data)
    hashes = mix((sums[ends] - sums[starts]) * powers(len(data))[1][starts])
    text_at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_at[1:])
    return hashes, np.searchsorted(starts, text_at)


def lowered(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.lower().encode() for t in column.to_pylist()]


def window_hashes(hashes: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Order-aware hash of the words at i + offsets, for every i where all are there."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for o in offsets:
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[o : o + n]
    return mix(out)
