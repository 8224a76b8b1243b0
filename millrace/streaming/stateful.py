"""Stateful stream operators: count-triggered reduce, ask within a timeout, draining a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class CountReduce(StatefulProcessor):
    """Queues values by payload type; emits `fold(values by type)` whenever each type has its count. Within a batch rows
    are taken in `seq` order; what is left stays in state."""

    def __init__(self, rules: dict[str, int], fold: Callable[[dict[str, list]], Any]) -> None:
        self.rules, self.fold = rules, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queues = {k: handle.getListState(f"queue_{k}", "seq long, value string") for k in self.rules}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq")
        waiting = {k: [*map(tuple, q.get())] if q.exists() else [] for k, q in self.queues.items()}
        for r in new[new["payload_type"].isin(list(self.rules))].itertuples():
            waiting[r.payload_type].append((r.seq, r.value))
        done = min(len(w) // self.rules[k] for k, w in waiting.items())
        out = []
        for g in range(done):
            taken = {k: w[g * self.rules[k] : (g + 1) * self.rules[k]] for k, w in waiting.items()}
            out.append((*key, max(s for t in taken.values() for s, _ in t), self.fold({k: [v for _, v in t] for k, t in taken.items()})))
        for k, q in self.queues.items():
            left = waiting[k][done * self.rules[k] :]
            q.put(left) if left else q.clear()
        if out:
            yield pd.DataFrame(out, columns=["routee", "seq", "value"])

    def close(self) -> None:
        pass


def reduce_stream(df: DataFrame, rules: dict[str, int], fold: Callable[[dict[str, list]], Any]) -> DataFrame:
    """Streaming Reduce or Zip over (routee, payload_type, seq, value): a row (routee, seq, value) a group."""
    rows = df.select(F.col("routee").cast("long").alias("routee"), "payload_type", F.col("seq").cast("long").alias("seq"), F.col("value").cast("string").alias("value"))
    return rows.groupBy("routee").transformWithStateInPandas(CountReduce(rules, fold), "routee long, seq long, value string", "Append", "None")


def answered_stream(requests: DataFrame, replies: DataFrame, key: str, timeout: str, lateness: str = "1 hour") -> DataFrame:
    """Stream-stream form of ask: each request (key, request_at) with `reply_at`, the first of the replies (key, reply_at)
    that come within `timeout`; null if none does. Requests of one key at one time are one request."""
    a = requests.withWatermark("request_at", lateness).alias("a")
    b = replies.withWatermark("reply_at", lateness).alias("b")
    within = (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.expr(f"b.reply_at > a.request_at AND b.reply_at <= a.request_at + INTERVAL {timeout}")
    return a.join(b, within, "left").groupBy(F.col(f"a.{key}").alias(key), F.col("a.request_at")).agg(F.min("b.reply_at").alias("reply_at"))


def drain(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now, batch by batch, and end: queued messages first, then completion."""
    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
