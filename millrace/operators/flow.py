"""The named flow operators: Map, Reduce, Zip and Service."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.position import fresh, position


def rules_of(*kinds: str) -> dict[str, int]:
    """Multiplicities of a list of payload types."""
    out: dict[str, int] = {}
    for k in kinds:
        out[k] = out.get(k, 0) + 1
    return out


def checked(rules: dict[str, int]) -> dict[str, int]:
    if not rules or any(n <= 0 for n in rules.values()):
        raise ValueError("every payload type needs a count above 0")
    return rules


class Operator:
    """Base of custom operators: rows in, rows out."""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Map(Operator):
    """Each row to the rows of `items` (an array Column), to named `columns`, or through `fn` for any DataFrame form."""

    def __init__(self, fn: Callable[[DataFrame], DataFrame] | None = None, items: Column | None = None, name: str = "item", where: Column | None = None, **columns: Column) -> None:
        self.fn, self.items, self.name, self.where, self.columns = fn, items, name, where, columns

    def transform(self, df: DataFrame) -> DataFrame:
        if self.where is not None:
            df = df.where(self.where)
        if self.items is not None:
            df = df.withColumn(self.name, F.explode(self.items))
        if self.columns:
            df = df.withColumns(self.columns)
        return self.fn(df) if self.fn else df


class Reduce(Operator):
    """Count-triggered fold: as soon as `rules[type]` rows of every type are queued, they are taken first-in first-out
    and folded by `folds` (named aggregates over the group's rows, `payload_type`, `seq` and `slot` among the columns).

    State is per routee. Rows of other types are dropped; rows of incomplete groups stay queued and give nothing.
    """

    def __init__(self, rules: dict[str, int], folds: dict[str, Column], kind: str = "payload_type", seq: str = "seq", routee: Iterable[str] = ()) -> None:
        self.rules, self.folds, self.kind, self.seq, self.routee = checked(rules), folds, kind, seq, list(routee)
        self.queue, self.full = [*self.routee], sum(rules.values())

    def sized(self, df: DataFrame, name: str) -> DataFrame:
        """Rows of configured types with `name`, the rows of their type in a group."""
        size = F.create_map(*[F.lit(x) for k, n in self.rules.items() for x in (k, n)])
        return df.where(F.col(self.kind).isin(list(self.rules))).withColumn(name, size[F.col(self.kind)])

    def grouped(self, df: DataFrame) -> DataFrame:
        """Rows of configured types with `group` and `slot`, the place in the group within its type."""
        n, at = fresh(df, "n_"), fresh(df, "at_")
        rows = position(self.sized(df, n), self.seq, [*self.routee, self.kind], name=at)
        return rows.withColumn("group", F.floor(F.col(at) / F.col(n)).cast("long")).withColumn("slot", (F.col(at) % F.col(n)).cast("long")).drop(at, n)

    def transform(self, df: DataFrame) -> DataFrame:
        folded = self.grouped(df).groupBy(*self.queue, "group").agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in self.folds.items()])
        return folded.where(F.col("_rows") == self.full).drop("_rows")

    def leftover(self, df: DataFrame) -> DataFrame:
        """Rows of configured types that no group took."""
        rows = self.grouped(df)
        done = rows.groupBy(*self.queue, "group").agg(F.count("*").alias("_rows")).where(F.col("_rows") == self.full)
        done = done.select(*[F.col(k).alias(f"_r_{k}") for k in self.queue], F.col("group").alias("_g"))
        same = F.col("group") == F.col("_g")
        for k in self.queue:
            same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return rows.join(done, same, "left_anti")


class ReduceEach(Reduce):
    """Reduce of every type on its own, `n` rows a group: all types in one pass."""

    def __init__(self, n: int, folds: dict[str, Column], kind: str = "payload_type", seq: str = "seq", routee: Iterable[str] = ()) -> None:
        super().__init__({"": n}, folds, kind, seq, routee)
        self.queue = [*self.routee, kind]

    def sized(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.lit(self.full))


class Zip(Reduce):
    """Positional combination: one output for `rules[type]` rows of every type."""


class Service(Operator):
    """Enrichment: a row becomes requests, each request meets the replies of a service by key, each reply becomes rows.

    `requests` is an array Column (one request if None), `service` the service's replies, joined on `on`; rows without a
    reply give nothing unless `how` is "left". `responses` is an array Column over the joined row.
    """

    def __init__(self, service: DataFrame, on: Callable[[DataFrame, DataFrame], Column], requests: Column | None = None, responses: Column | None = None, how: str = "inner") -> None:
        self.service, self.on, self.requests, self.responses, self.how = service, on, requests, responses, how

    def transform(self, df: DataFrame) -> DataFrame:
        asked = df if self.requests is None else df.withColumn("request", F.explode(self.requests))
        answered = asked.join(self.service, self.on(asked, self.service), self.how)
        return answered if self.responses is None else answered.withColumn("response", F.explode(self.responses))
