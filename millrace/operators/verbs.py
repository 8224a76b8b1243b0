"""Stream verbs over a DataFrame whose column `seq` gives the arrival order.

Verbs that depend on order take `seq`. What can be one value (the first failing place, a count) is one small action; the
frame itself is then filtered by a literal, which reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..functions.position import following, fresh, position


def _true(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _first_failing(df: DataFrame, p: Column, seq: str):
    return df.where(~_true(p)).agg(F.min(seq)).first()[0]


def take_while(df: DataFrame, p: Column, seq: str = "seq") -> DataFrame:
    """Rows before the first that fails `p`; a null predicate fails."""
    stop = _first_failing(df, p, seq)
    return df if stop is None else df.where(F.col(seq) < F.lit(stop))


def drop_while(df: DataFrame, p: Column, seq: str = "seq") -> DataFrame:
    """Rows from the first that fails `p`; none if all pass."""
    stop = _first_failing(df, p, seq)
    return df.limit(0) if stop is None else df.where(F.col(seq) >= F.lit(stop))


def keep(df: DataFrame, p: Column) -> DataFrame:
    return df.where(p)


def to(df: DataFrame, **columns: Column) -> DataFrame:
    """Map: one row for each row."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def flat(df: DataFrame, items: Column, name: str = "item", cast: str | None = None) -> DataFrame:
    """FlatMap: a row for each element of an array; none for empty and null arrays."""
    out = df.withColumn(name, F.explode(items))
    return out.withColumn(name, F.col(name).cast(cast)) if cast else out


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()


def ordered(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.orderBy(*by)


def limit(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return df.orderBy(seq).limit(n)


def skip(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """All but the first `n`: filtered by the place of each row, so that no task sorts everything."""
    return position(df, seq, name="_place").where(F.col("_place") >= n).drop("_place")


def peek(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, Observation]:
    """The frame unchanged, and what an action on it will have observed."""
    seen = Observation(name)
    return df.observe(seen, *measures), seen


def unordered(df: DataFrame, value: str, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, seq, before, value: the rows whose `value` is not above that of the row before them, of the same keys.

    A sequence is strictly increasing if it has none. A null is neither above nor below.
    """
    then = fresh(df, "then")
    rows = following(df, seq, keys, F.struct(F.col(seq).alias("at"), F.col(value).alias("value")), F.lit(True), then)
    broken = rows.where(F.col(then)["value"] <= F.col(value))
    return broken.select(*keys, F.col(then)["at"].alias(seq), F.col(value).alias("before"), F.col(then)["value"].alias("value"))


def collect(df: DataFrame, keys: list[str], **folds: Column) -> DataFrame:
    """Collect by keys into named aggregates: the built-in ones combine partial results before the shuffle."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()])


def for_each(df: DataFrame, fn: Callable[[Iterator[Row]], None]) -> None:
    df.foreachPartition(fn)


def rows(df: DataFrame, seq: str | None = None) -> Iterator[Row]:
    """Iterator of rows, a partition at a time on the driver."""
    return (df.orderBy(seq) if seq else df).toLocalIterator()


def to_array(df: DataFrame, value: Column, keys: list[str], seq: str = "seq", name: str = "items") -> DataFrame:
    """A bounded array per key, in order (for keys whose rows fit one row)."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def fold(df: DataFrame, aggregate: Column, identity, keys: list[str] | None = None, name: str = "value") -> DataFrame:
    """Reduce with an identity: `aggregate` is a built-in aggregate (associative, so partial sums combine)."""
    return df.groupBy(*(keys or [])).agg(F.coalesce(aggregate, F.lit(identity)).alias(name))


def reduced(df: DataFrame, aggregate: Column, keys: list[str] | None = None, name: str = "value") -> DataFrame:
    """Reduce without identity: null for an empty frame."""
    return df.groupBy(*(keys or [])).agg(aggregate.alias(name))


def extremes(df: DataFrame, value: str, by: str, keys: list[str]) -> DataFrame:
    """Rows' `value` at the least and at the greatest `by`; ties by the smaller value."""
    least, most = F.struct(F.col(by).alias("b"), F.col(value).alias("v")), F.struct(F.col(by).alias("b"), (-F.col(value)).alias("v"))
    return df.groupBy(*keys).agg(F.min(least)["v"].alias("at_min"), (-F.max(most)["v"]).alias("at_max"))


def matches(df: DataFrame, p: Column) -> DataFrame:
    """One row: any_match, all_match, none_match; an empty frame gives false, true, true."""
    hit, miss = F.coalesce(F.bool_or(_true(p)), F.lit(False)), F.coalesce(F.bool_and(_true(p)), F.lit(True))
    return df.agg(hit.alias("any_match"), miss.alias("all_match"), (~hit).alias("none_match"))


def find_first(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.orderBy(seq).limit(1)


def find_any(df: DataFrame) -> DataFrame:
    return df.limit(1)


def count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def sequential(df: DataFrame) -> DataFrame:
    """One partition: for small results only."""
    return df.coalesce(1)


def parallel(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def concat(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
