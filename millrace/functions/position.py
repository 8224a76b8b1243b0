"""Positions, running totals and the next row per key, in an order, without one task holding a whole key.

A window over a key sorts all its rows in one task. Here the order is cut into pieces that hold about equally many rows,
by quantiles of the order column; rows are summed within (key, piece), the pieces' totals are summed over the pieces,
and both are added. A key that holds a third of all rows is a third of `pieces` tasks' work, however its values lie.
The input row travels as one struct, so its columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 256


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    while stem in df.columns:
        stem += "_"
    return stem


def _numeric(df: DataFrame, order: str) -> Column:
    kind = dict(df.dtypes)[order]
    along = F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(order)
    return along.cast("double")


def in_pieces(df: DataFrame, order: str, keys: Sequence[str] = (), ties: Sequence[str] = (), pieces: int = PIECES, **more: Column) -> DataFrame:
    """(row, key, piece, o, t0, t1, .., and `more`): `piece` numbers the quantile of `order`, -1 for nulls.

    Equal values share a piece. The cut points are approximate quantiles: one aggregate, `pieces` numbers on the driver.
    """
    along = _numeric(df, order)
    shares = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(along, shares or [0.5], 10_000)).first()[0] or []
    cuts = sorted({x for x in found if x == x and abs(x) != float("inf")})
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.struct(*[F.col(f"`{k}`") for k in keys] or [F.lit(0).alias("all")]).alias("key"),
        F.coalesce(along, F.lit(0.0)).alias("v"),
        F.col(f"`{order}`").alias("o"),
        *[F.col(f"`{t}`").alias(f"t{i}") for i, t in enumerate(ties)],
        *[c.alias(n) for n, c in more.items()],
    )
    rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="v", outputCol="b", handleInvalid="keep").transform(rows) if cuts else rows.withColumn("b", F.lit(0.0))
    return rows.withColumn("piece", F.when(F.col("o").isNull(), -1).otherwise(F.col("b").cast("int"))).drop("v", "b")


def running_totals(df: DataFrame, order: str, keys: Sequence[str], weights: dict[str, Column], ties: Sequence[str] = (), pieces: int = PIECES) -> DataFrame:
    """`df` with, by name, the sum of each weight over the rows of the same keys that come before in `order`, then `ties`.

    `order` is a number, date or timestamp; its nulls come first. Null keys make a key of their own. Rows that agree in
    order and ties come in any order. An empty frame stays empty. A name that `df` has is replaced.
    """
    names = list(weights)
    rows = in_pieces(df, order, keys, ties, pieces, **{f"w{i}": weights[n] for i, n in enumerate(names)})
    sums = rows.groupBy("key", "piece").agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(names))])
    earlier = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("key").alias("k"), F.col("piece").alias("p"), *[F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"start{i}") for i in range(len(names))])
    within = Window.partitionBy("key", "piece").orderBy("o", *[f"t{i}" for i in range(len(ties))]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"in{i}": F.coalesce(F.sum(f"w{i}").over(within), F.lit(0)) for i in range(len(names))})
    joined = rows.join(starts, (F.col("key") == F.col("k")) & (F.col("piece") == F.col("p")))
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in names], *[(F.col(f"start{i}") + F.col(f"in{i}")).alias(n) for i, n in enumerate(names)])


def running_total(df: DataFrame, order: str, keys: Sequence[str] = (), weight: Column | None = None, name: str = "before", ties: Sequence[str] = (), pieces: int = PIECES) -> DataFrame:
    """running_totals of one weight, 1 for each row if none is given."""
    return running_totals(df, order, keys, {name: F.lit(1).cast("long") if weight is None else weight}, ties, pieces)


def position(df: DataFrame, order: str, keys: Sequence[str] = (), name: str = "position", ties: Sequence[str] = (), pieces: int = PIECES) -> DataFrame:
    """`df` with the 0-based place of each row among those of the same keys."""
    return running_total(df, order, keys, None, name, ties, pieces)


def following(df: DataFrame, order: str, keys: Sequence[str], value: Column, among: Column, name: str, ties: Sequence[str] = (), pieces: int = PIECES) -> DataFrame:
    """`df` with `value` (a struct) of the next row of the same keys for which `among` holds; null after the last.

    The next one within (key, piece) is found there; else it is the first of the nearest later piece that has any, which
    a table of a row a (key, piece) carries back.
    """
    rows = in_pieces(df, order, keys, ties, pieces, x=F.when(among, value))
    place = [F.col("o"), *[F.col(f"t{i}") for i in range(len(ties))]]
    back = [c.desc() for c in place]
    firsts = rows.groupBy("key", "piece").agg(F.min_by("x", F.when(F.col("x").isNotNull(), F.struct(*[c.isNotNull() for c in place], *place))).alias("first"))
    later = Window.partitionBy("key").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(F.col("key").alias("k"), F.col("piece").alias("p"), F.last("first", ignorenulls=True).over(later).alias("later"))
    within = Window.partitionBy("key", "piece").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("here", F.last("x", ignorenulls=True).over(within)).join(carried, (F.col("key") == F.col("k")) & (F.col("piece") == F.col("p")))
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != name], F.coalesce("here", "later").alias(name))
