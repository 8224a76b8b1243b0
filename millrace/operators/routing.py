"""Routing of rows: if/else outputs, fan-out and fan-in, and the choice of a routee."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.position import fresh, position


def if_else(df: DataFrame, p: Column | None = None, with_else: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(rows for the if outputs, rows for the else outputs). No predicate passes all; a null one fails. Without else
    outputs the rest is gone."""
    if p is None:
        return df, (df.limit(0) if with_else else None)
    ok = F.coalesce(p, F.lit(False))
    return df.where(ok), (df.where(~ok) if with_else else None)


def fan_out(df: DataFrame, outputs: list[str]) -> DataFrame:
    """A copy of each row for each output, named in the column `output`."""
    return df.withColumn("output", F.explode(F.array(*[F.lit(o) for o in outputs])))


def fan_in(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_errors(df: DataFrame, tried: Column, name: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with the value of a success, rows of failures with `error`): one bad row is routed aside, not fatal.

    `tried` is struct(value, error), as functions.values.attempt makes it. An error handler is any step on the second.
    """
    both = df.withColumn("tried", tried)
    failed = F.col("tried")["error"].isNotNull()
    good = both.where(~failed).withColumn(name, F.col("tried")["value"]).drop("tried")
    return good, both.where(failed).withColumn("error", F.col("tried")["error"]).drop("tried")


def dispatch(df: DataFrame, handlers: dict[str, Column], default: Column | None = None, kind: str = "payload_type", name: str = "handled") -> DataFrame:
    """The handler's value for the exact payload type, else the default's; without one such rows are ignored."""
    value = None
    for k, c in handlers.items():
        value = F.when(F.col(kind) == k, c) if value is None else value.when(F.col(kind) == k, c)
    if default is not None:
        return df.withColumn(name, default if value is None else value.otherwise(default))
    return df.where(F.col(kind).isin(list(handlers))).withColumn(name, value if value is not None else F.lit(None))


def round_robin(df: DataFrame, n: int, seq: str = "seq", name: str = "routee") -> DataFrame:
    """Routees in turn by arrival; the router has counted once before the first row, so that goes to 2 % n."""
    at = fresh(df, "at")
    return position(df, seq, name=at).withColumn(name, ((F.col(at) + 2) % n).cast("long")).drop(at)


def partition_by(df: DataFrame, key: Column, n: int, name: str = "routee") -> DataFrame:
    """abs(key) % n, in 64 bits so that the least int has a routee too; a null key has none."""
    return df.withColumn(name, (F.abs(key.cast("long")) % n).cast("long"))


def selected(requests: DataFrame, service: Column, routees: int, selection: str = "selection", seq: str = "seq", name: str = "ref") -> DataFrame:
    """What a discovery request is answered with: the service itself for ROUTED, one of its routees for any other, taken
    in turn over those requests (null where the service has none)."""
    routed = F.coalesce(F.col(selection) == "ROUTED", F.lit(False))
    whole = requests.where(routed).withColumn(name, service)
    turn = fresh(requests, "turn")
    direct = round_robin(requests.where(~routed), max(routees, 1), seq, turn)
    ref = F.concat_ws("-", service, F.col(turn).cast("string")) if routees else F.lit(None).cast("string")
    return whole.unionByName(direct.withColumn(name, ref).drop(turn))


def unrouted(df: DataFrame, name: str = "routee") -> tuple[DataFrame, DataFrame]:
    """(rows with a routee, dead letters)."""
    return df.where(F.col(name).isNotNull()), df.where(F.col(name).isNull())
