"""Service discovery, routes between systems, and replay of recorded messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import full_match


def discovered(registry: DataFrame, name: Column, wanted: str, load: Column | None = None, load_range: tuple[float, float] | None = None, host: Column | None = None, host_pattern: str | None = None, channel: Column | None = None, channels: list[str] | None = None, closed: bool = True) -> DataFrame:
    """Services that meet every criterion that is set. The name is required; an absent property meets any criterion
    on load or host; no channels mean any."""
    keep = name == wanted
    if load is not None and load_range is not None:
        inside = load.between(*load_range) if closed else (load > load_range[0]) & (load < load_range[1])
        keep = keep & (load.isNull() | inside)
    if host is not None and host_pattern is not None:
        keep = keep & (host.isNull() | full_match(host, host_pattern))
    if channel is not None and channels:
        keep = keep & channel.isin(channels)
    return registry.where(keep)


def property_of(properties: Column, key: str) -> Column:
    """A service's property by its key, null where it has none. `properties` is a map."""
    return F.try_element_at(properties, F.lit(key))


def resolved(wanted: DataFrame, services: DataFrame, name: str, known_as: str) -> DataFrame:
    """The services of a list of names; names that nobody has are left out."""
    return wanted.join(services, F.col(name) == F.col(known_as))


def duplicated(registered: DataFrame, name: str) -> DataFrame:
    """Names that are registered more than once, with their number `n`."""
    return registered.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def random_gate(gates: DataFrame, keys: list[str], gate: str, seed: int = 1) -> DataFrame:
    """keys and one of their gates, each as likely: the one with the least hash of seed, keys and gate. Reruns agree."""
    lot = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col(gate).cast("string")))
    return gates.groupBy(*keys).agg(F.min_by(gate, lot).alias(gate))


def latest(records: DataFrame, keys: list[str], seq: str, removed: Column) -> DataFrame:
    """Upserts and removals (tombstones) to the records that stand: the last of each key, unless it removes."""
    whole = F.struct(*[c for c in records.columns if c not in keys])
    last = records.withColumn("_removed", removed).groupBy(*keys).agg(F.max_by(F.struct("_removed", whole.alias("_row")), seq).alias("_last"))
    return last.where(~F.coalesce(F.col("_last._removed"), F.lit(False))).select(*keys, "_last._row.*")


def with_route(services: DataFrame, gates: DataFrame, system: str, preferred: Column) -> DataFrame:
    """Services with the route of their system over the preferred channel, else over its first channel by name.

    `gates` has gate_system, channel and route.
    """
    any_ = gates.groupBy("gate_system").agg(F.min_by("route", "channel").alias("_any"))
    exact = gates.select(F.col("gate_system").alias("_s"), F.col("channel").alias("_c"), F.col("route").alias("_exact"))
    wanted = services.withColumn("_wanted", preferred)
    found = wanted.join(exact, (wanted[system] == F.col("_s")) & (F.col("_wanted") == F.col("_c")), "left").join(any_, wanted[system] == F.col("gate_system"), "left")
    return found.withColumn("route", F.coalesce("_exact", "_any")).drop("_wanted", "_s", "_c", "_exact", "_any", "gate_system")


def replayed(log: DataFrame, executions: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Recorded messages in the order in which they were executed; messages never executed stay out."""
    return log.join(executions, keys).orderBy(at)


def missing_messages(log: DataFrame, executions: DataFrame, keys: list[str]) -> DataFrame:
    """Executions whose message is not in the log: noted and skipped by a replay."""
    return executions.join(log, keys, "left_anti")
