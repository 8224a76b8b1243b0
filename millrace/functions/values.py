"""Name-based ids, safe values with an error beside them, delivery statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The delivery statuses of the message contract.
SENT, NOT_SENT = "SENT", "NOT_SENT"
DELIVERED, DELIVERED_NO_RESCHEDULE, NOT_DELIVERED = "DELIVERED", "DELIVERED_BUT_DO_NO_RESCHED", "NOT_DELIVERED"
BACKPRESSURE_REQUIRED = "BACKPRESSURE_REQUIRED"
SEVERITY = [SENT, DELIVERED, DELIVERED_NO_RESCHEDULE, BACKPRESSURE_REQUIRED, NOT_SENT, NOT_DELIVERED]


def name_uuid(name: Column) -> Column:
    """Version 3 UUID of a name: md5 with the version and variant bits set (RFC 4122, without a namespace)."""
    h = F.md5(name.cast("binary"))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab89ab89ab89ab"), nibble + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_delivered(status: Column) -> Column:
    """Whether the message reached a mailbox; a backpressured message is accepted and buffered."""
    return status.isin(DELIVERED, DELIVERED_NO_RESCHEDULE, BACKPRESSURE_REQUIRED)


def is_sent(status: Column) -> Column:
    return is_delivered(status) | (status == SENT)


def worst(status: Column) -> Column:
    """Aggregate: the most severe status of a group (one backpressured subscriber slows the publisher)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status)
    return F.max_by(status, rank)


def attempt(value: Column, error: Column | str) -> Column:
    """struct(value, error): `error` where `value` is null, else no error."""
    message = F.lit(error) if isinstance(error, str) else error
    return F.struct(value.alias("value"), F.when(value.isNull(), message).alias("error"))


def mapped(tried: Column, fn) -> Column:
    """`fn` of the value of a success; a failure stays. A null result is a failure of its own."""
    value = fn(tried["value"])
    return F.struct(F.when(tried["error"].isNull(), value).alias("value"), F.coalesce(tried["error"], F.when(value.isNull(), F.lit("mapping failed"))).alias("error"))


def recovered(tried: Column, other: Column, when_error: str | None = None) -> Column:
    """Value of a success, else `other` (for errors that match the pattern `when_error`, if given)."""
    fits = F.lit(True) if when_error is None else tried["error"].rlike(when_error)
    return F.when(tried["error"].isNull(), tried["value"]).when(fits, other)


def channel_parts(channel: Column) -> tuple[Column, Column]:
    """(type, name) of a channel id `TYPE@name`."""
    return F.substring_index(channel, "@", 1), F.regexp_extract(channel, "@(.*)$", 1)


def full_match(value: Column, pattern: str) -> Column:
    """Whether the whole value matches."""
    return value.rlike(f"^(?:{pattern})$")
