"""Messages between actors: subscriptions, copies, requests and replies, acknowledgements, dead letters, mailboxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.position import following, fresh, position, running_totals
from ..functions.values import BACKPRESSURE_REQUIRED, DELIVERED, NOT_DELIVERED


def normalized_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """(subscriber, payload_type, policy): one row a type, FULL over LOCAL."""
    rank = F.when(F.col("policy") == "FULL", 1).otherwise(0)
    return subscriptions.groupBy("subscriber", "payload_type").agg(F.max_by("policy", rank).alias("policy"))


#: Rows that may ride along in a plan as one array.
FEW = 1_000
BINS = 256


def _few(df: DataFrame) -> list | None:
    """The rows, if there are at most FEW."""
    rows = df.limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def fan_out_to_subscribers(messages: DataFrame, subscribers: DataFrame, seq: str = "seq") -> DataFrame:
    """A copy of each message for each subscriber (subscriber, joined_at, left_at) that is there when it is sent.

    Late subscribers have no history. Few subscribers ride along as one array in each row, so rows that nobody sees are
    gone before the explode; many meet the messages by bins of the order: a subscriber is in every bin that it spans.
    """
    there = lambda at, joined, left: (at >= joined) & (left.isNull() | (at < left))
    few = _few(subscribers.select("subscriber", "joined_at", "left_at"))
    row = F.struct(*[F.col(f"`{c}`") for c in messages.columns if c != "subscriber"]).alias("row")
    if few is not None:
        listed = [F.struct(F.lit(s.subscriber).alias("subscriber"), F.lit(s.joined_at).alias("joined_at"), F.lit(s.left_at).cast("long").alias("left_at")) for s in few]
        if not listed:
            return messages.limit(0).withColumn("subscriber", F.lit(None).cast("string"))
        seen = messages.select(row, F.explode(F.filter(F.array(*listed), lambda s: there(F.col(seq), s["joined_at"], s["left_at"]))).alias("s"))
        return seen.select("row.*", "s.subscriber")
    low, high = messages.agg(F.min(seq), F.max(seq)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // BINS))
    bin_of = lambda c: F.least(F.greatest(F.floor((c - F.lit(low or 0)) / width), F.lit(0)), F.lit(BINS - 1)).cast("int")
    spans = F.sequence(bin_of(F.col("joined_at")), F.greatest(bin_of(F.col("joined_at")), bin_of(F.coalesce(F.col("left_at"), F.lit(high or 0)))))
    held = subscribers.select("subscriber", "joined_at", "left_at", F.explode(spans).alias("bin"))
    met = messages.select(row, F.col(seq).alias("at"), bin_of(F.col(seq)).alias("b")).join(held, F.col("b") == F.col("bin"))
    return met.where(there(F.col("at"), F.col("joined_at"), F.col("left_at"))).select("row.*", "subscriber")


def subscriber_copies(messages: DataFrame, subscriptions: DataFrame, sniffed: Column | None = None) -> DataFrame:
    """Copies of published messages for typed subscribers, the message's own destination left out.

    `sniffed` marks messages that were seen on a channel but meant for another system: only FULL subscribers get those.
    """
    subs = normalized_subscriptions(subscriptions).withColumnRenamed("payload_type", "_type")
    copies = messages.join(subs, messages["payload_type"] == subs["_type"]).where(~F.col("destination").eqNullSafe(F.col("subscriber")))
    if sniffed is not None:
        copies = copies.where(~F.coalesce(sniffed, F.lit(False)) | (F.col("policy") == "FULL"))
    return copies.drop("_type")


def published(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """publish: the direct delivery and the subscribers' copies; `tell` is the direct delivery alone."""
    direct = messages.withColumn("receiver", F.col("destination"))
    copies = subscriber_copies(messages, subscriptions).withColumn("receiver", F.col("subscriber")).drop("subscriber", "policy")
    return direct.unionByName(copies)


def replied(messages: DataFrame) -> DataFrame:
    """reply: to the sender of the last message."""
    return messages.withColumns({"sender": F.col("destination"), "destination": F.col("sender")})


def ask_in_turn(messages: DataFrame, keys: list[str], seq: str, is_request: Column, is_reply: Column, reply: Column) -> DataFrame:
    """Requests with the reply that directly follows in their conversation, if it is one (status answered), else null."""
    then = fresh(messages, "then")
    rows = following(messages, seq, keys, F.struct(F.coalesce(is_reply, F.lit(False)).alias("ok"), reply.alias("reply")), F.lit(True), then)
    asked = rows.where(is_request).withColumn("reply", F.when(F.col(then)["ok"], F.col(then)["reply"])).drop(then)
    return asked.withColumn("status", F.when(F.col("reply").isNotNull(), "answered").otherwise("timeout"))


def ask_within(messages: DataFrame, key: str, at: str, is_request: Column, is_reply: Column, reply: str, timeout: str, ties: str) -> DataFrame:
    """Requests with the first reply of the same key after them and within `timeout` (an interval), else a timeout.

    Requests and replies are never paired: each request finds the next reply in order, piece by piece of a key's time.
    """
    then = fresh(messages, "then")
    rows = following(messages.where(is_request | is_reply), at, [key], F.struct(F.col(at).alias("at"), F.col(reply).alias("id")), is_reply, then, [ties])
    intime = F.col(then)["at"] <= F.col(at) + F.expr(f"INTERVAL {timeout}")
    rows = rows.where(is_request).withColumn("reply_id", F.when(intime, F.col(then)["id"])).drop(then)
    return rows.withColumn("status", F.when(F.col("reply_id").isNotNull(), "answered").otherwise("timeout"))


def acknowledged(sent: DataFrame, acks: DataFrame, key: str) -> DataFrame:
    """Sent messages with `status`: DELIVERED if any ack names them, else NOT_DELIVERED (expired)."""
    named = acks.select(F.col(key).alias("_k")).distinct()
    return sent.join(named, F.col(key) == F.col("_k"), "left").withColumn("status", F.when(F.col("_k").isNotNull(), DELIVERED).otherwise(NOT_DELIVERED)).drop("_k")


def dead_letters(messages: DataFrame, registered: DataFrame, destination: str, actor: str) -> DataFrame:
    """Messages whose destination nobody registered; a null destination is nobody."""
    return messages.join(registered.select(F.col(actor).alias("_a")), F.col(destination) == F.col("_a"), "left_anti")


def drained_by_priority(messages: DataFrame, rank: str, seq: str = "seq", name: str = "position") -> DataFrame:
    """Priority mailbox: the place at which each message leaves it, by `rank` (a small whole number), then arrival.

    Counts of the ranks say where each rank begins; places within a rank are taken piece by piece.
    """
    starts = messages.groupBy(F.col(rank).alias("r")).agg(F.count("*").alias("n"))  # a row a rank
    starts = starts.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = position(messages.select(F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"), F.col(rank).alias("rank"), F.col(seq).alias("o")), "o", ["rank"], "place")
    placed = placed.join(starts, F.col("rank").eqNullSafe(F.col("r")))
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in messages.columns if c != name], (F.col("start") + F.col("place")).alias(name))


def coalesced_by_type(messages: DataFrame, payload: str, kind: str = "payload_type", seq: str = "seq") -> DataFrame:
    """Type-coalescing mailbox: the latest message of each type, first_seq giving the order in which types drain."""
    return messages.groupBy(kind).agg(F.max_by(payload, seq).alias(payload), F.min(seq).alias("first_seq"), F.max(seq).alias(seq))


def bounded(messages: DataFrame, capacity: int, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) of a bounded mailbox that is not drained meanwhile: the first `capacity` fit."""
    at = fresh(messages, "at")
    placed = position(messages, seq, name=at)
    return placed.where(F.col(at) < capacity).drop(at), placed.where(F.col(at) >= capacity).drop(at)


def credited(messages: DataFrame, credits: DataFrame, threshold: int, regulated: Column, jumps: Column, seq: str = "seq", initial: int = 0) -> DataFrame:
    """Status of each message at a backpressuring mailbox, while credits (seq, n) arrive between messages.

    A message that jumps is delivered at once and counts for nothing. Any other is delivered if a credit is left when it
    arrives and nothing waits, else it is buffered, first in first out; it takes a credit with it if it is regulated,
    while one that is not only needs that some credit is left. A buffered message has the status BACKPRESSURE_REQUIRED
    (accepted, and the publisher is told to slow down) if with it `threshold` messages wait, else DELIVERED; `waiting` is
    their number.

    A message leaves once more credits have come than regulated messages stand before it. So with K credits so far, all
    up to the K-th regulated message are gone; its place, met by the number K, gives the number that wait.
    """
    regulated = F.coalesce(regulated, F.lit(False))
    own = F.col("own")
    rows = messages.select(F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"), F.col(seq).alias("o"), F.lit(1).alias("own"), F.coalesce(jumps, F.lit(False)).alias("jump"), regulated.alias("pays"), F.lit(0).cast("long").alias("n"))
    came = credits.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("seq").alias("o"), F.lit(0).alias("own"), F.lit(False).alias("jump"), F.lit(False).alias("pays"), F.col("n").cast("long").alias("n"))
    queued = (own == 1) & ~F.col("jump")
    weights = {"credit": F.col("n"), "place": queued.cast("long"), "before": (queued & F.col("pays")).cast("long")}
    both = running_totals(rows.union(came), "o", [], weights, ["own"])
    both = both.withColumn("credit", F.col("credit") + initial)
    nth = both.where(queued & F.col("pays")).select((F.col("before") + 1).alias("nth"), F.col("place").alias("gone"))
    sent = both.where(own == 1).join(nth, F.col("credit") == F.col("nth"), "left")
    waits = ~F.col("jump") & (F.col("credit") <= F.col("before"))
    waiting = F.when(waits, F.col("place") - F.coalesce(F.col("gone"), F.lit(-1))).otherwise(0)
    status = F.when(waits & (waiting >= threshold), BACKPRESSURE_REQUIRED).otherwise(DELIVERED)
    return sent.select("row.*", waiting.cast("long").alias("waiting"), status.alias("status"))


def by_validity(messages: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Copies for subscriptions that change while messages flow: (subscriber, payload_type, at, action), action `set`
    (this type replaces all of the subscriber's), `add` or `remove`. A change holds from its place on, until the next
    change of the subscriber that sets, or that names the type.

    Each change becomes one row with the place where it ends, so a message meets the rows of its type alone.
    """
    later = Window.partitionBy("subscriber").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("subscriber", "payload_type").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.least(F.min(F.when(F.col("action") == "set", F.col("at"))).over(later), F.min("at").over(same))
    held = changes.withColumn("until", ends).where("action <> 'remove'").select("subscriber", F.col("payload_type").alias("_type"), "at", "until")
    there = (F.col(seq) >= F.col("at")) & (F.col("until").isNull() | (F.col(seq) < F.col("until")))
    return messages.join(held, messages["payload_type"] == held["_type"]).where(there).drop("_type", "at", "until")


def received(messages: DataFrame, system: str, origin: Column, target: Column, is_ack: Column) -> DataFrame:
    """What a system does with a message from a channel (column `action`): its own are dropped, acks to it complete a
    pending send, messages to it are delivered, others are only sniffed for typed subscribers."""
    action = F.when(origin == system, "own").when(is_ack & (target == system), "ack").when(target == system, "deliver").otherwise("sniff")
    return messages.withColumn("action", action)


def broadcast_scope(messages: DataFrame, gates: DataFrame, scope: str, channel: str | None = None, local: str = "local") -> DataFrame:
    """A copy a gate (gate, kind) in the scope: `local` the loopback gate, `remote` all others, `all` every gate of a channel."""
    chosen = {"local": F.col("kind") == local, "remote": F.col("kind") != local, "all": F.col("channel") == channel}[scope]
    names = gates.where(chosen).select("gate").distinct()
    few = _few(names)
    if few is not None:
        if not few:
            return messages.limit(0).withColumn("gate", F.lit(None).cast("string"))
        return messages.withColumn("gate", F.explode(F.array(*[F.lit(r.gate) for r in sorted(few)])))
    # lists of about FEW gates each, met by their number
    n = -(-names.count() // FEW)
    lists = names.groupBy(F.pmod(F.xxhash64("gate"), F.lit(n)).cast("int").alias("list")).agg(F.collect_list("gate").alias("gates"))
    row = F.struct(*[F.col(f"`{c}`") for c in messages.columns if c != "gate"]).alias("row")
    dealt = messages.select(row, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    return dealt.join(lists, F.col("part") == F.col("list")).select("row.*", F.explode("gates").alias("gate"))
