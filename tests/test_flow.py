import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.position import in_pieces, position, running_total
from millrace.functions.values import attempt, is_delivered, mapped, name_uuid, recovered, worst
from millrace.operators import discovery, messaging, routing, statistics, verbs
from millrace.operators.flow import Map, Reduce, ReduceEach, Service, Zip, checked, rules_of
from millrace.plans.graph import FlowGraph

SEQ = "seq long, payload_type string, routee long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_position_spreads_a_hot_key(spark):
    data = [(i, "hot" if i % 3 else None) for i in random.Random(1).sample(range(3000), 3000)]
    out = position(spark.createDataFrame(data, "seq long, k string"), "seq", ["k"], pieces=7)
    got = {r.seq: r.position for r in out.collect()}
    for key in ("hot", None):
        assert [got[s] for s in sorted(s for s, k in data if k == key)] == list(range(sum(k == key for _, k in data)))


def test_running_total_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([], "seq long, v double")
    assert running_total(empty, "seq", name="b").collect() == []
    same = spark.createDataFrame([(5, 1.0), (5, 1.0)], "seq long, v double")
    assert sorted(r.position for r in position(same, "seq").collect()) == [0, 1]


def simulate(messages, rules):
    """Count-triggered groups, message by message."""
    queues, out = {}, []
    for seq, kind, routee in sorted(messages):
        if kind not in rules:
            continue
        q = queues.setdefault(routee, {k: [] for k in rules})
        q[kind].append(seq)
        if all(len(q[k]) >= n for k, n in rules.items()):
            out.append((routee, tuple(sorted(s for k, n in rules.items() for s in q[k][:n]))))
            for k, n in rules.items():
                del q[k][:n]
    return sorted(out)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 1)), max_size=40), st.sampled_from([{"A": 2}, {"A": 2, "B": 1}, {"A": 1, "B": 1}]))
def test_reduce_equals_message_by_message(spark, kinds, rules):
    messages = [(i, k, r) for i, (k, r) in enumerate(kinds)]
    df = spark.createDataFrame(messages, SEQ)
    op = Reduce(rules, {"s": F.sort_array(F.collect_list("seq"))}, routee=["routee"])
    assert sorted((r.routee, tuple(r.s)) for r in op.transform(df).collect()) == simulate(messages, rules)
    used = {s for _, g in simulate(messages, rules) for s in g}
    assert {r.seq for r in op.leftover(df).collect()} == {i for i, k, _ in messages if k in rules} - used


def test_rules_are_checked():
    assert rules_of("a", "b", "a") == {"a": 2, "b": 1}
    for bad in ({}, {"a": 0}, {"a": 1, "b": -1}):
        with pytest.raises(ValueError):
            checked(bad)


def test_reduce_each_and_zip(spark):
    df = spark.createDataFrame([(i, "AB"[i % 2], 0) for i in range(11)], SEQ)
    assert sorted(r.n for r in ReduceEach(2, {"n": F.count("*")}).transform(df).collect()) == [2] * 5
    assert Zip({"A": 1, "B": 1}, {"n": F.count("*")}).transform(df).count() == 5


def test_if_else_partitions_nulls_too(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    yes, no = routing.if_else(df, F.col("v") > 0)
    assert (yes.count(), no.count()) == (1, 2)
    assert routing.if_else(df, F.col("v") > 0, with_else=False)[1] is None
    assert routing.if_else(df)[0].count() == 3


def test_partition_by_takes_the_least_int_and_drops_null(spark):
    df = spark.createDataFrame([(-(2**31),), (-5,), (None,)], "k int")
    good, dead = routing.unrouted(routing.partition_by(df, F.col("k"), 3))
    assert sorted(r.routee for r in good.collect()) == [2, 2] and dead.count() == 1


def test_round_robin_starts_at_two(spark):
    out = routing.round_robin(spark.createDataFrame([(i,) for i in range(4)], "seq long"), 3)
    assert [r.routee for r in out.orderBy("seq").collect()] == [2, 0, 1, 2]


def test_dispatch_ignores_or_defaults(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "payload_type string, v int")
    assert rows(routing.dispatch(df, {"a": F.col("v") * 10}).select("handled")) == [(10,)]
    assert rows(routing.dispatch(df, {"a": F.col("v") * 10}, F.lit(0)).select("handled")) == [(0,), (10,)]


def test_graph_routes_by_name(spark):
    source = spark.createDataFrame([(i, i % 3) for i in range(9)], "seq long, v long")
    g = FlowGraph().add("in", Map(v=F.col("v") + 1), [source], ["big"], F.col("v") > 2, ["small"])
    g.add("big", Map(), outputs=["end"]).add("small", Map(where=F.col("v") > 1), outputs=["end"]).add("end", Map())
    done = g.build()
    assert (done["big"].count(), done["small"].count(), done["end"].count()) == (3, 3, 6)


def test_graph_rejects_mistakes(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        FlowGraph().add("a", Map(), [df]).add("a", Map())
    with pytest.raises(ValueError):
        FlowGraph().add("a", Map(), [df], ["nowhere"]).build()
    with pytest.raises(ValueError):
        FlowGraph().add("a", Map(), [df], ["b"]).add("b", Map(), outputs=["a"]).build()
    with pytest.raises(ValueError):
        FlowGraph().add("a", Map()).build()


def test_service_answers_requests(spark):
    asked = spark.createDataFrame([(1, [10, 11]), (2, [])], "id int, keys array<int>")
    service = spark.createDataFrame([(10, "x"), (11, "y")], "k int, reply string")
    op = Service(service, lambda a, b: a["request"] == b["k"], F.col("keys"), F.array("reply", "reply"))
    assert rows(op.transform(asked).select("id", "response")) == [(1, "x"), (1, "x"), (1, "y"), (1, "y")]


def test_verbs(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, None, 1])], "seq long, v int")
    assert verbs.take_while(df, F.col("v") < 3).count() == 2
    assert verbs.drop_while(df, F.col("v") < 3).count() == 2
    assert verbs.drop_while(df, F.lit(True)).count() == 0 and verbs.take_while(df, F.lit(True)).count() == 4
    assert [r.seq for r in verbs.skip(df, 3).collect()] == [3]
    assert rows(verbs.matches(df.limit(0), F.col("v") > 0)) == [(False, True, True)]
    assert verbs.reduced(df.limit(0), F.sum("v")).first()[0] is None and verbs.fold(df.limit(0), F.sum("v"), 7).first()[0] == 7
    assert verbs.flat(df, F.array("v", "v"), cast="long").count() == 8
    assert verbs.concat(df, df.select("seq")).count() == 8
    seen_df, seen = verbs.peek(df, "peek", F.count("*").alias("n"))
    seen_df.collect()
    assert seen.get["n"] == 4
    assert [r.seq for r in verbs.rows(df, "seq")] == [0, 1, 2, 3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_percentiles_are_nearest_rank(spark, values):
    import math

    df = spark.createDataFrame([(v,) for v in values], "v long")
    want = [(p, sorted(values)[max(1, math.ceil(p / 100 * len(values))) - 1]) for p in statistics.PERCENTILES] if values else []
    assert rows(statistics.percentiles(df, "v")) == want


def test_mailboxes(spark):
    m = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "seq long, payload_type string, v int")
    assert rows(messaging.coalesced_by_type(m, "v").select("payload_type", "v", "first_seq")) == [("a", 3, 0), ("b", 2, 1)]
    for capacity, admitted in ((0, 0), (2, 2), (9, 3)):
        yes, no = messaging.bounded(m, capacity)
        assert (yes.count(), no.count()) == (admitted, 3 - admitted)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from(["credit", "x", "free", "urgent"]), max_size=30), st.integers(0, 2))
def test_credits_equal_message_by_message(spark, kinds, initial):
    credits, buffer, want = initial, [], []
    for i, k in enumerate(kinds):
        if k == "credit":
            credits += 1
            while credits > 0 and buffer:
                credits -= buffer.pop(0) != "free"
        elif k == "urgent":
            want.append((i, "DELIVERED"))
        elif credits > 0 and not buffer:
            credits -= k != "free"
            want.append((i, "DELIVERED"))
        else:
            buffer.append(k)
            want.append((i, "BACKPRESSURE_REQUIRED" if len(buffer) >= 3 else "DELIVERED"))
    m = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if k != "credit"], "seq long, k string")
    c = spark.createDataFrame([(i, 1) for i, k in enumerate(kinds) if k == "credit"], "seq long, n int")
    out = messaging.credited(m, c, 3, F.col("k") != "free", F.col("k") == "urgent", initial=initial)
    assert rows(out.select("seq", "status")) == want


def test_free_messages_that_wait_count_towards_the_threshold(spark):
    m = spark.createDataFrame([(0, "x"), (1, "free"), (2, "x")], "seq long, k string")
    out = messaging.credited(m, spark.createDataFrame([], "seq long, n int"), 3, F.col("k") != "free", F.lit(False))
    assert rows(out.select("seq", "waiting", "status")) == [(0, 1, "DELIVERED"), (1, 2, "DELIVERED"), (2, 3, "BACKPRESSURE_REQUIRED")]


def test_pieces_hold_equally_many_rows_of_a_heavy_tail(spark):
    values = [float(i) ** 3 for i in range(20_000)] + [1e12, float("nan"), None] + [5.5] * 10
    df = spark.createDataFrame([(v, "k", 9, 8) for v in values], "v double, key string, piece int, row int")
    sizes = [r["count"] for r in in_pieces(df, "v", ["key"], pieces=64).groupBy("piece").count().collect()]
    assert max(sizes) <= 2 * len(values) / 64 and sum(sizes) == len(values)
    got = sorted(position(df, "v", ["key"], "at", pieces=64).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(len(values))) and {(r.key, r.piece, r.row) for r in got} == {("k", 9, 8)}
    assert got[0].v is None and got[-1].v != got[-1].v and [r.v for r in got[1:-1]] == sorted(v for v in values if v is not None and v == v)


def test_names_of_helper_columns_are_free_for_users(spark):
    df = spark.createDataFrame([(i, "A", 0, 7, 8, 9) for i in range(6)], SEQ + ", _n long, _at long, _w long")
    out = ReduceEach(2, {"s": F.sum(F.col("_n") + F.col("_at") + F.col("_w"))}).transform(df)
    assert [r.s for r in out.collect()] == [48, 48, 48]
    assert {(r._w, r._n) for r in running_total(df, "seq", weight=F.lit(1)).collect()} == {(9, 7)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("qrx"), st.integers(0, 1), st.integers(0, 9)), max_size=40))
def test_asks_equal_message_by_message(spark, told):
    df = spark.createDataFrame([(i, k, u, t) for i, (k, u, t) in enumerate(told)], "seq long, kind string, user long, t long").withColumn("at", F.timestamp_seconds("t"))
    order = sorted((t, i, k, u) for i, (k, u, t) in enumerate(told))
    want = []
    for n, (t, i, k, u) in enumerate(order):
        if k == "q":
            reply = next(((x, j) for x, j, r, v in order[n + 1 :] if r == "r" and v == u), None)
            want.append((i, reply[1] if reply and reply[0] <= t + 3 else None))
    out = messaging.ask_within(df, "user", "at", F.col("kind") == "q", F.col("kind") == "r", "seq", "3 SECONDS", "seq")
    assert sorted((r.seq, r.reply_id) for r in out.collect()) == sorted(want, key=lambda x: x[0])
    turns = messaging.ask_in_turn(df, ["user"], "seq", F.col("kind") == "q", F.col("kind") == "r", F.col("seq"))
    later = {i: next(((j, r) for j, (r, v, _) in enumerate(told) if j > i and v == u), (0, ""))for i, (k, u, _) in enumerate(told) if k == "q"}
    assert {r.seq: r.reply for r in turns.collect()} == {i: j if r == "r" else None for i, (j, r) in later.items()}


def test_a_hot_asker_is_many_tasks_work(spark):
    df = spark.range(20_000).select(F.col("id").alias("seq"), F.lit("hot").alias("user"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 3 == 0, "q").otherwise("r").alias("kind"))
    sizes = [r["count"] for r in in_pieces(df, "at", ["user"]).groupBy("key", "piece").count().collect()]
    assert max(sizes) <= 2 * 20_000 / 256
    out = messaging.ask_within(df, "user", "at", F.col("kind") == "q", F.col("kind") == "r", "seq", "1 HOURS", "seq")
    assert out.where("reply_id = seq + 1").count() == out.count() - (19_999 % 3 == 0) == 6_667 - (19_999 % 3 == 0)


def test_many_subscribers_and_gates_meet_by_bins(spark, monkeypatch):
    m = spark.range(50).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("row"))
    subs = spark.createDataFrame([(f"s{i}", i * 3, None if i % 2 else i * 5) for i in range(9)], "subscriber string, joined_at long, left_at long")
    gates = spark.createDataFrame([(f"g{i}", "local" if i < 2 else "remote", "c") for i in range(9)], "gate string, kind string, channel string")
    few = [rows(messaging.fan_out_to_subscribers(m, subs))] + [rows(messaging.broadcast_scope(m, gates, s, "c")) for s in ("local", "remote", "all")]
    monkeypatch.setattr(messaging, "FEW", 1)
    assert few == [rows(messaging.fan_out_to_subscribers(m, subs))] + [rows(messaging.broadcast_scope(m, gates, s, "c")) for s in ("local", "remote", "all")]
    assert len(few[1]) == 100 and len(few[2]) == 350 and len(few[3]) == 450


def test_subscribers(spark):
    m = spark.createDataFrame([(i, "a", "1", i % 2 == 1) for i in range(4)], "seq long, payload_type string, destination string, foreign boolean")
    subs = spark.createDataFrame([("s", 2, None), ("t", 0, 1)], "subscriber string, joined_at long, left_at long")
    assert rows(messaging.fan_out_to_subscribers(m, subs).select("subscriber", "seq")) == [("s", 2), ("s", 3), ("t", 0)]
    assert messaging.fan_out_to_subscribers(m, subs.limit(0)).count() == 0
    typed = spark.createDataFrame([("1", "a", "FULL"), ("2", "a", "LOCAL"), ("2", "a", "LOCAL"), ("3", "a", "FULL")], "subscriber string, payload_type string, policy string")
    copies = messaging.subscriber_copies(m, typed, F.col("foreign"))
    assert rows(copies.groupBy("subscriber").count()) == [("2", 2), ("3", 4)]
    assert messaging.published(m, typed).count() == 4 + 8
    assert messaging.replied(spark.createDataFrame([("a", "b")], "sender string, destination string")).first().sender == "b"


def test_discovery_and_routes(spark):
    r = spark.createDataFrame([("s", None, "h1", "k"), ("s", 0.9, "h2", "k"), ("s", 0.1, "x", "k"), ("t", 0.1, "h", "k")], "name string, load double, host string, channel string")
    found = discovery.discovered(r, F.col("name"), "s", F.col("load"), (0, 0.5), F.col("host"), "h.", F.col("channel"), [])
    assert rows(found.select("host")) == [("h1",)]
    log = spark.createDataFrame([("a", 1, False, 1), ("a", 2, True, 2), ("b", 1, False, 5)], "k string, seq long, gone boolean, v int")
    assert rows(discovery.latest(log, ["k"], "seq", F.col("gone")).select("k", "v")) == [("b", 5)]


def test_values(spark):
    import uuid

    df = spark.createDataFrame([("1",), ("x",)], "s string")
    t = attempt(F.col("s").try_cast("int"), "bad")
    assert rows(df.select(recovered(t, F.lit(-1)))) == [(-1,), (1,)]
    assert rows(df.select(F.coalesce(recovered(t, F.lit(-1), "other"), F.lit(9)))) == [(1,), (9,)]
    assert rows(df.select(F.coalesce(mapped(t, lambda v: v + 1)["value"], F.lit(0)))) == [(0,), (2,)]
    import hashlib

    h = bytearray(hashlib.md5(b"EUROPE").digest())
    assert spark.range(1).select(name_uuid(F.lit("EUROPE"))).first()[0] == str(uuid.UUID(bytes=bytes(h), version=3))
    st_ = spark.createDataFrame([("DELIVERED",), ("BACKPRESSURE_REQUIRED",)], "s string")
    assert st_.agg(worst(F.col("s"))).first()[0] == "BACKPRESSURE_REQUIRED" and st_.where(is_delivered(F.col("s"))).count() == 2
