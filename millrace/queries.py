"""The driver's queries over the flow and message operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.position import position
from .functions.values import attempt, channel_parts, name_uuid, recovered, worst
from .operators import discovery, messaging, routing, statistics, verbs
from .operators.flow import Map, Reduce, ReduceEach, Service, Zip, rules_of
from .plans.graph import FlowGraph
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _joined():
    """The rows' ids of a group in order, joined by commas."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.col("seq").cast("string").alias("v")))), lambda x: x["v"]), ",")


@query("""
WITH m AS (SELECT abs(user_id) % 2 AS routee, event_type AS payload_type, event_id,
                  row_number() OVER (PARTITION BY abs(user_id) % 2, event_type ORDER BY event_id) - 1 AS place FROM events)
SELECT routee, payload_type, CAST(place // 4 AS BIGINT) AS grp, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids
FROM m GROUP BY ALL HAVING count(*) = 4""")
def flow_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship flow: map, partition over two routees, reduce every four of a type."""
    source = tables.messages(spark, sf_dir).select("seq", "payload_type", "actor")
    graph = FlowGraph()
    graph.add("map", Map(fn=lambda df: routing.partition_by(df, F.col("actor"), 2)), [source], ["reduce"])
    graph.add("reduce", ReduceEach(4, {"ids": _joined()}, routee=["routee"]))
    rows = graph.build()["reduce"]
    return rows.select("routee", "payload_type", F.col("group").alias("grp"), "ids")


@query("""SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents
WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 0""")
def flow_map_explode(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = Map(items=F.filter(F.split("text", " "), lambda w: w != ""), name="word").transform(docs)
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"))


_TAGGED = "SELECT CASE WHEN value >= 50 THEN 'if' ELSE 'else' END AS branch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1"


@query(_TAGGED)
def route_if_else(spark, sf_dir):
    yes, no = routing.if_else(tables.messages(spark, sf_dir).select("seq", "value"), F.col("value") >= 50)
    both = routing.fan_in(yes.withColumn("branch", F.lit("if")), no.withColumn("branch", F.lit("else")))
    return both.groupBy("branch").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1")
def route_drop(spark, sf_dir):
    yes, _ = routing.if_else(tables.table(spark, sf_dir, "events"), F.col("value") >= 50, with_else=False)
    return yes.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT output, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events, (VALUES ('a'), ('b')) o(output) GROUP BY 1")
def fan_out_in(spark, sf_dir):
    copies = routing.fan_out(tables.messages(spark, sf_dir).select("seq"), ["a", "b"])
    return copies.groupBy("output").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query("""WITH m AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) + 1) % 3 AS routee FROM events)
SELECT CAST(routee AS BIGINT) AS routee, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM m GROUP BY 1""")
def round_robin(spark, sf_dir):
    rows = routing.round_robin(tables.messages(spark, sf_dir).select("seq"), 3)
    return rows.groupBy("routee").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query("SELECT CAST(abs(user_id) % 4 AS BIGINT) AS routee, count(*) AS n FROM events GROUP BY 1")
def partition_by(spark, sf_dir):
    return routing.partition_by(tables.table(spark, sf_dir, "events"), F.col("user_id"), 4).groupBy("routee").agg(F.count("*").alias("n"))


def _slots(kind: str):
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("payload_type") == kind, F.struct("slot", "seq")))), lambda x: x["seq"].cast("string")), ",")


_ZIP = """
WITH m AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place FROM events),
c AS (SELECT place // {n} AS grp, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS clicks, count(*) AS k FROM m WHERE event_type = 'click' GROUP BY 1),
p AS (SELECT place AS grp, CAST(event_id AS VARCHAR) AS purchases FROM m WHERE event_type = 'purchase')
SELECT CAST(grp AS BIGINT) AS grp, clicks, purchases FROM c JOIN p USING (grp) WHERE k = {n}"""


def _zip(spark, sf_dir, rules):
    rows = tables.messages(spark, sf_dir).select("seq", "payload_type")
    out = Zip(rules, {"clicks": _slots("click"), "purchases": _slots("purchase")}).transform(rows)
    return out.select(F.col("group").alias("grp"), "clicks", "purchases")


@query(_ZIP.format(n=1))
def zip_one_one(spark, sf_dir):
    return _zip(spark, sf_dir, rules_of("click", "purchase"))


@query(_ZIP.format(n=2))
def zip_two_one(spark, sf_dir):
    return _zip(spark, sf_dir, rules_of("click", "click", "purchase"))


@query("SELECT event_type AS payload_type, CAST(count(*) % 4 AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) % 4 > 0")
def reduce_leftover(spark, sf_dir):
    left = ReduceEach(4, {}).leftover(tables.messages(spark, sf_dir).select("seq", "payload_type"))
    return left.groupBy("payload_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) // 5 AS groups, CAST(count(*) // 5 * 5 AS BIGINT) AS used FROM events WHERE event_type = 'click'")
def reduce_ignored(spark, sf_dir):
    out = Reduce({"click": 5}, {"used": F.count("*")}).transform(tables.messages(spark, sf_dir).select("seq", "payload_type"))
    return out.agg(F.count("*").alias("groups"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"))


_STOP = "coalesce((SELECT min(event_id) FROM events WHERE NOT value < 200), (SELECT max(event_id) + 1 FROM events))"


@query(f"SELECT event_id AS seq, value FROM events WHERE event_id < {_STOP}")
def take_while(spark, sf_dir):
    return verbs.take_while(tables.messages(spark, sf_dir).select("seq", "value"), F.col("value") < 200)


@query(f"SELECT event_id AS seq, value FROM events WHERE event_id >= {_STOP}")
def drop_while(spark, sf_dir):
    return verbs.drop_while(tables.messages(spark, sf_dir).select("seq", "value"), F.col("value") < 200)


@query("SELECT event_id AS seq, value FROM events ORDER BY event_id LIMIT 10 OFFSET 20")
def skip_limit(spark, sf_dir):
    return verbs.limit(verbs.skip(tables.messages(spark, sf_dir).select("seq", "value"), 20), 10)


@query("SELECT bool_or(value > 400) AS any_match, bool_and(value > 400) AS all_match, NOT bool_or(value > 400) AS none_match FROM events")
def match_flags(spark, sf_dir):
    return verbs.matches(tables.table(spark, sf_dir, "events"), F.col("value") > 400)


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS at_min, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS at_max
FROM orders GROUP BY 1""")
def stream_min_max(spark, sf_dir):
    return verbs.extremes(tables.table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", ["o_custkey"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    return verbs.distinct(tables.table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT event_id, CAST(value AS INTEGER) AS whole, CAST(user_id AS DOUBLE) AS actor FROM (SELECT event_id, trunc(value) AS value, user_id FROM events)")
def stream_casts(spark, sf_dir):
    return verbs.to(tables.table(spark, sf_dir, "events"), event_id=F.col("event_id"), whole=F.col("value").cast("int"), actor=F.col("user_id").cast("double"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top
FROM lineitem GROUP BY 1, 2""")
def collect_group(spark, sf_dir):
    folds = {"n": F.count("*"), "quantity": F.sum(F.col("l_quantity").cast("long")), "first_ship": F.min("l_shipdate"), "top": F.max("l_extendedprice")}
    return verbs.collect(tables.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], **folds)


@query("SELECT user_id, list(event_id ORDER BY event_id) AS items FROM events GROUP BY 1")
def stream_to_array(spark, sf_dir):
    return verbs.to_array(tables.table(spark, sf_dir, "events"), F.col("event_id"), ["user_id"], "event_id")


@query("SELECT user_id, coalesce(max(value), -1.0) AS value FROM events GROUP BY 1")
def stream_fold(spark, sf_dir):
    return verbs.fold(tables.table(spark, sf_dir, "events"), F.max("value"), -1.0, ["user_id"])


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1")
def stream_find_first(spark, sf_dir):
    return verbs.find_first(tables.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


_RANKS = ", ".join(f"({p})" for p in statistics.PERCENTILES)


@query(f"""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT CAST(p AS DOUBLE) AS p, value FROM v, (VALUES {_RANKS}) q(p) WHERE r = greatest(ceil(CAST(p AS DOUBLE) / 100 * n), 1)""")
def latency_percentiles(spark, sf_dir):
    return statistics.percentiles(tables.table(spark, sf_dir, "events"), "value")


@query(f"""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n
FROM events WHERE value IS NOT NULL)
SELECT event_type, CAST(p AS DOUBLE) AS p, value FROM v, (VALUES {_RANKS}) q(p) WHERE r = greatest(ceil(CAST(p AS DOUBLE) / 100 * n), 1)""")
def percentile_by_type(spark, sf_dir):
    return statistics.percentiles(tables.table(spark, sf_dir, "events"), "value", ["event_type"])


@query("""WITH c AS (SELECT date_trunc('hour', ts) AS interval, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(interval AS VARCHAR) AS hour, n, CAST(n - lag(n) OVER (ORDER BY interval) AS BIGINT) AS delta FROM c""")
def requests_per_interval(spark, sf_dir):
    out = statistics.per_interval(tables.table(spark, sf_dir, "events"), F.col("ts"), "hour")
    return out.select(F.date_format("interval", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "delta")


@query("""SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) - 1 AS position FROM events""")
def priority_order(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("rank"))
    return messaging.drained_by_priority(e, "rank", "event_id").select("event_id", "position")


@query("SELECT event_type AS payload_type, arg_max(value, event_id) AS value, min(event_id) AS first_seq, max(event_id) AS seq FROM events GROUP BY 1")
def coalesce_latest(spark, sf_dir):
    return messaging.coalesced_by_type(tables.messages(spark, sf_dir), "value")


@query("""SELECT s.subscriber, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq
FROM events, (VALUES ('early', 0, NULL), ('late', 500, NULL), ('left', 0, 300)) s(subscriber, joined_at, left_at)
WHERE event_id >= joined_at AND (left_at IS NULL OR event_id < left_at) GROUP BY 1""")
def pubsub_fanout(spark, sf_dir):
    subs = spark.createDataFrame([("early", 0, None), ("late", 500, None), ("left", 0, 300)], "subscriber string, joined_at long, left_at long")
    copies = messaging.fan_out_to_subscribers(tables.messages(spark, sf_dir).select("seq"), subs)
    return copies.groupBy("subscriber").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


_SUBS = [("1", "click", "LOCAL"), ("1", "click", "FULL"), ("2", "click", "LOCAL"), ("3", "purchase", "LOCAL"), ("5", "error", "FULL"), ("5", "error", "FULL")]
_SUBS_SQL = "(VALUES " + ", ".join(str(s) for s in _SUBS) + ") s(subscriber, payload_type, policy)"


def _subscriptions(spark):
    return spark.createDataFrame(_SUBS, "subscriber string, payload_type string, policy string")


@query(f"SELECT subscriber, payload_type, CASE WHEN bool_or(policy = 'FULL') THEN 'FULL' ELSE 'LOCAL' END AS policy FROM {_SUBS_SQL} GROUP BY 1, 2")
def subscription_normalize(spark, sf_dir):
    return messaging.normalized_subscriptions(_subscriptions(spark))


@query(f"""SELECT subscriber, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events
JOIN (SELECT DISTINCT subscriber, payload_type FROM {_SUBS_SQL}) s ON event_type = payload_type WHERE CAST(user_id AS VARCHAR) <> subscriber GROUP BY 1""")
def typed_subscription(spark, sf_dir):
    m = tables.messages(spark, sf_dir).select("seq", "payload_type", F.col("actor").cast("string").alias("destination"))
    return messaging.subscriber_copies(m, _subscriptions(spark)).groupBy("subscriber").agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query(f"""SELECT subscriber, count(*) AS n FROM events
JOIN (SELECT subscriber, payload_type, bool_or(policy = 'FULL') AS f FROM {_SUBS_SQL} GROUP BY 1, 2) s ON event_type = payload_type
WHERE CAST(user_id AS VARCHAR) <> subscriber AND (f OR user_id % 2 = 0) GROUP BY 1""")
def subscription_policy(spark, sf_dir):
    m = tables.messages(spark, sf_dir).select("seq", "payload_type", F.col("actor").cast("string").alias("destination"), (F.col("actor") % 2 != 0).alias("foreign"))
    return messaging.subscriber_copies(m, _subscriptions(spark), F.col("foreign")).groupBy("subscriber").agg(F.count("*").alias("n"))


@query(f"""SELECT receiver, count(*) AS n FROM (
SELECT CAST(user_id AS VARCHAR) AS receiver FROM events UNION ALL
SELECT subscriber FROM events JOIN (SELECT DISTINCT subscriber, payload_type FROM {_SUBS_SQL}) s ON event_type = payload_type WHERE CAST(user_id AS VARCHAR) <> subscriber) GROUP BY 1""")
def publish_messages(spark, sf_dir):
    m = tables.messages(spark, sf_dir).select("seq", "payload_type", F.col("actor").cast("string").alias("destination"))
    return messaging.published(m, _subscriptions(spark)).groupBy("receiver").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN next_role = 'assistant' THEN next_text END AS reply,
       CASE WHEN next_role = 'assistant' AND next_text IS NOT NULL THEN 'answered' ELSE 'timeout' END AS status FROM m WHERE role = 'user'""")
def ask_reply(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    out = messaging.ask_in_turn(c, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant", F.col("text"))
    return out.select("conv_id", "turn", "reply", "status")


@query("""WITH r AS (SELECT c.event_id, arg_min(p.event_id, (p.ts, p.event_id)) AS id, min(p.ts) AS reply_ts, any_value(c.ts) AS ts
FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) > (c.ts, c.event_id) WHERE c.event_type = 'click' GROUP BY 1)
SELECT event_id, CASE WHEN reply_ts <= ts + INTERVAL 24 HOUR THEN id END AS reply_id, CASE WHEN reply_ts <= ts + INTERVAL 24 HOUR THEN 'answered' ELSE 'timeout' END AS status FROM r""")
def ask_timeout(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = messaging.ask_within(e, "user_id", "ts", F.col("event_type") == "click", F.col("event_type") == "purchase", "event_id", "24 HOURS", "event_id")
    return out.select("event_id", "reply_id", "status")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'DELIVERED' ELSE 'NOT_DELIVERED' END AS status FROM orders) GROUP BY 1""")
def ack_status(spark, sf_dir):
    acks = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    sent = tables.table(spark, sf_dir, "orders").select("o_orderkey")
    return messaging.acknowledged(sent, acks, "o_orderkey").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def dead_letters(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    return messaging.dead_letters(docs, tables.table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("""SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE regexp_full_match(s_name, '.*[02468]') AND s_acctbal BETWEEN 0 AND 5000""")
def service_discovery(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier").withColumn("service", F.lit("supply"))
    found = discovery.discovered(s, F.col("service"), "supply", F.col("s_acctbal"), (0, 5000), F.col("s_name"), ".*[02468]")
    return found.join(tables.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("""WITH g AS (SELECT n_nationkey AS gate_system, r_name AS channel, n_name || '@' || r_name AS route FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, coalesce((SELECT route FROM g WHERE gate_system = s_nationkey AND channel = 'ASIA'), (SELECT arg_min(route, channel) FROM g WHERE gate_system = s_nationkey)) AS route FROM supplier""")
def gate_lookup(spark, sf_dir):
    gates = tables.table(spark, sf_dir, "nation").join(tables.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    gates = gates.select(F.col("n_nationkey").alias("gate_system"), F.col("r_name").alias("channel"), F.concat("n_name", F.lit("@"), "r_name").alias("route"))
    return discovery.with_route(tables.table(spark, sf_dir, "supplier"), gates, "s_nationkey", F.lit("ASIA")).select("s_suppkey", "route")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
WHERE r = 1 AND event_type <> 'error'""")
def registry_upsert(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return discovery.latest(e, ["user_id"], "event_id", F.col("event_type") == "error").select("user_id", "event_id", "value")


@query("SELECT o_orderkey, c_name AS reply, c_mktsegment || ':' || o_orderpriority AS response FROM orders JOIN customer ON o_custkey = c_custkey")
def service_enrich(spark, sf_dir):
    customer = tables.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("reply"), "c_mktsegment")
    op = Service(customer, lambda a, b: a["request"] == b["c_custkey"], F.array("o_custkey"), F.array(F.concat("c_mktsegment", F.lit(":"), "o_orderpriority")))
    return op.transform(tables.table(spark, sf_dir, "orders")).select("o_orderkey", "reply", "response")


_EXEC = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS exec_seq FROM events WHERE event_id % 7 <> 0"


@query(f"SELECT x.user_id, x.exec_seq, e.event_id, e.value FROM ({_EXEC}) x JOIN events e USING (user_id, event_id) WHERE e.event_id % 11 <> 0")
def replay_order(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    executed = position(e.where("event_id % 7 <> 0").select("user_id", "event_id", "ts"), "ts", ["user_id"], "exec_seq", ["event_id"]).drop("ts")
    log = e.where("event_id % 11 <> 0").select("user_id", "event_id", "value")
    return discovery.replayed(log, executed, ["user_id", "event_id"], "exec_seq").select("user_id", "exec_seq", "event_id", "value")


@query("SELECT user_id, event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 = 0")
def replay_missing(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id")
    return discovery.missing_messages(e.where("event_id % 11 <> 0"), e.where("event_id % 7 <> 0"), ["user_id", "event_id"])


@query("""SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'c' || json_extract_string(props, '$.k') WHEN 'purchase' THEN 'p' || json_extract_string(props, '$.k') END AS handled
FROM events WHERE event_type IN ('click', 'purchase')""")
def json_payload(spark, sf_dir):
    field = F.get_json_object("props", "$.k")
    handlers = {"click": F.concat(F.lit("c"), field), "purchase": F.concat(F.lit("p"), field)}
    return routing.dispatch(tables.messages(spark, sf_dir), handlers).select("seq", "handled")


@query("""SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(raw, '[0-9]+$') AS BIGINT), -1) AS number
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_brand END AS raw FROM part)""")
def try_cast_recover(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").withColumn("raw", F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_brand")))
    tried = attempt(F.regexp_extract("raw", "[0-9]+$", 0).try_cast("bigint"), "not a number")
    return p.select("p_partkey", recovered(tried, F.lit(-1).cast("long"), "number").alias("number"))


@query("""WITH h AS (SELECT r_name, md5(r_name) AS h FROM region)
SELECT r_name, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || substr('89ab89ab89ab89ab', CAST(('0x' || h[17]) AS INTEGER) + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""")
def uuid3_ids(spark, sf_dir):
    return tables.table(spark, sf_dir, "region").select("r_name", name_uuid(F.col("r_name")).alias("id"))


@query("SELECT n_name, split_part(c, '@', 1) AS kind, split_part(c, '@', 2) AS name FROM (SELECT n_name, 'KAFKA@' || n_name AS c FROM nation)")
def channel_ids(spark, sf_dir):
    kind, name = channel_parts(F.concat(F.lit("KAFKA@"), "n_name"))
    return tables.table(spark, sf_dir, "nation").select("n_name", kind.alias("kind"), name.alias("name"))


@query("SELECT doc_id, CAST(ceil(length(text) / 1000.0) AS BIGINT) AS chunks FROM documents WHERE length(text) > 0")
def file_chunks(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return tables.chunked(docs, "text", 1000).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("SELECT count(*) FILTER (WHERE r <= 400) AS admitted, count(*) FILTER (WHERE r > 400) AS refused FROM (SELECT row_number() OVER (ORDER BY event_id) AS r FROM events)")
def bounded_mailbox(spark, sf_dir):
    yes, no = messaging.bounded(tables.messages(spark, sf_dir).select("seq"), 400)
    both = yes.select(F.lit(1).alias("a")).unionByName(no.select(F.lit(0).alias("a")))
    return both.agg(F.sum("a").alias("admitted"), F.sum(1 - F.col("a")).alias("refused"))


@query("""WITH m AS (SELECT event_id, event_type = 'view' AS credit, event_type = 'error' AS jumps, event_type <> 'signup' AS pays FROM events),
b AS (SELECT *, count(*) FILTER (WHERE credit) OVER w AS k, count(*) FILTER (WHERE NOT credit AND NOT jumps) OVER w AS place,
      count(*) FILTER (WHERE NOT credit AND NOT jumps AND pays) OVER w AS before
      FROM m WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT before + 1 AS nth, place AS gone FROM b WHERE pays AND NOT credit AND NOT jumps)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT jumps AND k <= before AND b.place - coalesce(gone, -1) >= 100 THEN 'BACKPRESSURE_REQUIRED' ELSE 'DELIVERED' END AS status
 FROM b LEFT JOIN p ON k = nth WHERE NOT credit) GROUP BY 1""")
def credit_backpressure(spark, sf_dir):
    m = tables.messages(spark, sf_dir).select("seq", "payload_type")
    credits = m.where("payload_type = 'view'").select("seq", F.lit(1).alias("n"))
    kind = F.col("payload_type")
    out = messaging.credited(m.where("payload_type <> 'view'"), credits, 100, kind != "signup", kind == "error")
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT abs(user_id) % 2 AS routee, event_id, row_number() OVER (PARTITION BY abs(user_id) % 2 ORDER BY event_id) - 1 AS place FROM events WHERE event_type = 'click')
SELECT CAST(routee AS BIGINT) AS routee, max(event_id) AS seq, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS value FROM m GROUP BY routee, place // 4 HAVING count(*) = 4""")
def stream_reduce(spark, sf_dir):
    """The streaming Reduce over the table as a stream, drained into a table: the batch form's groups."""
    from .streaming import stateful

    work = tables.work_dir(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    rows = rows.select((F.abs("user_id") % 2).alias("routee"), F.col("event_type").alias("payload_type"), F.col("event_id").alias("seq"), F.col("event_id").alias("value"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = stateful.reduce_stream(rows, {"click": 4}, lambda taken: ",".join(taken["click"]))
        stateful.drain(out, f"{work}/checkpoint", lambda df, _: tables.append(df, f"{work}/out"))
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("routee long, seq long, value string").parquet(f"{work}/out")


@query("SELECT user_id, list(value ORDER BY event_id) AS snapshots, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_type = 'view' GROUP BY 1")
def snapshot_totals(spark, sf_dir):
    views = tables.table(spark, sf_dir, "events").where("event_type = 'view'")
    lists = verbs.to_array(views, F.col("value"), ["user_id"], "event_id", "snapshots")
    return lists.withColumn("total", F.aggregate("snapshots", F.lit(0).cast("long"), lambda a, v: a + F.floor(v)))


_GATES = "(SELECT n_name AS gate, CASE WHEN n_nationkey < 3 THEN 'local' ELSE 'remote' END AS kind, r_name AS channel FROM nation JOIN region ON n_regionkey = r_regionkey) g"


@query(f"SELECT gate, count(*) AS n FROM events, {_GATES} WHERE event_type = 'error' AND kind <> 'local' GROUP BY 1")
def broadcast_remote(spark, sf_dir):
    gates = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("gate"), F.when(F.col("n_nationkey") < 3, "local").otherwise("remote").alias("kind"))
    errors = tables.messages(spark, sf_dir).where("payload_type = 'error'").select("seq")
    return messaging.broadcast_scope(errors, gates, "remote").groupBy("gate").agg(F.count("*").alias("n"))


_CHANGES = [("a", "click", 10, "set"), ("a", "view", 50, "add"), ("a", "error", 300, "set"), ("b", "click", 0, "add"), ("b", "click", 400, "remove"), ("b", "click", 700, "add")]
_HELD = "(VALUES ('a', 'click', 10, 300), ('a', 'view', 50, 300), ('a', 'error', 300, NULL), ('b', 'click', 0, 400), ('b', 'click', 700, NULL)) h(subscriber, payload_type, f, u)"


@query(f"SELECT subscriber, payload_type, count(*) AS n, min(event_id) AS first_seq FROM events JOIN {_HELD} ON event_type = payload_type AND event_id >= f AND (u IS NULL OR event_id < u) GROUP BY 1, 2")
def resubscription(spark, sf_dir):
    changes = spark.createDataFrame(_CHANGES, "subscriber string, payload_type string, at long, action string")
    copies = messaging.by_validity(tables.messages(spark, sf_dir).select("seq", "payload_type"), changes)
    return copies.groupBy("subscriber", "payload_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN user_id % 5 = 1 THEN 'own' WHEN event_type = 'signup' AND event_id % 5 = 1 THEN 'ack'
WHEN event_id % 5 = 1 THEN 'deliver' ELSE 'sniff' END AS action FROM events) GROUP BY 1""")
def remote_receive(spark, sf_dir):
    m = tables.messages(spark, sf_dir).select("seq", "payload_type", "actor")
    name = lambda c: F.concat(F.lit("system-"), (c % 5).cast("string"))
    out = messaging.received(m, "system-1", name(F.col("actor")), name(F.col("seq")), F.col("payload_type") == "signup")
    return out.groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN value > 100 THEN 'BACKPRESSURE_REQUIRED' WHEN event_type = 'error' THEN 'NOT_DELIVERED' ELSE 'DELIVERED' END AS status FROM events)
SELECT user_id, CASE max(CASE status WHEN 'NOT_DELIVERED' THEN 2 WHEN 'BACKPRESSURE_REQUIRED' THEN 1 ELSE 0 END) WHEN 2 THEN 'NOT_DELIVERED' WHEN 1 THEN 'BACKPRESSURE_REQUIRED' ELSE 'DELIVERED' END AS worst,
arg_max(status, event_id) AS last FROM s GROUP BY 1""")
def status_combination(spark, sf_dir):
    status = F.when(F.col("value") > 100, "BACKPRESSURE_REQUIRED").when(F.col("event_type") == "error", "NOT_DELIVERED").otherwise("DELIVERED")
    e = tables.table(spark, sf_dir, "events").withColumn("status", status)
    return e.groupBy("user_id").agg(worst(F.col("status")).alias("worst"), F.max_by("status", "event_id").alias("last"))


@query("""SELECT s_suppkey, m.event_id AS report, m.value AS load FROM supplier,
(SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 1) m""")
def monitored_services(spark, sf_dir):
    reports = tables.table(spark, sf_dir, "events").where("event_type = 'view'").select("event_type", "event_id", "value")
    r = discovery.latest(reports, ["event_type"], "event_id", F.lit(False)).first()  # one report
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(r.event_id).cast("long").alias("report"), F.lit(r.value).cast("double").alias("load"))


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 1")
def duplicate_systems(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier").join(tables.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return discovery.duplicated(s, "n_name")


@query("SELECT place, s_suppkey FROM (VALUES (0, 'Supplier#000000003'), (1, 'nobody'), (2, 'Supplier#000000001')) w(place, name) JOIN supplier ON s_name = name")
def resolve_many(spark, sf_dir):
    wanted = tables.collection(spark, [("Supplier#000000003",), ("nobody",), ("Supplier#000000001",)], "name string")
    return discovery.resolved(wanted, tables.table(spark, sf_dir, "supplier"), "name", "s_name").select(F.col("seq").cast("int").alias("place"), "s_suppkey")


@query("""SELECT event_id AS seq, strftime(ts, '%Y-%m-%d') || ' SENDER: ' || user_id || ' DESTINATION: sink SEQ: ' || event_id || ' TYPE: ' || event_type || ' PAYLOAD: ' || props AS line FROM events""")
def message_log(spark, sf_dir):
    m = tables.messages(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("sink", F.lit("sink"))
    return tables.log_line(m, "day", "actor", "sink", "seq", "payload_type", "props")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def sorted_limit(spark, sf_dir):
    return verbs.ordered(tables.table(spark, sf_dir, "events").select("event_id", "value"), F.desc("value"), "event_id").limit(25)


@query("SELECT o_orderkey, o_custkey AS actor FROM orders WHERE o_orderkey = 7 LIMIT 1")
def keyed_lookup(spark, sf_dir):
    return tables.lookup(tables.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("actor")), "o_orderkey", 7)


@query("SELECT kind, count(*) AS n FROM (SELECT 'order' AS kind FROM orders UNION ALL SELECT event_type FROM events) GROUP BY 1")
def union_of_sources(spark, sf_dir):
    both = verbs.concat(tables.table(spark, sf_dir, "orders").select(F.lit("order").alias("kind")), tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id AS k, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c.user_id, count(*) AS asked, count(*) FILTER (WHERE a.last IS NOT NULL) AS acked FROM events c LEFT JOIN a ON c.user_id = a.k WHERE c.event_type = 'click' GROUP BY 1""")
def ack_by_actor(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    out = messaging.acknowledged(e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase'").select("user_id"), "user_id")
    return out.groupBy("user_id").agg(F.count("*").alias("asked"), F.sum((F.col("status") == "DELIVERED").cast("long")).alias("acked"))


@query(f"""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events WHERE event_type = 'view' AND value IS NOT NULL)
SELECT CAST(p AS DOUBLE) AS p, value FROM v, (VALUES {_RANKS}) q(p) WHERE r = greatest(ceil(CAST(p AS DOUBLE) / 100 * n), 1)""")
def flattened_percentiles(spark, sf_dir):
    """Percentiles over all latencies that arrive as arrays, one snapshot a user."""
    views = tables.table(spark, sf_dir, "events").where("event_type = 'view'")
    return statistics.percentiles_of_arrays(verbs.to_array(views, F.col("value"), ["user_id"], "event_id", "snapshot"), "snapshot")


@query("""SELECT user_id, event_id, before, value FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
WHERE value <= before""")
def unordered_items(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return verbs.unordered(e, "value", ["user_id"], "event_id")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE length(text) > 0")
def chunks_joined(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    back = tables.joined_chunks(tables.chunked(docs, "text", 1000), ["doc_id"])
    return back.select("doc_id", F.md5("text").alias("digest"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(regexp_extract(p_brand, '[0-9]+$') AS BIGINT) END AS number,
CASE WHEN p_partkey % 3 = 0 THEN 'bad: x' END AS error FROM part""")
def error_routing(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_brand")).alias("raw"))
    tried = attempt(F.regexp_extract("raw", "[0-9]+$", 0).try_cast("bigint"), F.concat(F.lit("bad: "), "raw"))
    good, bad = routing.split_errors(p, tried, "number")
    return routing.fan_in(good, bad).select("p_partkey", "number", "error")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority LIKE '1%' AS routed FROM orders),
d AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) + 1) % 3 AS turn FROM r WHERE NOT routed)
SELECT o_orderkey AS seq, 'supply' AS ref FROM r WHERE routed UNION ALL SELECT o_orderkey, 'supply-' || turn FROM d""")
def service_selection(spark, sf_dir):
    asked = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderpriority").startswith("1"), "ROUTED").otherwise("DIRECT").alias("selection"))
    return routing.selected(asked, F.lit("supply"), 3).select("seq", "ref")


@query("""SELECT n_nationkey, arg_min(r_name, md5('1|' || n_nationkey || '|' || r_name)) AS r_name FROM nation JOIN region ON (n_nationkey + r_regionkey) % 2 = 0 GROUP BY 1""")
def gate_at_random(spark, sf_dir):
    n, r = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "region")
    gates = n.select("n_nationkey", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda x: (F.col("n_nationkey") + x) % 2 == 0)).alias("k"))
    return discovery.random_gate(gates.join(r, F.col("k") == F.col("r_regionkey")).select("n_nationkey", "r_name"), ["n_nationkey"], "r_name")


@query("""SELECT event_id FROM events WHERE event_type = 'click' AND (json_extract_string(props, '$.k') IS NULL OR
(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 10 AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 50))""")
def property_discovery(spark, sf_dir):
    """Services by a property looked up in their map, within an open range; an absent property meets the criterion."""
    e = tables.table(spark, sf_dir, "events").withColumn("properties", F.from_json("props", "map<string,string>"))
    load = discovery.property_of(F.col("properties"), "k").try_cast("double")
    return discovery.discovered(e, F.col("event_type"), "click", load, (10, 50), closed=False).select("event_id")


@query(_ZIP.format(n=2))
def zip_sink(spark, sf_dir):
    """A zip whose groups a consumer writes to a durable table."""
    path = f"{tables.work_dir(spark)}/zip"
    tables.append(_zip(spark, sf_dir, rules_of("click", "click", "purchase")), path)
    return spark.read.parquet(path)


@query(f"SELECT x.user_id, x.exec_seq, e.event_id, e.value FROM ({_EXEC}) x JOIN events e USING (user_id, event_id) WHERE e.event_id % 11 <> 0")
def record_and_replay(spark, sf_dir):
    """Messages and their executions recorded in two logs, then replayed from them."""
    work, e = tables.work_dir(spark), tables.table(spark, sf_dir, "events")
    tables.append(e.where("event_id % 11 <> 0").select("user_id", "event_id", "value"), f"{work}/messages")
    tables.append(position(e.where("event_id % 7 <> 0").select("user_id", "event_id", "ts"), "ts", ["user_id"], "exec_seq", ["event_id"]).drop("ts"), f"{work}/executions")
    log, executed = spark.read.parquet(f"{work}/messages"), spark.read.parquet(f"{work}/executions")
    return discovery.replayed(log, executed, ["user_id", "event_id"], "exec_seq").select("user_id", "exec_seq", "event_id", "value")
