from pyspark.sql import functions as F

from millrace.sources import tables
from millrace.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_reduce_keeps_leftovers_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    src = str(tmp_path / "in")
    for part in ([0, 1, 2], [3, 4], [5, 6]):
        spark.createDataFrame([(i, "a", 0, str(i)) for i in part], "seq long, payload_type string, routee long, value string").coalesce(1).write.mode("append").parquet(src)
    df = tables.stream(spark, src, "seq long, payload_type string, routee long, value string")
    out = stateful.reduce_stream(df, {"a": 2}, lambda t: "+".join(t["a"]))
    stateful.drain(out, str(tmp_path / "c"), lambda d, _: tables.append(d, str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 3 and sorted(v for r in got for v in r.value.split("+"))[:2] == ["0", "1"]


def test_chunks_and_log_lines(spark):
    df = spark.createDataFrame([("abcde",), ("",)], "t string")
    assert [r.chunk for r in tables.chunked(df, "t", 2).orderBy("chunk_at").collect()] == ["ab", "cd", "e"]
    long = spark.createDataFrame([(1, "abcdefghijk" * 3), (2, "x")], "k int, t string")
    back = tables.joined_chunks(tables.chunked(long, "t", 2), ["k"])
    assert {r.k: r.text for r in back.collect()} == {1: "abcdefghijk" * 3, 2: "x"}
    m = spark.createDataFrame([(7, "a", "b", "k", "p", "t0")], "seq long, s string, d string, k string, p string, t string")
    assert tables.log_line(m, "t", "s", "d", "seq", "k", "p").first().line.startswith("t0 SENDER: a DESTINATION: b SEQ: 7")


def test_stream_ask_answers_within_the_timeout(spark, tmp_path):
    rows = [(1, "q", "2024-01-01 00:00:00"), (2, "q", "2024-01-01 00:00:00"), (1, "r", "2024-01-01 00:30:00"), (1, "r", "2024-01-01 00:40:00"), (1, "r", "2024-01-01 00:20:00"), (2, "r", "2024-01-01 05:00:00"), (9, "q", "2024-01-03 00:00:00"), (9, "r", "2024-01-03 00:00:01")]
    spark.createDataFrame(rows, "k long, kind string, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = tables.stream(spark, str(tmp_path / "in"), "k long, kind string, t timestamp")
    asked = df.where("kind = 'q'").select("k", F.col("t").alias("request_at"))
    replies = df.where("kind = 'r'").select("k", F.col("t").alias("reply_at"))
    out = stateful.answered_stream(asked, replies, "k", "2 HOURS", "10 minutes")
    stateful.drain(out, str(tmp_path / "c"), lambda d, _: tables.append(d, str(tmp_path / "out")))
    got = [(r.k, r.reply_at and r.reply_at.minute) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert (1, 20) in got and all(at is None for k, at in got if k == 2) and sum(k == 1 for k, _ in got) == 1
