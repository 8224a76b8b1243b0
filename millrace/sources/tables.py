"""Sources and sinks: tables, collections, streams, chunked files, logs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors share: below spark.checkpoint.dir, else a temporary one (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/flow-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_instants(df: DataFrame) -> DataFrame:
    """Timestamps without zone as instants (in the session's zone): watermarks take no others."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as messages: seq, payload_type, actor, value, ts, props."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("payload_type"), F.col("user_id").alias("actor"), "value", "ts", "props")


def collection(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small collection as messages in the order given (column seq)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, " + schema)


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; `files_per_trigger` is the demand of one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def monitor(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Ticks as a stream, for periodic reports."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A Kafka topic from its end on; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()


def chunked(df: DataFrame, text: str, size: int = 65_535, name: str = "chunk") -> DataFrame:
    """Texts in chunks of `size` characters, numbered from 0 in `chunk_at`; an empty text has none."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("chunk_at", F.explode(at)).withColumn(name, F.substring(F.col(text), F.col("chunk_at") * size + 1, F.lit(size)))


def joined_chunks(df: DataFrame, keys: list[str], at: str = "chunk_at", chunk: str = "chunk", name: str = "text") -> DataFrame:
    """The inverse of chunked: a text's chunks, in their order, as one text."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(chunk).alias("chunk"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "").alias(name))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files below `path`, in the order of their paths; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").orderBy("path")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The first row of a key."""
    return df.where(F.col(key) == value).limit(1)


def log_line(df: DataFrame, at: str, sender: str, destination: str, seq: str, kind: str, payload: str) -> DataFrame:
    """One text line a message."""
    return df.select(F.col(seq), F.format_string("%s SENDER: %s DESTINATION: %s SEQ: %d TYPE: %s PAYLOAD: %s", F.col(at).cast("string"), F.col(sender).cast("string"), F.col(destination).cast("string"), F.col(seq), F.col(kind), F.col(payload).cast("string")).alias("line"))


def append(df: DataFrame, path: str) -> None:
    """A durable log: whole files, appended."""
    df.write.mode("append").parquet(path)


def swallow(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
