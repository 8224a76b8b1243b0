"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WS)), UPPER, LOWER)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text (without dropped lines), n_lines, n_dropped.

    Keys of at least `min_chars` code points found under at least `min_docs` different doc_ids lose all their lines
    except in the largest doc_id that holds them. A null or empty text is one empty line. Repeated rows of a doc_id
    count once and fare alike; rows with a null doc_id hold no key and keep all their lines. Keys meet as pairs of
    independent 64-bit hashes; counts are combined before they are shuffled, so a line that a third of all documents
    hold reaches its reducer as a row a task.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = rows.select("doc_id", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= min_chars), line_key))).alias("key")).where(F.length("key") >= min_chars)
    held = lines.where("doc_id is not null").select("doc_id", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g"))
    common = held.distinct().groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    common = cut(common.select("h", "g", "keeper"))  # a table, so that a key many documents hold can be split in the join
    gone = held.join(common, ["h", "g"]).where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("h", "g"))).alias("gone"))
    marked = rows.join(gone, "doc_id", "left")
    parts = F.split("text", "\n")
    stays = lambda x: (F.length(x) < min_chars) | F.coalesce(F.element_at("gone", F.xxhash64(line_key(x))) != F.xxhash64(F.lit(7), line_key(x)), F.lit(True))
    kept = F.when(F.col("gone").isNull(), parts).otherwise(F.filter(parts, stays))
    done = marked.select("doc_id", F.size(parts).cast("long").alias("n_lines"), kept.alias("kept"))
    return done.select("doc_id", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))
