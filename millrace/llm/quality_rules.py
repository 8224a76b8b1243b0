"""Quality rules: countable rules, then a hashed n-gram log-likelihood ratio of a trusted target to the raw corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, let, words

SYMBOLS = "#*$%&|<>"
#: Parts of the target, each scored against the others to set the threshold.
FOLDS = 5
#: Steps of a score that the threshold distinguishes.
STEPS = 10_000


#: Bits of a window's place; windows beyond so many are sorted with their whole hashes.
PLACE = 24


def with_repeated_words(rows: DataFrame, w: str, name: str, span: int = 3) -> DataFrame:
    """`rows` with `name`: words that stand in `span`-word windows found twice or more in the array `w`, the first
    finding included.

    Every word is hashed once; a window is the hash of its words' hashes. The upper bits of the windows' hashes, with
    their places below them, are sorted as plain numbers: a repeated window has a neighbour of equal upper bits. Where
    such neighbours' whole hashes differ (or places do not fit), whole hashes are sorted instead. The repeated places,
    sorted again, cover up to `span` words each: linear but for two sorts, however long or repetitive a text is.
    """
    low = (1 << PLACE) - 1
    place = lambda x: x.bitwiseAND(low).cast("int")
    alike = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), PLACE) == 0
    neighbour = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    whole = let(F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))), neighbour)
    rows = rows.withColumn("_raw", F.transform(w, lambda x: F.xxhash64(x)))
    rows = rows.withColumn("_win", F.transform(F.slice("_raw", span, F.greatest(F.size("_raw"), F.lit(1))), lambda x, i: F.xxhash64(*[F.get("_raw", i + k) for k in range(span - 1)], x)))
    rows = rows.withColumn("_sort", F.sort_array(F.transform("_win", lambda x, i: x.bitwiseAND(~low).bitwiseOR(i.cast("long")))))
    rows = rows.withColumn("_same", F.transform("_sort", lambda x, i: F.when(alike(x, F.get("_sort", i + 1)), F.get("_win", place(x)) == F.get("_win", place(F.get("_sort", i + 1))))))
    unsure = F.coalesce(F.array_contains("_same", False), F.lit(False)) | (F.size("_win") > low)
    found = F.filter("_sort", lambda x, i: F.get("_same", i).isNotNull() | F.get("_same", i - 1).isNotNull())
    rows = rows.withColumn("_at", F.sort_array(F.when(unsure, F.transform(whole, lambda x: x["i"])).otherwise(F.transform(found, place))))
    covered = F.transform("_at", lambda x, i: F.least(F.lit(span), F.coalesce(F.get("_at", i + 1) - x, F.lit(span))))
    rows = rows.withColumn(name, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.drop("_raw", "_win", "_sort", "_same", "_at")


def base_rules(docs: DataFrame, min_words: int = 50, max_repeated: int = 50) -> DataFrame:
    """doc_id, text, ws (its words) and the counts of the base rules. A null text has no words and no lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("ws", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    rows = rows.select(
        "doc_id",
        "ws",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    rows = with_repeated_words(rows, "ws", "n_repeat_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def gram_hashes(ws: Column) -> Column:
    """Hashes of an array's words, lower-cased: what the grams are made of."""
    return F.transform(ws, lambda w: F.xxhash64(F.lower(w)))


def _one(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _two(a: Column, b: Column, buckets: int) -> Column:
    return _one(a.bitwiseXOR(F.shiftrightunsigned(b, 13)), buckets)


def gram_buckets(ws: Column, buckets: int) -> Column:
    """Buckets of the one- and two-word grams of an array of words, lower-cased. A word is hashed once."""
    one = lambda h: F.transform(h, lambda x: _one(x, buckets))
    two = lambda h: F.transform(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda x, i: _two(F.get(h, i), x, buckets))
    return let(gram_hashes(ws), lambda h: F.concat(one(h), two(h)))


def gram_sum(h: Column, values: Column, start: Column, buckets: int) -> Column:
    """Sum of `values` (an array, from `start` on) over the buckets of all grams of the word hashes `h`; 0 without words."""
    at = lambda b: F.get(values, start + b)
    both = lambda x, y: at(_one(x, buckets)) + F.when(y.isNull(), 0).otherwise(at(_two(x, y, buckets)))
    ahead = F.slice(h, 2, F.greatest(F.size(h), F.lit(1)))
    return F.aggregate(F.zip_with(h, ahead, both), F.lit(0).cast("long"), lambda a, x: a + x)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def log_ratios(target: list[int], raw: list[int], scale: int) -> list[int]:
    """round(scale * log(target / raw)) of every bucket, both with 1 added."""
    all_target, all_raw = sum(target) + len(target), sum(raw) + len(raw)
    return [round(scale * (math.log((t + 1) / all_target) - math.log((r + 1) / all_raw))) for t, r in zip(target, raw, strict=True)]


def bucket_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, scale: int) -> list[list[int]]:
    """Ratios of every bucket against the whole target, then against the target without each of its FOLDS parts.

    Raw counts are over all documents, target counts over all those whose doc_id is in `trusted`. Documents
    and ids are dealt out by doc_id at every size: the ids grow with the input, so they are never broadcast. At most `buckets` * (FOLDS + 1) counts reach the driver.
    """
    good = trusted.where("doc_id is not null").select(F.col("doc_id").alias("good")).distinct().hint("shuffle_hash")
    flagged = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(good, F.col("doc_id") == F.col("good"), "left")
    part = F.when(F.col("good").isNotNull(), fold_of(F.col("doc_id"))).otherwise(FOLDS).alias("part")
    grams = flagged.select(part, F.explode(gram_buckets(words(F.col("text")), buckets)).alias("bucket"))
    parts = [[0] * buckets for _ in range(FOLDS + 1)]
    for r in grams.groupBy("part", "bucket").agg(F.count("*").alias("n")).collect():
        parts[r.part][r.bucket] = r.n
    raw, target = [sum(c) for c in zip(*parts, strict=True)], [sum(c) for c in zip(*parts[:FOLDS], strict=True)]
    without = [[t - c for t, c in zip(target, parts[k], strict=True)] for k in range(FOLDS)]
    return [log_ratios(t, raw, scale) for t in (target, *without)]


def held_out_floor(scored: DataFrame, trusted: DataFrame, low: float, spare: float) -> float:
    """The threshold that the trusted documents' held-out scores give: their `low` quantile, less `spare` of its distance to their median.

    Scores are counted by whole steps of 1 / STEPS, so that only distinct steps reach the driver and the quantiles are exact.
    """
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    steps = scored.where("not base_failed").join(ids, "doc_id", "left_semi").groupBy(F.floor(F.col("held_out") * STEPS).alias("step")).count()
    counts = sorted((r["step"], r["count"]) for r in steps.collect())
    total = sum(n for _, n in counts)

    def quantile(q: float) -> float:
        run = 0
        for step, n in counts:
            run += n
            if run > q * total:
                return step / STEPS
        return -math.inf

    return quantile(low) - spare * (quantile(0.5) - quantile(low)) if counts else -math.inf


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = 8192, threshold: float | None = None, min_words: int = 50, max_repeated: int = 50, scale: int = 10_000, low: float = 0.001, spare: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept.

    `score` is the mean log-likelihood ratio per n-gram (0 for a document without words), summed in whole numbers so
    that no order of rows changes it; a document is kept if no base rule fails and score >= `threshold`. `trusted` has
    the doc_ids of the trusted target; without any, every ratio falls to the raw counts' alone and all ratios compare
    with the uniform multinomial. Each row is judged by itself, so repeated rows fare alike.

    If no threshold is given, it follows from the data: trusted documents that pass the base rules are scored against
    the target without their own fifth of it, and held_out_floor() sets the threshold below these scores. It rises as
    the target grows and new clean documents resemble it more. Without such documents nothing is known of clean
    scores, and the base rules alone decide.
    """
    ratios = bucket_ratios(docs, trusted, buckets, scale)
    literal = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")  # noqa: E731 (folded to one literal)
    rows = base_rules(docs, min_words, max_repeated)
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1)) * F.lit(float(scale))
    whole = lambda h: gram_sum(h, literal(ratios[0]), F.lit(0), buckets)
    if threshold is not None:
        scored = rows.withColumn("score", let(gram_hashes(F.col("ws")), whole) / n).drop("ws")
    else:
        folds = literal([x for fold in ratios[1:] for x in fold])
        start = F.coalesce(fold_of(F.col("doc_id")), F.lit(0)) * buckets
        sums = let(gram_hashes(F.col("ws")), lambda h: F.struct(whole(h).alias("whole"), gram_sum(h, folds, start, buckets).alias("apart")))
        scored = rows.withColumn("_sums", sums).withColumn("score", F.col("_sums.whole") / n).withColumn("held_out", F.col("_sums.apart") / n)
        scored = cut(scored.drop("ws", "_sums"))
        threshold = held_out_floor(scored, trusted, low, spare)
        scored = scored.drop("held_out")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float(threshold))))
