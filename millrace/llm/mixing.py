"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, words

#: Hex digits of the shuffling hash that name a piece of a source's order: 4,096 pieces are summed apart, so a hot
#: source becomes so many tasks' rows.
PIECE_DIGITS = 3
#: Ranges of a unit of virtual time that are sorted apart. Fair queueing sends words at an even rate, so ranges of equal
#: width hold about equal numbers of words up to time 1, whatever the sources' sizes.
RANGES, LAST_RANGE = 4096, 8 * 4096
#: Equal rows (doc_id, source, size) that one task numbers.
COPIES = 10_000


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target and budget (whole words, the same in every row) of a table (source, source_size).

    Sources by code point, null last, take `weights` in turn. Targets are `share` of all sizes, dealt by weight; one that
    would pass `most` times its source's size stops there and its excess is dealt again by weight until none does. The
    sources that stop are those with the least capacity per unit of weight, so one ordered pass finds them: in order of
    capacity / weight, a source stops if what is left of the budget, dealt over the weights left, reaches its capacity.
    """
    n = len(weights)
    # a row a source: the number of sources, not of documents, bounds these windows
    listed = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % n + 1).cast("int"))
    listed = listed.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = listed.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    listed = listed.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    listed = listed.withColumn("stops", F.col("level") * F.col("weight") >= F.col("cap"))
    # every stopping source precedes every other, so the level at the first that does not stop holds for all after it
    level = F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("weight")).alias("c"), "at", "level"))).over(everything)["level"]
    target = F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("weight"))
    return listed.select("source", "source_size", target.alias("target"), F.floor("budget").alias("budget"))


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, source, size) with `k`, the number of each among its equals, in any order: they are alike.

    Equals are counted before the shuffle; a row that stands very often is written out by many tasks.
    """
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    few = counted.where(F.col("n") <= COPIES).select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    many = counted.where(F.col("n") > COPIES).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition("a").select("doc_id", "source", "size", F.explode(F.sequence("a", F.least(F.col("a") + COPIES, F.col("n")) - 1)).alias("k"))
    return few.union(many)


def _along(*by: str) -> list:
    return [F.col(c).asc_nulls_last() for c in by]


def packets(docs: DataFrame, size: str = "size", weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """What the queues hold: doc_id, source, size, k, source_size, target, budget, round, tail, words, finish.

    Documents are shuffled by hash within their source, equal rows numbered by `k`. A packet is a document in one round of
    its source; there are `most` rounds (rounded up). Its finish time is the words of its source up to its end, over all
    rounds so far, divided by the source's target. The packet within which a source reaches its target is sent as two:
    up to the target, which finishes at time 1, and its `tail`. Documents without words have one packet of 0 words.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    rows = _numbered(cut(rows))  # what counts the words of texts runs once
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "k")
    rows = rows.withColumn("h", F.substring(F.md5(name), 1, 16)).withColumn("piece", F.substring("h", 1, PIECE_DIGITS))
    pieces = cut(rows.groupBy("source", "piece").agg(F.sum("size").alias("words")))
    upto = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    targets = source_targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), list(weights), share, most)
    before = before.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words")
    before = before.select(F.col("source").alias("s"), F.col("piece").alias("p"), "before", "source_size", "target", "budget")
    within = Window.partitionBy("source", "piece").orderBy(*_along("h", "doc_id", "size", "k")).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("run", F.sum("size").over(within)).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    rounds = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))).otherwise(F.array(F.lit(0)))
    sent = placed.withColumn("round", F.explode(rounds)).withColumn("end", F.col("before") + F.col("run") + F.col("round") * F.col("source_size"))
    stop, start = F.floor("target"), F.col("end") - F.col("size")
    split = (start < stop) & (stop < F.col("end"))
    part = lambda tail, words, finish: F.struct(F.lit(tail).alias("tail"), words.alias("words"), finish.alias("finish"))
    finish = F.when(F.col("target") > 0, F.col("end") / F.col("target")).otherwise(F.lit(float(LAST_RANGE)))
    whole = F.array(part(0, F.col("size"), finish))
    sent = sent.withColumn("x", F.explode(F.when(split, F.array(part(0, stop - start, F.lit(1.0)), part(1, F.col("end") - stop, finish))).otherwise(whole)))
    return sent.select("doc_id", "source", "size", "k", "source_size", "target", "budget", "round", "x.tail", "x.words", "x.finish")


def sent_in_order(queued: DataFrame, total_budget: int | None = None) -> DataFrame:
    """`queued` (of packets()) in the order of the mix: `mix_end`, the words up to each packet's end, and `taken`, those of
    its words that come before the total budget (by default the one that the targets were dealt from).

    Packets are sorted by finish time over all sources, range by range; a range's running sum starts at the sum of all
    ranges before it, a table of a row a range.
    """
    ranged = queued.withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(LAST_RANGE)))
    totals = ranged.groupBy("range").agg(F.sum("words").alias("w"))
    totals = totals.select(F.col("range").alias("r"), F.coalesce(F.sum("w").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    run = Window.partitionBy("range").orderBy(*_along("finish", "source", "doc_id", "size", "k", "round", "tail")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("run", F.sum("words").over(run)).join(totals, F.col("range") == F.col("r"))
    placed = placed.withColumn("mix_end", F.col("start") + F.col("run"))
    budget = F.lit(total_budget).cast("long") if total_budget is not None else F.col("budget")
    taken = F.greatest(F.lit(0), F.col("words") - F.greatest(F.lit(0), F.col("mix_end") - budget))
    return placed.withColumn("taken", taken).select(*queued.columns, "mix_end", "taken")


def mix_sources(docs: DataFrame, total_budget: int | None = None, **options) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, finish (of its first packet) and mix_end (the
    words of the mix up to the end of its first packet; null for a document that the mix takes nothing of).

    `taken` sums the words of the document's packets that the sorted run holds before it is truncated at the total
    budget, so a document is taken `most` times at most, and a source ends within a few words of its target: what the
    targets' fractions leave of the budget goes to the packets that finish next. `docs` has doc_id, source and the
    column `size`; null sizes count as 0, other columns are not read. Repeated rows are items of their own, told apart by
    number, so all rows of one doc_id, or of a null one, spread over the order like others. An empty table gives an
    empty mix. Running sums are taken in two levels, so no task holds a whole source.
    """
    sent = sent_in_order(packets(docs, **options), total_budget)
    first = F.min(F.struct("finish", "round", "tail", F.when(F.col("taken") > 0, F.col("mix_end")).alias("mix_end"))).alias("first")
    out = sent.groupBy("doc_id", "source", "size", "k", "source_size", "target").agg(F.sum("taken").alias("taken"), first)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "first.finish", "first.mix_end")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with all columns of `docs`: a document once for every whole time that it is taken, and once
    more cut to its first words where the run ends within it (text, and n_chars where there is one, then follow).

    Rows that agree in doc_id, source and size share what they are given evenly, in whole words. Null and empty texts
    have no words and are never taken; a very long text is a document like others; columns may have any names. An empty
    table gives no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col("text")).alias("size"))
    placed = mix_sources(rows.select("row.doc_id", "row.source", "size"), **options)
    given = placed.where("taken > 0").groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"))
    given = given.agg(F.floor(F.sum("taken") / F.count("*")).alias("taken"))
    same = F.col("row.doc_id").eqNullSafe(F.col("d")) & F.col("row.source").cast("string").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    out = rows.join(given, same).drop("d", "s", "z")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    times = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("cut", F.explode(times))
    text = F.when(F.col("cut") > 0, F.array_join(F.slice(words(F.col("row.text")), 1, F.greatest("cut", F.lit(1))), " ")).otherwise(F.col("row.text"))
    out = out.withColumn("text", text)
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
