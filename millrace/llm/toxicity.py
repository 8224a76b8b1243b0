"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import fit_margin
from .common import bounded_ids, cut, let, words

#: Words that speak to a reader, in the four languages of the corpus.
SECOND_PERSON = ["you", "your", "yours", "you're", "u", "ur", "yourself", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "ti", "tus", "usted", "ustedes", "vosotros"]
#: Signs that stand in for letters.
LOOKALIKE_FROM, LOOKALIKE_TO = "@4301!|$57", "aaeoiiisst"
MARKS = "*.-_,;:?\"'()[]{}#%&+=~^<>/\\`"
FEATURES = ["lexicon_density", "lexicon_hits", "lexicon_kinds", "strong_density", "strong_hits", "hidden_density", "addressed_density", "second_density", "capitals", "exclaims", "symbols", "obfuscated", "log_words"]
#: Lengths of the stems that inflections share.
STEMS = (4, 5, 7)


def plain(text: Column) -> Column:
    """Lower case, without marks: of a word, or of a text before it is split."""
    return F.translate(F.lower(text), MARKS + "!|$@", "")


def revealed(text: Column) -> Column:
    """Lower case, with lookalike signs within words read as letters and marks taken out."""
    return F.translate(F.translate(F.regexp_replace(F.lower(text), r"[!.,;:?|$]+(?=\s|$)", ""), LOOKALIKE_FROM, LOOKALIKE_TO), MARKS, "")


def entries(word: Column) -> Column:
    """What the lexicon may hold of a word: itself, and its first letters where it is longer."""
    return F.array(word, *[F.when(F.length(word) > k, F.concat(F.lit("^"), F.left(word, F.lit(k)))) for k in STEMS])


def learn_lexicon(train: DataFrame, label: str = "label", size: int = 400, min_docs: int = 4, min_odds: float = 2.0) -> dict[str, float]:
    """Up to `size` words and stems (marked ^) whose documents' odds of label 1 stand out most, with their smoothed log
    odds ratios."""
    total = train.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first()
    if not total.p or total.p == total.n:
        return {}
    seen = train.select(label, F.explode(F.array_distinct(F.flatten(F.transform(words(plain(F.col("text"))), entries)))).alias("e"))
    counts = seen.where(F.length("e") > 2).groupBy("e").agg(F.sum(label).alias("p"), F.count("*").alias("n")).where(F.col("p") >= min_docs)
    rest = total.n - total.p
    odds = F.log((F.col("p") + 0.5) / (total.p + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (rest + 1))
    top = counts.withColumn("odds", odds).where(F.col("odds") >= min_odds)
    return {r.e: r.odds for r in top.orderBy(F.desc(F.col("odds") * F.log1p("p")), "e").limit(size).collect()}


def holds(lexicon: list[str]):
    """Whether a word, or a stem of it, is in the lexicon."""
    by = {k: [e[1:] for e in lexicon if e[0] == "^" and len(e) == k + 1] for k in STEMS}
    tests = [lambda w, es=[e for e in lexicon if e[0] != "^"] or ["\x00"]: w.isin(es)]
    tests += [lambda w, k=k, es=es: (F.length(w) > k) & F.left(w, F.lit(k)).isin(es) for k, es in by.items() if es]

    def test(w: Column) -> Column:
        out = tests[0](w)
        for t in tests[1:]:
            out = out | t(w)
        return out

    return test


def dense_features(docs: DataFrame, lexicon: dict[str, float], strong_odds: float = 3.5) -> DataFrame:
    """The columns of `docs` and FEATURES of its text; a null text counts as empty. Entries from `strong_odds` on count
    as strong too. This and the lexicon's least odds were chosen by threefold cross-validation on training rows."""
    held, strong = (holds([e for e, odds in lexicon.items() if odds >= least]) for least in (0.0, strong_odds))
    hits = lambda t: F.filter(words(t), held)
    rows = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_w", words(plain(F.col("_t"))))
    rows = rows.withColumn("_l", F.filter("_w", held)).withColumn("_second", F.size(F.filter("_w", lambda w: w.isin(SECOND_PERSON))).cast("double"))
    found = F.size("_l").cast("double")
    signs = F.col("_t").rlike(r"[@0-9!|$]")
    rows = rows.withColumn("_hidden", F.when(signs, F.greatest(F.size(hits(revealed(F.col("_t")))) - F.size("_l"), F.lit(0))).otherwise(0).cast("double"))
    kind = lambda w: F.when(held(w), 1).when(w.isin(SECOND_PERSON), 2).otherwise(0)
    close = lambda m: F.size(F.filter(F.transform(m, lambda x, i: (x == 1) & F.array_contains(F.slice(m, F.greatest(i - 3, F.lit(0)) + 1, 7), 2)), lambda x: x))
    near = F.when((F.size("_l") > 0) & (F.col("_second") > 0), let(F.transform("_w", kind), close)).otherwise(0).cast("double")
    n = F.greatest(F.size("_w"), F.lit(1)).cast("double")
    chars = F.greatest(F.length("_t"), F.lit(1)).cast("double")
    share = lambda signs: (F.length("_t") - F.length(F.translate("_t", signs, ""))) / chars
    return rows.select(
        *docs.columns,
        ((found + F.col("_hidden")) / n).alias("lexicon_density"),
        F.log1p(found + F.col("_hidden")).alias("lexicon_hits"),
        F.size(F.array_distinct("_l")).cast("double").alias("lexicon_kinds"),
        (F.size(F.filter("_l", strong)) / n).alias("strong_density"),
        F.log1p(F.size(F.filter("_l", strong)).cast("double")).alias("strong_hits"),
        (F.col("_hidden") / n).alias("hidden_density"),
        (near / n).alias("addressed_density"),
        (F.col("_second") / n).alias("second_density"),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals"),
        share("!").alias("exclaims"),
        share("#*$%&|<>@").alias("symbols"),
        (F.regexp_count("_t", F.lit("[A-Za-z][@0-9$*!|]+[A-Za-z]")) / n).alias("obfuscated"),
        F.log1p(F.size("_w").cast("double")).alias("log_words"),
    )


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, rounds: int = 15, depth: int = 4, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (calibrated probability of label 1) and predicted of every document.

    `labels` has doc_id and label; up to `max_train` doc_ids, the first by hash, make the training sample. Three quarters
    of it (by hash) teach the lexicon and the trees, the rest the isotonic calibration. A doc_id with several labels
    counts as 1 if any is. A null text counts as empty; an empty table gives no rows; repeated rows fare alike. Where the
    labels cannot train anything the score is their mean (0 without any).
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    known = known.join(F.broadcast(bounded_ids(labels, max_train)), "doc_id")  # so bounded by max_train as well
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    sample = cut(chosen.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4))))
    fitting = sample.where("part < 3")
    lexicon = learn_lexicon(fitting)
    featured = cut(dense_features(sample, lexicon).drop("text").repartition(4, "doc_id"))
    add = fit_margin(featured.where("part < 3"), FEATURES, rounds=rounds, depth=depth)
    calibrating = add(featured.where("part = 3")).select("label", "margin")
    both = {r[0] for r in calibrating.select("label").distinct().collect()} == {0, 1}
    scored = add(dense_features(rows, lexicon)).select("doc_id", "margin")
    if both:
        # a margin that many copies share is one weighted point: the fit deals points out by margin
        points = calibrating.groupBy("margin").agg(F.avg(F.col("label").cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
        scale = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(points)
        out = scale.transform(scored)
    else:
        out = scored.withColumn("score", F.lit(float(sample.agg(F.avg("label")).first()[0] or 0.0)))
    out = out.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "margin")
