"""URL filters: allow and block rules, then gradient-boosted trees over lexical features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import fit_margin
from .common import cut, let
from .line_dedup import LOWER, UPPER

#: The rules of the driver's query, as (verdict, host and path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SUFFIX_BUCKETS = 256
#: Parts of the training sample whose suffix rates come from the others.
FOLDS = 5
FEATURES = ["n_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "hyphen_ratio", "entropy", "params", "fragment", "secure", "tld_rate", "site_rate"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://`, A-Z of the host lower-cased; both empty for a url that is null or has none."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent of it and the path's start, else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + prefix))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Bits per character. Characters are sorted, so that equal ones form runs: linear but for the sort."""
    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        ends = F.filter(F.transform(chars, lambda c, i: F.when(F.coalesce(F.get(chars, i + 1) == c, F.lit(False)), None).otherwise(i + 1)), lambda i: i.isNotNull())
        runs = lambda e: F.transform(e, lambda i, k: i - F.when(k > 0, F.get(e, k - 1)).otherwise(0))
        bits = F.aggregate(let(ends, runs), F.lit(0.0), lambda a, m: a - m / n * F.log2(m / n))
        return F.when(F.size(chars) == 0, 0.0).otherwise(bits)

    return let(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), of)


def _suffix(n: int) -> Column:
    labels = F.split("host", r"\.")
    return F.pmod(F.xxhash64(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(pages: DataFrame) -> DataFrame:
    """`pages` (with url, host and path) and the features but for the suffix rates."""
    n = F.greatest(F.length("url"), F.lit(1)).cast("double")
    without = lambda chars: F.length("url") - F.length(F.translate("url", chars, ""))
    return pages.select(
        "*",
        F.length("url").cast("double").alias("n_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (without("0123456789") / n).alias("digit_ratio"),
        (without("-_") / n).alias("hyphen_ratio"),
        entropy(F.col("url")).alias("entropy"),
        F.when(F.instr("url", "?") > 0, F.length(F.substring_index("url", "?", -1)) - F.length(F.translate(F.substring_index("url", "?", -1), "&", "")) + 1).otherwise(0).cast("double").alias("params"),
        (F.instr("url", "#") > 0).cast("double").alias("fragment"),
        F.startswith("url", F.lit("https")).cast("double").alias("secure"),
        _suffix(1).alias("_tld"),
        _suffix(2).alias("_site"),
    )


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, max_train: int = 20_000) -> DataFrame:
    """page_id, url, host, path, rule, verdict and margin of every page.

    URLs that a rule fits are the labelled URLs: up to `max_train` different ones, the first by hash, train the trees,
    and the trees judge the rest (block if the margin is below 0). Suffix statistics are the training URLs' rates of
    `allow` by hashed last label and last two labels of the host, drawn towards the overall rate, in a fixed number of
    buckets; a training URL's own rates are those of the other FOLDS - 1 parts of the sample, so that they tell the trees
    no more than they can know of new URLs. Rows are judged one by one: repeated rows fare alike, a null, empty or odd
    url has empty parts and counts as one more URL, a very long one is read whole, other columns are not read; an empty
    table gives no rows. Without labelled URLs of both kinds the margin is 0 and the verdict of the rest is allow.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").alias("given"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("judged", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.where("judged is not null").select("url", "host", "path", (F.col("judged.verdict") == "allow").cast("int").alias("label"))
    train = labelled.dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(max_train).repartition(4, "url")
    train = cut(lexical(train).withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(FOLDS)).cast("int")))
    prior = train.agg(F.avg("label")).first()[0] or 0.0

    def rates(key: str) -> tuple[Column, Column]:
        """(rate by `key` over the whole sample, rate over it without the row's own fold)."""
        held = {(r[key], r.fold): (r.p, r.n) for r in train.groupBy(key, "fold").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()}  # at most SUFFIX_BUCKETS * FOLDS rows
        rate = lambda b, left: (sum(held.get((b, f), (0, 0))[0] for f in left) + 2 * prior) / (sum(held.get((b, f), (0, 0))[1] for f in left) + 2)
        table = [rate(b, [f for f in range(FOLDS) if f != k]) for k in range(FOLDS + 1) for b in range(SUFFIX_BUCKETS)]
        values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
        return F.get(values, F.lit(FOLDS * SUFFIX_BUCKETS) + F.col(key)), F.get(values, F.col("fold") * SUFFIX_BUCKETS + F.col(key))

    (tld, other_tld), (site, other_site) = rates("_tld"), rates("_site")
    fitted = fit_margin(train.withColumn("tld_rate", other_tld).withColumn("site_rate", other_site), FEATURES)
    scored = fitted(lexical(rows).withColumn("tld_rate", tld).withColumn("site_rate", site))
    verdict = F.coalesce(F.col("judged.verdict"), F.when(F.col("margin") < 0, "block").otherwise("allow"))
    return scored.select("page_id", F.col("given").alias("url"), "host", "path", F.col("judged.rule").alias("rule"), verdict.alias("verdict"), "margin")
