"""Classifiers: held-out accuracy, degenerate labels, odd rows; URL rules against brute force."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.quality_classifier import quality_scores
from millrace.llm.toxicity import toxicity
from millrace.llm.url_filter import RULES, url_filter

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def accuracy(spark, out, label):
    held = out.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    return {r[label]: r.share for r in held.groupBy(label).agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("share")).collect()}


@needs_data
def test_toxicity_holds_out(spark):
    out = queries.op2_toxicity(spark, SF).cache()
    got = accuracy(spark, out, "toxic")
    assert got[0] > 0.95 and got[1] > 0.6
    assert out.where("score is null or score < 0 or score > 1").count() == 0 and out.count() == 1000


@needs_data
def test_quality_holds_out(spark):
    out = queries.op3_quality(spark, SF).cache()
    got = accuracy(spark, out, "quality")
    assert got[1] > 0.97 and got[0] > 0.7
    assert out.where("score is null or score < 0 or score > 1").count() == 0 and out.count() == 1000


SCHEMA = "doc_id long, text string, label string, score string, predicted string, margin double, part int, h int"


def odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, "\n\t"), (5, "you IDIOT!! l0ser"), (5, "you IDIOT!! l0ser"), (None, "a b")]
    return spark.createDataFrame([(*r, "l", "s", "p", 0.5, 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("score", [toxicity, quality_scores])
@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (9, 0), (None, 1), (5, None)], [(1, 0), (5, 1), (5, 0), (3, 1), (2, 0)]])
def test_scores_survive_odd_rows_and_few_labels(spark, score, labels):
    known = spark.createDataFrame(labels, "doc_id long, label int")
    out = score(odd_rows(spark), known).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    assert score(odd_rows(spark).limit(0), known).count() == 0


def rule_brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in RULES:
        at, prefix = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def test_url_filter_follows_the_rules(spark):
    rng = random.Random(6)
    hosts = ["org", "ORG", "a.org", "example.org", "x.Example.ORG", "notexample.org", "b.com", "com", "d.net", "org:80", "É.org", ""]
    paths = ["", "/", "/fr/", "/fr", "/de/x?y=1", "/es/1#t", "/en/1", "/en/12", "/en/2?a=1&b=2", "?q=/fr/", "#://a.org/"]
    urls = [f"{rng.choice(['http', 'https', 'x://y'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c.org/", "http://" + "z" * 50_000 + ".com/"]
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, path string, label string")
    out = url_filter(df).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        host, path, rule, verdict = rule_brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_filter(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter(df.where("url like '%.net%'")).collect()} == {"allow"}


def test_one_url_repeated_beyond_the_sample_changes_nothing(spark):
    rng = random.Random(2)
    urls = [f"http://{rng.choice('abc')}{i}.{rng.choice(['org', 'com'])}/{rng.choice(['fr', 'de'])}/{i}?x={i}" for i in range(300)] + [f"http://n{i}.net/de/{i}" for i in range(20)]
    once = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    first = once.where("url like '%/fr/%'").select("url").first().url
    often = once.union(spark.range(1000, 1400).select("id", F.lit(first)))
    margins = [{r.page_id: round(r.margin, 9) for r in url_filter(df, max_train=100).where("page_id < 1000").collect()} for df in (once, often)]
    assert margins[0] == margins[1] and len(set(margins[0].values())) > 1


def test_entropy_and_lexical_features_equal_brute_force(spark):
    import math
    from collections import Counter

    from millrace.llm.url_filter import lexical, url_parts

    urls = ["", "aaaa", "https://a-b.example.org/x/y1//z?a=1&b=2#t", "http://é.com", "x" * 3000 + "://q.w.e/", "no?a&b&c"]
    host, path = url_parts(F.col("url"))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"host": host, "path": path})
    for r in lexical(df).collect():
        u, n = r.url, max(1, len(r.url))
        assert abs(r.entropy - -sum(c / n * math.log2(c / n) for c in Counter(u).values())) < 1e-9
        assert (r.n_chars, r.host_chars, r.path_chars) == (len(u), len(r.host), len(r.path))
        assert r.depth == sum(1 for x in r.path.split("/") if x) and r.labels == len(r.host.split("."))
        assert abs(r.digit_ratio - sum(c.isascii() and c.isdigit() for c in u) / n) < 1e-12 and abs(r.hyphen_ratio - sum(c in "-_" for c in u) / n) < 1e-12
        assert r.params == (u.split("?", 1)[1].count("&") + 1 if "?" in u else 0) and r.fragment == ("#" in u) and r.secure == u.startswith("https")


@needs_data
def test_url_trees_learn_the_rules_of_known_sites(spark):
    out = url_filter(spark.read.parquet(f"{SF}/pages.parquet"))
    agree = out.where("rule is not null").agg(F.avg(((F.col("margin") >= 0) == (F.col("verdict") == "allow")).cast("int"))).first()[0]
    assert agree > 0.8
