"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate
from millrace.llm import jaccard_join as jj
from millrace.llm import mixing
from millrace.llm import suffix_array as suffix_arrays
from millrace.llm import suffix_dedup as sd
from millrace.llm.common import n_words
from millrace.llm.decontaminate import MASKS, SHORT, leaks, offsets, without_leaks
from millrace.llm.line_dedup import line_dedup
from millrace.llm.mixing import mix_sources, mixed_documents, packets, sent_in_order
from millrace.llm.quality_rules import base_rules, bucket_ratios, gram_buckets, log_ratios, quality_rules
from millrace.llm.suffix_array import permuted_prefixes, suffix_array
from millrace.llm.token_binary import DacFile, encode, encoder, token_binary

#: Columns whose names the operators use inside.
ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, at int, rep string, score string, n int, end string, label string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=5, n=60):
    """doc_id -> text: originals, exact and near copies, shared passages and lines, long, odd and empty texts."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 300)) for _ in range(n // 3)]
    shared = " ".join(words(rng, 60))
    texts = {}
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(9)
        t = " ".join(w)
        if i % 4 == 0:
            t += "\n" + shared + "\n Tail  " + str(i % 3)
        texts[i] = t
    texts[n] = ""
    texts[n + 1] = None
    texts[n + 2] = "é ü  " * 80
    texts[n + 3] = "one two"
    texts[n + 4] = "ONE two!"
    texts[n + 5] = "a" * 2500
    texts[n + 6] = " ".join(words(rng, 40_000, 3000))
    texts[n + 7] = texts[n + 6]
    texts[n + 8] = "\n\n\t \r\n" + shared.upper() + "\x0b"
    return texts


def frame(spark, texts, parts=3):
    rows = [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", None, 1, 2, 3, "r", "s", 4, "e", "l") for i, t in texts.items()]
    rows.append((None, "no id " * 60, None, None, None) + (None,) * 8)
    return spark.createDataFrame(rows, ODD).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], ODD)


def shingle_set(text):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows):
    """rows: (doc_id, text), repeats included -> {doc_id: (class, links)}."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    links, parent = defaultdict(int), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (k, y) = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(i), find(k)))
                parent[q] = p
    return sorted((i, find(i), links[a]) for a, (i, _) in enumerate(sets))


@pytest.mark.parametrize("leaf,block", [(256, 512), (3, 4)])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jj, "LEAF", leaf)
    monkeypatch.setattr(jj, "BLOCK", block)
    texts = corpus(seed=leaf)
    df = frame(spark, texts)
    df = df.union(df.where("doc_id in (1, 2)"))  # repeated rows
    out = jj.jaccard_join(df, recall=0.9999)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in out.collect())
    assert got == jaccard_brute([*texts.items(), (1, texts[1]), (2, texts[2])])
    assert jj.jaccard_join(empty(spark)).count() == 0


def test_sketches_agree_like_sets():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64)
    for size in (1, 5, 40, 900):
        a = np.unique(rng.choice(pool, size, replace=False))
        b = a[: max(1, int(size * 0.9))]
        same = np.mean([np.mean(np.equal(*jj.sketches([np.unique(jj.mix(a + np.uint64(k))), np.unique(jj.mix(b + np.uint64(k)))]))) for k in range(30)])
        assert abs(same - len(b) / len(a)) < 0.06


def suffix_brute(texts, length):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot,wide,shard", [(32, 4096, 1 << 20), (2, 4096, 2000), (10**9, 2, 2000)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot, wide, shard):
    monkeypatch.setattr(sd, "HOT_LEAST", hot)
    monkeypatch.setattr(sd, "SAMPLE", 1)
    monkeypatch.setattr(sd, "WIDE_CONTEXTS", wide)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    texts = {d: t if t is None or len(t) < 20_000 else t[:20_000] for d, t in corpus(seed=hot % 97).items()}
    df = frame(spark, texts)
    out = sd.suffix_dedup(df.union(df.where("doc_id = 4")), length=100)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
    want = Counter((d, *v) for d, v in suffix_brute(texts, 100).items())
    odd = ("no id " * 60).encode()
    want[(None, len(odd), 0, 0, hashlib.sha256(odd).hexdigest())] += 1
    want.update(k for k in list(want) if k[0] == 4)
    assert got == want
    assert sd.suffix_dedup(empty(spark)).count() == 0


def test_suffix_dedup_takes_long_documents_in_parts(monkeypatch):
    monkeypatch.setattr(sd, "STEP_BYTES", 64)
    text = "".join(chr(97 + i * i % 7) for i in range(3000)).encode()
    h, c, doc, at, n, off = sd.context_runs([text, text[:50]], 100, np.zeros(0, np.uint64))
    assert set(doc) == {0} and sorted(x for a, m in zip(at, n) for x in range(a, a + m)) == list(range(2901))


def judged_contexts(texts, batch=10_000):
    """(anchor, document, at) of the contexts that go on to the suffix array."""
    runs = sd.context_runs(texts, 100, np.zeros(0, np.uint64))
    h, c, doc, at = runs[0].view(np.int64), runs[1].view(np.int64), runs[2], runs[3]
    order = np.lexsort((at, doc, c, h))
    whole = sd._batch(*(v[order] for v in runs), np.zeros(len(h), bool))
    out = [r for b in sd._compare(whole.slice(i, batch) for i in range(0, len(h), batch)) for r in b.to_pylist()]
    return {(r["h"], r["doc_id"], r["at"]) for r in out if not r["known"]}, runs


def test_suffix_dedup_settles_chance_meetings_before_the_suffix_array(monkeypatch):
    rng = np.random.default_rng(7)

    def noise(n):
        return bytes(rng.integers(97, 123, n, dtype=np.uint8))

    met = 0
    for _ in range(40):  # an anchor in common, no window
        shared = noise(60)
        texts = [noise(150) + shared + noise(150) for _ in range(2)]
        found, runs = judged_contexts(texts)
        assert not found
        met += len(set(runs[0][runs[2] == 0]) & set(runs[0][runs[2] == 1]))
    assert met
    for held, batch in ((1 << 18, 10_000), (1 << 18, 3), (2, 3), (1, 1)):  # every context with a window in common goes on
        monkeypatch.setattr(sd, "HELD", held)
        for size in (100, 101, 117, 134, 160):
            shared = noise(size)
            texts = [noise(150) + shared + noise(150) for _ in range(5)] + [noise(300)]
            found, (h, c, doc, at, n, _) = judged_contexts(texts, batch)
            windows = {}
            for x in zip(h.view(np.int64).tolist(), doc.tolist(), at.tolist(), n.tolist(), c.tolist()):
                for a in range(x[2], x[2] + x[3]):
                    windows.setdefault(texts[x[1]][a : a + 100], []).append(x)
            firsts = {}  # of equal contexts only the first goes on
            for x in sorted(zip(h.view(np.int64).tolist(), c.tolist(), doc.tolist(), at.tolist())):
                firsts.setdefault(x[:2], x[2:])
            want = {(x[0], *firsts[x[0], x[4]]) for xs in windows.values() if len({(x[0], x[4]) for x in xs}) > 1 for x in xs}
            assert want and want <= found


def test_suffix_dedup_sends_no_bytes_of_wide_contexts():
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    rows = [{"doc_id": 1, "text": text, "contexts": [{"h": -5, "at": 20, "n": 30, "wide": True}, {"h": 6, "at": 90, "n": 3, "wide": False}]}, {"doc_id": 2, "text": text[20:], "contexts": [{"h": -5, "at": 10, "n": 3, "wide": True}]}]
    got = [r for b in sd._contexts(100)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["at"], r["n"]) for r in got if r["bytes"] is None] == [(1, 20 + i, 1) for i in range(30)] + [(2, 10 + i, 1) for i in range(3)]
    assert [(r["h"], r["doc_id"], r["at"], r["n"], r["bytes"]) for r in got if r["bytes"] is not None] == [(6, 1, 90, 3, text[90:192].encode())]
    keys = {(r["doc_id"], r["at"]): (r["h"], r["c"]) for r in got}
    assert keys[2, 10] == keys[1, 30] and len(set(keys.values())) < len(keys)
    removed = [r for b in sd._shards(100)([pa.RecordBatch.from_pylist(sorted(got, key=lambda r: (r["h"], r["c"], r["doc_id"], r["at"])), schema=pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())]))]) for r in b.to_pylist()]
    assert {(r["doc_id"], a) for r in removed for a in range(r["at"], r["at"] + r["n"])} >= {(2, 10), (2, 11), (2, 12)}


@pytest.mark.parametrize("bucket", [1, 8, 256, 1 << 40])  # buckets as vectors at all levels, at some, in none
def test_suffix_array_and_prefixes(monkeypatch, bucket):
    monkeypatch.setattr(suffix_arrays, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    for k in range(60):
        t = np.append(rng.integers(1, rng.integers(2, 6) if k % 3 else 5_000, rng.integers(1, 90)), 0)
        if k % 4 == 0:
            t = np.append(np.tile(t[:-1], 3), 0)
        sa, flat = suffix_array(t), t.tolist()
        assert sa.tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])
        phi, plcp = permuted_prefixes(t, sa, 20)
        for i in range(len(flat)):
            j, n = phi[i], 0
            while j < len(flat) and n < 20 and i + n < len(flat) and j + n < len(flat) and flat[i + n] == flat[j + n]:
                n += 1
            assert plcp[i] == n


def line_brute(texts):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(low)
    held = defaultdict(set)
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    out = set()
    for d, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == d]
        out.add((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    texts = corpus()
    df = frame(spark, texts)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(df.union(df.where("doc_id = 0"))).collect() if r.doc_id is not None)
    want = Counter(line_brute(texts))
    want.update(k for k in list(want) if k[0] == 0)
    assert got == want and any(k[2] for k in got)
    assert line_dedup(empty(spark)).count() == 0


def base_brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_rules_equal_brute_force(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice("abc") + rng.choice(["", "#", "|", "\n", "\t"]) for _ in range(rng.randrange(0, 90))) for i in range(60)}
    texts |= {100 + i: t for i, t in corpus().items()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in base_rules(frame(spark, texts)).collect()}
    assert {d: got[d] for d in texts} == {d: base_brute(t) for d, t in texts.items()}


def test_quality_rules_drop_what_the_target_lacks(spark):
    rng = random.Random(3)
    good = {i: " ".join(f"w{rng.randrange(50)}" for _ in range(120)) for i in range(80)}
    bad = {100 + i: " ".join(f"buy{rng.randrange(40)} ###" for _ in range(80)) for i in range(10)}
    df = frame(spark, good | bad)
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "doc_id long")
    out = {r.doc_id: r for r in quality_rules(df, trusted, buckets=1024, threshold=-0.6).collect()}
    assert not any(out[i].base_failed for i in good) and min(out[i].score for i in good) > max(out[i].score for i in bad)
    assert all(out[i].kept for i in good) and not any(out[i].kept for i in bad)
    again = {r.doc_id: r.score for r in quality_rules(df.repartition(5), trusted, buckets=1024).collect()}
    assert again == {d: r.score for d, r in out.items()}
    assert quality_rules(empty(spark), trusted).count() == 0
    assert quality_rules(df, trusted.limit(0), buckets=1024).count() == len(out)


def test_quality_rules_set_their_threshold_by_held_out_scores(spark):
    rng = random.Random(4)
    good = {i: " ".join(f"w{rng.randrange(30)}" for _ in range(150)) for i in range(400)}
    bad = {1000 + i: " ".join(f"w{rng.randrange(30)}" if j % 15 else f"buy{rng.randrange(9)}" for j in range(150)) for i in range(30)}
    df = frame(spark, good | bad)
    trusted = spark.createDataFrame([(i,) for i in range(0, 400, 2)] + [(None,)], "doc_id long")
    out = {r.doc_id: r for r in quality_rules(df, trusted).collect()}
    assert not any(out[i].base_failed for i in good | bad) and min(out[i].score for i in bad) > -0.2
    assert not any(out[i].kept for i in bad) and all(out[i].kept for i in good), (max(out[i].score for i in bad), sorted(out[i].score for i in good)[:3])
    assert {r.doc_id for r in quality_rules(df, trusted.limit(0)).collect() if r.kept} == {r.doc_id for r in out.values() if not r.base_failed}


def test_quality_ratios_count_every_trusted_document(spark):
    n = 20_100
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text")).union(spark.createDataFrame([(None, "w1")] * 5, "doc_id long, text string"))
    trusted = spark.range(n).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(3,), (None,)], "doc_id long"))
    counts = Counter(i % 7 for i in range(n))
    bucket = {r.w: r.b[0] for r in spark.range(7).select(F.col("id").alias("w"), gram_buckets(F.array(F.concat(F.lit("w"), "id")), 64).alias("b")).collect()}
    target, raw = [0] * 64, [0] * 64
    for w, b in bucket.items():
        target[b] += counts[w]
        raw[b] += counts[w] + 5 * (w == 1)
    few = bucket_ratios(docs, trusted, 64, 10_000)
    assert few[0] == log_ratios(target, raw, 10_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert bucket_ratios(docs, trusted, 64, 10_000) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def mix_brute(rows, weights=(3, 1, 2), share=1.5, most=2, seed=17):
    """rows (doc_id, source, size) -> Counter of (doc_id, source, size, source_size, target, taken), item by item."""
    total = defaultdict(int)
    for _, s, z in rows:
        total[s] += z
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(most * total[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    met, items = Counter(), defaultdict(list)
    for d, s, z in rows:
        k = met[d, s, z]
        met[d, s, z] += 1
        h = hashlib.md5(f"{seed}|{'' if d is None else d}|{z}|{k}".encode()).hexdigest()[:16]
        items[s].append((h, (d is None, d), z, k))
    queue, taken = [], Counter()
    for s in names:
        end, goal = 0, int(target[s])
        for r in range(most):
            for h, d, z, k in sorted(items[s]):
                start, end = end, end + z
                for tail, words, finish in [(0, goal - start, 1.0), (1, end - goal, end / target[s])] if start < goal < end else [(0, z, end / target[s] if target[s] else 0)]:
                    queue.append((finish, s is None, s or "", d, z, k, r, tail, words))
    room = int(share * sum(total.values()))
    for f, n, s, d, z, k, r, tail, words in sorted(queue):
        got = min(words, room)
        room -= got
        taken[None if n else s, d[1], z, k] += got
    return Counter((d, s, z, total[s], round(target[s], 6), taken[s, d, z, k]) for (d, s, z), n in met.items() for k in range(n))


def mix_rows(rng, n, sources="bacd"):
    rows = [(i, "w " * rng.choice([0, 1, 30, 400]), None if i % 11 == 0 else rng.choice(sources)) for i in range(n)]
    return rows + [(5, "w w", "a")] * 30 + [(None, "w", None), (None, None, "a"), (None, "w w w", "a"), (None, "w w w", "a")]


@pytest.mark.parametrize("sources,copies,share", [("bacd", 10_000, 1.5), ("a", 7, 1.5), ("abcdefgh", 7, 0.4), ("ab", 10_000, 5.0)])
def test_mix_equals_item_by_item(spark, monkeypatch, sources, copies, share):
    monkeypatch.setattr(mixing, "COPIES", copies)
    rows = mix_rows(random.Random(len(sources)), 300, sources)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", n_words(F.col("text"))).withColumn("end", F.lit("clash")).withColumn("k", F.lit("clash"))
    got = Counter((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(df, share=share).collect())
    assert got == mix_brute([(d, s, len((t or "").split())) for d, t, s in rows], share=share)


def test_mix_meets_its_targets(spark):
    rows = mix_rows(random.Random(8), 800)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", n_words(F.col("text"))).withColumn("end", F.lit("clash"))
    placed = mix_sources(df).collect()
    assert len(placed) == len(rows)
    by = defaultdict(list)
    for r in placed:
        by[r.source].append(r)
    total = sum(r.size for r in placed)
    assert abs(sum(r[0].target for r in by.values()) - 1.5 * total) < 1e-6
    for r in by.values():
        assert abs(sum(x.taken for x in r) - r[0].target) <= len(by) and all(0 <= x.taken <= 2 * x.size for x in r)
    assert sum(r.taken for r in placed) == int(1.5 * total)
    assert sorted(map(repr, placed)) == sorted(map(repr, mix_sources(df.repartition(7)).collect()))
    order = sent_in_order(packets(df)).where("words > 0").orderBy("mix_end").collect()
    run = 0
    for r in order:
        run += r.words
        assert r.mix_end == run and r.taken == max(0, r.words - max(0, run - int(1.5 * total)))
    assert [r.finish for r in order] == sorted(r.finish for r in order)
    assert mix_sources(df, total_budget=1000).agg(F.sum("taken")).first()[0] == 1000
    docs = mixed_documents(df.drop("size", "end"))
    assert abs(docs.agg(F.sum(n_words(F.col("text")))).first()[0] - sum(r.taken for r in placed)) <= 6
    none = empty(spark)
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0


def test_mixed_documents_keep_columns_of_any_name(spark):
    names = ["_id", "_source", "_size", "_taken", "_cut", "row", "d", "s", "z", "k", "taken", "cut", "size"]
    df = spark.createDataFrame([(i, f"w{i} " * 9, "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(40)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    out = mixed_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names) and all(set(r.text.split()) == {f"w{r.doc_id}"} for r in got)


def test_leaks_are_caught_with_substitutions_and_clean_texts_left(spark):
    rng = random.Random(1)
    items = {k: words(rng, n, 500) for k, n in enumerate([15, 30, 60, 7, 3])}
    texts, want = {}, set()
    for d in range(40):
        w = words(rng, 200, 500)
        if d % 2:
            k = rng.randrange(4)
            p = list(items[k])
            if len(p) >= 30:
                for j in rng.sample(range(len(p)), len(p) // 10):
                    p[j] = "other"
            at = rng.choice([0, 50, 200])
            w[at:at] = p
            want.add((d, k))
        texts[d] = " ".join(w).upper() if d % 3 else ", ".join(w)
    texts |= {50: None, 51: "", 52: "w1"}
    df = frame(spark, texts)
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items.items()] + [(90, None, "x"), (None, "a b c d e f", "y")], "item_id int, text string, doc_id string")
    found = leaks(df.union(df.where("doc_id = 1")), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and found.count() == len(want)
    clean = without_leaks(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {None, *texts} - {d for d, _ in want}
    assert leaks(empty(spark), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize(("masks", "lengths"), [(MASKS, range(10, 25)), (SHORT, range(5, 10))])
def test_seeds_survive_every_quarter_of_substitutions(masks, lengths):
    for n in lengths:
        faults = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 4)], dtype=np.int64)
        for mask in masks:
            for at in range(n - len(mask) + 1):
                faults = faults[faults & (sum(1 << o for o in offsets(mask)) << at) != 0]
        assert len(faults) == 0, n


def leak_brute(texts, items, least=8):
    """(doc_id, item_id) for which some alignment has 75 % of a window of 24 words, the item or the document equal."""
    found = set()
    for (d, w), (k, p) in itertools.product(texts.items(), items.items()):
        n, size = len(p), min(24, len(p))
        places = {x: [j for j, y in enumerate(w) if y == x] for x in p}
        equal = defaultdict(set)
        for i, x in enumerate(p):
            for j in places[x]:
                equal[j - i].add(i)
        for hit in equal.values():
            best = max(sum(i in hit for i in range(s, s + size)) for s in range(n - size + 1))
            if best >= 0.75 * size or (len(w) < size and len(hit) >= max(least, 0.75 * len(w))):
                found.add((d, k))
    return found


def test_leaks_equal_brute_force_at_three_quarters(spark):
    rng = random.Random(6)
    items = {n: [f"i{n}_{j}" if n % 3 else f"i{rng.randrange(80)}" for j in range(n)] for n in range(5, 40)}
    texts = {}
    for d in range(600):
        p = list(items[5 + d % 35])
        for j in rng.sample(range(len(p)), len(p) // 4):
            p[j] = "other"
        texts[d] = words(rng, 30) + p + words(rng, 30)
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in items.items()], "item_id int, text string")
    want = leak_brute(texts, items)
    assert len(want) > 580
    assert {(r.doc_id, r.item_id) for r in leaks(frame(spark, {d: " ".join(w) for d, w in texts.items()}), bench).collect()} == want


def test_leaks_at_the_edges_of_documents(spark):
    rng = random.Random(7)
    items = {n: [f"i{n}_{j}" for j in range(n)] for n in (7, 12, 20, 59)}
    texts = {0: words(rng, 40) + items[20][:19], 1: items[20][1:] + words(rng, 40), 2: items[59][20:40], 3: items[59][50:], 4: items[59][10:17], 5: items[59][10:18], 6: items[7][:6], 7: items[20][5:] + words(rng, 5)}
    for d in range(10, 300):
        p = list(items[rng.choice(list(items))])
        for j in rng.sample(range(len(p)), rng.randrange(len(p) // 4)):
            p[j] = "other"
        a = rng.randrange(len(p) // 2)
        p = p[a : a + rng.randrange(4, 40)]
        texts[d] = p + words(rng, rng.choice([0, 2, 30])) if d % 2 else words(rng, rng.choice([0, 2, 30])) + p
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in items.items()], "item_id int, text string")
    want = leak_brute(texts, items)
    assert {(0, 20), (1, 20), (2, 59), (3, 59), (5, 59), (6, 7), (7, 20)} <= want and not any(d == 4 for d, _ in want)
    df = frame(spark, {d: " ".join(w) for d, w in texts.items()})
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()} == want
    assert {r.doc_id for r in without_leaks(df, bench).collect()} == {None, *texts} - {d for d, _ in want}


def test_leaks_in_repetitive_texts_stay_in_bounds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 50_000)
    items = {0: ["the"] * 400, 1: ["a", "b"] * 100, 2: words(random.Random(3), 30)}
    texts = {0: ["the"] * 6000, 1: ["b", "a"] * 900 + items[2], 2: ["the"] * 20 + ["x"] * 50, 3: ["y"] * 3000, 4: items[2][:23] + ["the"] * 900}
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in items.items()], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(frame(spark, {d: " ".join(w) for d, w in texts.items()}), bench).collect()}
    assert got == leak_brute(texts, items) == {(0, 0), (1, 1), (1, 2), (2, 0), (4, 0), (4, 2)}
    most = max(len(p) for w in texts.values() for index in [decontaminate._index([(k, " ".join(p)) for k, p in items.items()], MASKS)] for p, _ in decontaminate._hits(decontaminate.word_hashes([" ".join(w).encode()])[0], index))
    assert most <= 50_000 + 400


def test_leaks_take_a_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    items = {k: words(rng, 30) for k in range(12)}
    texts = {d: words(rng, 40) + (items[d] if d < 12 else []) for d in range(20)}
    df = frame(spark, {d: " ".join(w) for d, w in texts.items()})
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in items.items()], "item_id int, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()} == leak_brute(texts, items)
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, *range(12, 20)}


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path(), random.Random(0)
    t, ids_of = Tokenizer.from_file(path), encoder(path)
    odd = ["", " ", "\n", "a\n", "\na", "a\n\nb", "a\tb", "x\xa0y", "x \u2003y", "a  b\n\n c\t d<|endoftext|> e's it's  \n", "x\x1cy\x85z\u3000q 12a3  k", "  a", "é b  \r\n k", "don't. Stop!| '' 5,", "."]
    odd += ["".join(rng.choice("ab é'.,!|\n\t 19\u3000<") for _ in range(rng.randrange(60))) for _ in range(400)]
    for x in odd:
        assert list(np.frombuffer(ids_of(x), "<u4")) == t.encode(x, add_special_tokens=False).ids, x


def test_dac_reads_any_token():
    rng = np.random.default_rng(2)
    for high in (1, 2, 300, 50_257, 2**31):
        lengths = rng.integers(0, 900, 40)
        ids = (rng.zipf(1.2, lengths.sum()) % high).astype(np.uint32)
        f = DacFile(encode(np.arange(40), lengths, ids))
        at = rng.integers(0, len(ids), 500)
        assert (f.get(at) == ids[at]).all()
        for a, z in np.sort(rng.integers(0, len(ids) + 1, (30, 2)), axis=1).tolist():
            assert (f.span(a, z) == ids[a:z]).all()


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path, texts = tokenizer_path(), corpus()
    t = Tokenizer.from_file(path)
    df = frame(spark, texts)
    got = [tuple(r) for r in token_binary(df.union(df.where("doc_id = 3")), path).orderBy("start").collect()]
    want, start = [], 0
    for d in sorted([*texts, 3]):
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_binary(empty(spark), path).count() == 0
