"""The pipeline's stages, each on what the one before kept, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_text_operators import jaccard_brute, tokenizer_path, words

import __spark_entry__
import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    """Clean documents in groups of near copies, shouted junk, leaked passages, odd rows; labels and a benchmark."""
    rng = random.Random(12)
    items = {k: words(rng, 40) for k in range(3)}
    texts, junk, leaked = {}, set(), set()
    for i in range(90):
        if i % 6 == 5:
            junk.add(i)
            texts[i] = " ".join(w.upper() + "!!" for w in words(rng, 80))
        elif i % 6 == 4:
            leaked.add(i)
            texts[i] = " ".join(words(rng, 60) + items[i % 3] + words(rng, 20))
        elif i % 3 == 0 or i < 6:
            texts[i] = " ".join(words(rng, 120))
        else:
            w = texts[i - i % 3].split(" ")
            w[rng.randrange(len(w))] = "edited"
            texts[i] = " ".join(w)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts.items()] + [(1, texts[1], "en", "s1", len(texts[1])), (200, "", None, None, 0), (201, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts, junk, leaked


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, junk, leaked = tables(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    good = {r.doc_id for r in seen["quality"]}
    assert not good & junk and set(texts) - junk <= good
    classes = jaccard_brute([(r.doc_id, r.text) for r in seen["quality"]])
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted({c for _, c, _ in classes})
    clean = {r.doc_id for r in seen["decontamination"]}
    assert clean == {r.doc_id for r in seen["near_duplicates"]} - leaked
    size = {r.doc_id: len(re.findall(r"\S+", r.text or "")) for r in seen["decontamination"]}
    taken = Counter()
    for r in seen["mixture"]:
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(taken[d] <= 2 * size[d] for d in taken) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 8
    t, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(seen["mixture"], key=lambda r: (r.doc_id, r.text)):
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, seen["token_files"])) == sorted(want)
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_stages_take_empty_tables_and_columns_of_any_name(spark, tmp_path):
    texts, junk, leaked = tables(spark, str(tmp_path))
    names = ["score", "predicted", "row", "copy", "size", "class_id", "label", "rep", "_text", "h"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 60")
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
    assert cp.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [k for k, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "token_files"]
