"""Quality classifier: naive Bayes support vectors. N-gram indicators, scaled by class log-count ratios, go into a linear
hinge-loss model that dual coordinate descent fits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_ids, cut, tidy

TOKENS = re.compile(r"\w+|[^\w\s]+")


def grams(text: str) -> set[str]:
    """Indicators of a text: its one- and two-token grams, and one-, two- and three-token grams of token shapes.

    Tokens are words and runs of signs. A shape says what a word looks like (capitals, digits, signs, a repeat of the
    word or sign group two or fewer tokens before), so that texts of unseen words share grams.
    """
    raw = TOKENS.findall(text)
    low = [t.lower() for t in raw]
    shapes = []
    for i, t in enumerate(raw):
        if i and low[i - 1] == low[i] or i > 1 and low[i - 2] == low[i] and t[0].isalnum():
            shapes.append("=")
        elif not (t[0].isalnum() or t[0] == "_"):
            shapes.append(t[:3])
        elif t.isupper() and len(t) > 1:
            shapes.append("A")
        else:
            shapes.append("9" if t.isdigit() else "Aa" if t[0].isupper() else "a")
    out = set(low)
    out.update(map(" ".join, zip(low, low[1:])))
    out.update("\x01".join(g) for g in set(zip(shapes, shapes[1:])) | set(zip(shapes, shapes[1:], shapes[2:])) | {(s, "") for s in shapes})
    return out


def frequent_grams(texts: list[str], min_docs: int, most: int) -> tuple[dict[str, int], list[np.ndarray]]:
    """(numbers of the `most` grams that are in the most texts, `min_docs` at least, ties by the gram; each text's sorted
    numbers).

    A first pass counts texts by hash bucket alone, so the strings of rare grams are never held together.
    """
    mask = (1 << 22) - 1
    buckets = np.zeros(mask + 1, dtype=np.int32)

    def places(g: list[str]) -> np.ndarray:
        return np.fromiter(map(hash, g), dtype=np.int64, count=len(g)) & mask

    for t in texts:
        buckets[np.unique(places(list(grams(t))))] += 1
    met: dict[str, int] = {}
    held = []
    for t in texts:
        g = list(grams(t))
        held.append(np.array([met.setdefault(x, len(met)) for x in compress(g, buckets[places(g)] >= min_docs)], dtype=np.int32))
    n = np.bincount(np.concatenate(held), minlength=len(met)) if held else np.zeros(0, dtype=np.int64)
    top = sorted((-int(n[i]), g) for g, i in met.items() if n[i] >= min_docs)[:most]
    number = np.full(len(met), -1, dtype=np.int32)
    number[[met[g] for _, g in top]] = np.arange(len(top))
    return {g: i for i, (_, g) in enumerate(top)}, [np.sort(x[x >= 0]) for x in (number[h] for h in held)]


def train_nbsvm(texts: list[str], labels: list[int], min_docs: int = 3, max_grams: int = 200_000, c: float = 1.0, passes: int = 30, seed: int = 3) -> tuple[dict[str, complex], float, float, float]:
    """(by gram, its weight times its ratio and, as imaginary part, the ratio's square; bias, and slope and offset of the logistic that turns a margin into a probability).

    Log-count ratios r = log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|) over indicator counts scale the indicators; the
    scaled rows, of length 1, go through dual coordinate descent for the L2-regularised hinge loss, classes weighed so
    that both have the same total. The logistic is fitted to margins of rows that its model has not seen.
    """
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    vocabulary, rows = frequent_grams(texts, min_docs, max_grams)

    def fit(which: np.ndarray) -> tuple[np.ndarray, float]:
        counts = np.ones((2, len(vocabulary)))
        for i in which:
            counts[int(y[i] > 0), rows[i]] += 1
        r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        norms = np.array([np.sqrt(r[rows[i]] @ r[rows[i]] + 1.0) for i in which])
        most = c * np.where(y[which] > 0, len(which) / (2 * (y[which] > 0).sum()), len(which) / (2 * (y[which] < 0).sum()))
        w, b, alpha, rng = np.zeros(len(vocabulary)), 0.0, np.zeros(len(which)), np.random.default_rng(seed)
        for _ in range(passes):
            moved = 0.0
            for k in rng.permutation(len(which)):
                i, n = which[k], norms[k]
                v = r[rows[i]]
                gradient = y[i] * ((w[rows[i]] @ v + b) / n) - 1.0  # each scaled row has length 1, its constant included
                new = min(max(alpha[k] - gradient, 0.0), most[k])
                step = (new - alpha[k]) * y[i] / n
                if step:
                    w[rows[i]] += step * v
                    b += step
                    moved = max(moved, abs(new - alpha[k]))
                    alpha[k] = new
            if moved < 1e-3:
                break
        return w * r + 1j * r * r, b

    def margin(w: np.ndarray, b: float, i: int) -> float:
        """Of the text's scaled row at length 1, as it was trained."""
        s = w[rows[i]].sum()
        return (s.real + b) / np.sqrt(s.imag + 1)

    everything = np.arange(len(y))
    odd = everything % 4 == 0
    a, o = 2.0, 0.0
    if odd.any() and {*y[odd]} == {*y[~odd]} == {-1.0, 1.0}:
        w, b = fit(everything[~odd])
        m, t = np.array([margin(w, b, i) for i in everything[odd]]), (y[odd] > 0).astype(float)
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(a * m + o, -30, 30)))
            g, h = np.array([(p - t) @ m, (p - t).sum()]), p * (1 - p) + 1e-9
            hess = np.array([[h @ (m * m) + 1e-6, h @ m], [h @ m, h.sum() + 1e-6]])
            d = np.linalg.solve(hess, g)
            a, o = a - d[0], o - d[1]
            if abs(d).max() < 1e-8:
                break
    w, b = fit(everything)
    return {g: complex(w[i]) for g, i in vocabulary.items()}, float(b), float(a), float(o)


def _score(model, prior: float):
    """Of the field `text` of the struct column `row`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, a, o = model.value if model else ({}, 0.0, 0.0, 0.0)
        known = weights.keys()
        for batch in batches:
            scores = []
            for t in batch.column("row").field("text").cast(pa.string()).to_pylist():
                if model is None:
                    scores.append(prior)
                    continue
                s = sum(map(weights.__getitem__, grams(t or "") & known))
                m = (s.real + bias) / np.sqrt(s.imag + 1)
                scores.append(float(1 / (1 + np.exp(-np.clip(a * m + o, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def training_texts(docs: DataFrame, known: DataFrame, max_train: int, max_chars: int, total_chars: int) -> list[tuple]:
    """(doc_id, text, label) for the driver, in order of doc_id: texts of `total_chars` together at most, first by hash."""
    picked = bounded_ids(known, max_train).union(bounded_ids(known.where("label = 0"), max_train)).distinct()
    sample = known.join(F.broadcast(picked), "doc_id")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = rows.join(F.broadcast(sample), "doc_id").where(F.length("text") <= max_chars)
    chosen = cut(chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")))
    sizes = chosen.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # a row a sampled doc_id
    ends = np.cumsum([r.n for r in sizes])
    fits = [r.doc_id for r in sizes[: int(np.searchsorted(ends, total_chars, "right"))]]
    held = chosen if len(fits) == len(sizes) else chosen.where(F.col("doc_id").isin(fits))
    return sorted((r.doc_id, r.text, r.label) for r in held.collect())


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = 3_000, max_train_chars: int = 200_000, total_train_chars: int = 24_000_000, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """doc_id (or with `keep` all columns of `docs` as one struct column `row`), score (probability of label 1) and
    predicted of every document.

    `labels` has doc_id and label. The model is fitted on the driver from a bounded sample: the first `max_train`
    labelled doc_ids by hash and as many of label 0 alone (the rarer class), those of up to `max_train_chars` characters
    and of `total_train_chars` together; its weights, at most `max_grams`, are broadcast. A doc_id with several labels
    counts as 1 if any is. A null text counts as empty and scores by the bias alone; a very long text is scored whole,
    by its set of grams; an empty table gives no rows; repeated rows fare alike. Labels of one class give every row that
    class's mean. With `keep` the columns of `docs` may have any names, score and predicted among them.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    train = training_texts(docs, known, max_train, max_train_chars, total_train_chars)
    kinds = {r[2] for r in train}
    model, prior = None, float(min(kinds, default=0))
    if kinds == {0, 1}:
        model = docs.sparkSession.sparkContext.broadcast(train_nbsvm([r[1] for r in train], [r[2] for r in train]))
    columns = [F.col(f"`{c}`") for c in docs.columns] if keep else ["doc_id", "text"]
    given = docs.select(F.struct(*columns).alias("row"))
    out = given.mapInArrow(tidy(_score(model, prior)), StructType([*given.schema.fields, StructField("score", DoubleType())]))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return out.select(*(["row"] if keep else ["row.doc_id"]), "score", predicted)
